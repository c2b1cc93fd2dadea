"""Training-data operators: deduplication, language, quality, packing, archives, extraction, scoring, resampling, personal data, manifests."""
