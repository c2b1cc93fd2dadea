"""The corpus pipeline: documents go through language ID, exact and near deduplication, decontamination and packing.

A stage takes (spark, docs, sf_dir), docs being all that the stage before kept, and returns what it keeps with the columns
of documents; the last returns packed pieces. run() writes each stage's rows as Parquet and reads them again.

A null text is empty; it has no letters, so the first stage drops it, as it does texts of white space or digits alone.
Rows with a null id take no part in deduplication; rows that repeat an id are told apart by their texts, and of rows equal in
both either all stay or all go. Rows without a language or source are treated like others, further columns are carried along
to the last stage. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import decontamination, exact_dedup, language, near_copies, packing
from marketlens.llm.common import materialise
from marketlens.llm.queries import VOCABULARY

#: Words that a worker's tokenizer keeps, a quarter of its usual number: here the executors' memory also holds what earlier stages have touched.
WORDS = 50_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents; those without letters, or between two languages, go."""
    return language.drop_rejected(docs, language.train(docs, F.lit(True)))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash, with the rest found by exact overlap: of texts that share 4/5 of their five-word shingles the smallest id stays."""
    return near_copies.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover half of a benchmark item or more go."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 2048 tokens with every source's share in each window."""
    return packing.pack(docs, VOCABULARY, words=WORDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: Compression sizes, XXH64 fingerprints, tiles and token ids are beyond SQL; tests/llm hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
