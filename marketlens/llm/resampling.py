"""Importance resampling towards a target: documents drawn by hashed n-gram weights and Gumbel noise, without replacement.

Features are all runs of one and of two consecutive words, repeats counted; a feature's bucket is the CRC-32 of its UTF-8
bytes modulo BUCKETS. Both corpora are counted by bucket, and a bucket's gain is the logarithm of its share of the target
over its share of the documents, smoothed, in thousandths. A document's weight is the mean gain of its features; Gumbel noise
from a hash of its id makes the highest scores a draw by weight.

The words of a batch are worked on by Arrow kernels: ascii_lower, split_pattern_regex, list_flatten and dictionary_encode.
Indices shifted by one make the pairs, each distinct pair is hashed once, gains are taken by index and summed over a
document's stretch of them. Counts of a task leave it as BUCKETS rows; the gains, a table of fixed size, go to all tasks. Texts
are read twice, to count and to score, which moves less than to store their features. Ranks come from one sort by range of
narrow rows.

A null text has no words: no features, weight 0, never drawn. Rows with a null id are counted and weighted, but have no score
and are not drawn. Rows that repeat an id draw the same noise, equal rows are each drawn. Empty tables have no features, and an
empty target makes all gains those of an even distribution. Further columns are ignored, or kept by sample(). Texts of
over LONG bytes are cut where a word ends, which changes nothing.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import materialise, pieces, placed

BUCKETS = 10_000
#: Between words, in lower-cased text: all of ASCII but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LAST_WORD, _GAP = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x60\x7B-\x7F]*\Z"), re.compile(BETWEEN.encode())
#: Bytes of text that are worked on at once, if not one short text.
LONG = 1 << 22
#: A document needs so many words to be drawn.
MIN_WORDS = 20


def _cuts(text: str) -> Iterator[tuple[str, bool]]:
    """A long text in parts, each but the first beginning with the last word of the part before, and whether it does."""
    data, at, again = text.encode().lower(), 0, False
    while True:
        gap = _GAP.search(data, at + LONG)
        end = gap.start() if gap else len(data)
        yield data[at:end].decode(), again
        if not gap:
            return
        last = _LAST_WORD.search(data, at, end)
        at, again = (last.start(), True) if last else (end, False)


def _parts(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Slices of about LONG bytes: texts, the row of each, and whether its first word was in the text before."""
    size, at = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64), 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), LONG, "right")) + at)
        if size[at] <= LONG:
            yield texts.slice(at, end - at), np.arange(at, end), np.zeros(end - at, bool)
        else:
            end = at + 1
            for part, again in _cuts(texts[at].as_py()):
                yield pa.array([part]), np.array([at]), np.array([again])
        at = end


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """row, starts, buckets: the buckets of each row's features lie between two starts; a row can come in several parts."""
    for part, rows, again in _parts(texts):
        lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(part, "")), BETWEEN)
        words, row = pc.list_flatten(lists), pc.list_parent_indices(lists)
        real = pc.not_equal(words, "")  # text can begin or end with what is between words
        coded, row = words.filter(real).dictionary_encode(), row.filter(real).to_numpy()
        ids, spelt = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.binary()).to_pylist()
        alone = np.fromiter(map(zlib.crc32, spelt), np.int64, len(spelt))
        opened = np.fromiter((zlib.crc32(b" ", c) for c in alone.tolist()), np.int64, len(spelt))
        inside = row[1:] == row[:-1]
        pairs = pa.array((ids[:-1] * len(spelt) + ids[1:])[inside]).dictionary_encode()
        first, second = np.divmod(pairs.dictionary.to_numpy(), max(1, len(spelt)))
        joined = np.fromiter(map(zlib.crc32, map(spelt.__getitem__, second.tolist()), opened[first].tolist()), np.int64, len(first))
        fresh = np.ones(len(ids), bool)
        begins = np.searchsorted(row, np.arange(len(part) + 1))
        fresh[begins[:-1][again & (np.diff(begins) > 0)]] = False
        for own, of in ((alone[ids[fresh]], row[fresh]), (joined[pairs.indices.to_numpy()], row[1:][inside])):
            yield rows, np.searchsorted(of, np.arange(len(part) + 1)), own % BUCKETS


def count(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many features of all texts are in each bucket; a row a bucket and task is shuffled, BUCKETS rows are returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in pieces(batches):
            for _, _, own in features(b.column(0)):
                total += np.bincount(own, minlength=BUCKETS)
        there = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in found.collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of a bucket's smoothed share of the target over that of the source, rounded down."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: the id, n_words, n_features, and weight, the floored mean gain of its features."""
    handed = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            n, total, words = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for k, (rows, starts, own) in enumerate(features(b.column(1))):
                so_far = np.concatenate([[0], np.cumsum(handed.value[own])])
                np.add.at(n, rows, np.diff(starts))
                np.add.at(total, rows, np.diff(so_far[starts]))
                if k % 2 == 0:  # single words
                    np.add.at(words, rows, np.diff(starts))
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(n), pa.array(weight)], [id_col, "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: the id, n_features, weight, score and rank; rank is null for those that are not drawn.

    Drawn are `percent` percent, rounded down, of the documents with at least min_words words; ties go to the smaller id."""
    gain = gains(count(docs, text_col), count(target, text_col))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    weighed = weigh(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), gain, "id")
    scored = materialise(weighed.withColumn("score", F.col("weight") + noise), "resampling-scored")
    can = (F.col("n_words") >= min_words) & F.col("id").isNotNull()
    ranked = placed(scored.filter(can), [], [F.col("score").desc(), F.col("id").asc()], "resampling")
    drawn = scored.filter(can).count() * percent // 100
    rank = F.when(F.col("_place") < drawn, F.col("_place") + 1).cast("long").alias("rank")
    shown = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    return ranked.select(*shown, rank).unionAll(scored.filter(~can).select(*shown, F.lit(None).cast("long").alias("rank")))


def sample(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The drawn rows of docs, all columns; ids are unique."""
    drawn = resample(docs, target, percent, seed, min_words, id_col, text_col).filter("rank is not null").select(id_col)
    return docs.join(drawn, id_col, "left_semi").select(*docs.columns)
