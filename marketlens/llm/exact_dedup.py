"""Exact deduplication by progressive refinement, with DataFrame functions only.

Rows are grouped by the length of their normalised text; groups of one are settled. The others are grouped by a hash
of the first characters, and only rows of groups that survive that too have their whole text read and hashed with SHA-256:
a bitmap of the surviving groups, of fixed size, tells them where they lie, so no text is ever moved (rows whose bit is
set by another group are hashed as well, which decides nothing). A null text counts as empty; empty texts are equal to
each other. Of equal texts the smallest id stays; of rows that repeat an id only those with a text to drop go. A row
with a null id stands for itself: it is kept and in no group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import ascii_space, attach, bitmap, materialise, may_be_in, text_hash, without

#: Characters of the normalised text that the second level hashes.
PREFIX_CHARS = 256


def _keys(text: Column) -> list[Column]:
    norm = ascii_space(text)
    return [F.length(norm).cast("bigint").alias("n"), F.xxhash64(F.substring(norm, 1, PREFIX_CHARS)).alias("p")]


def refine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that survive length and prefix, with the hash of their whole text: id, n, p, h (text_hash()), text_sha256."""
    text = F.col(text_col)
    rows = materialise(docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *_keys(text)), "exact-keys")
    total = rows.count()
    level = rows
    for keys in (["n"], ["n", "p"]):
        sizes = level.groupBy(*keys).agg(F.count("*").alias("w")).filter("w > 1")
        level = attach(level, sizes, keys, "w", total, F.col("id")).filter("w is not null").drop("w")
    survivors = materialise(bitmap(level, ["n", "p"]), "exact-survivors")
    named = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text.alias("t"), *_keys(text))
    read = may_be_in(named, survivors, ["n", "p"]).filter("_hit")
    return materialise(read.select("id", "n", "p", text_hash(F.col("t")).alias("h"), F.sha2(ascii_space(F.col("t")), 256).alias("text_sha256")), "exact-hashed")


def duplicate_groups(hashed: DataFrame) -> DataFrame:
    """Groups of two or more equal texts: n, p (length and prefix hash), text_sha256, keep_id, group_size."""
    groups = hashed.groupBy("n", "p", "text_sha256").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    return materialise(groups.filter("group_size > 1"), "exact-groups")


def label(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, and text_sha256 of every normalised text."""
    groups = duplicate_groups(refine(docs, id_col, text_col))
    rows = docs.select(F.col(id_col).alias("id"), *_keys(F.col(text_col)), F.sha2(ascii_space(F.col(text_col)), 256).alias("text_sha256"))
    found = attach(rows, groups, ["n", "p", "text_sha256"], "group_size", docs.count(), F.col("id"))
    lone = F.col("group_size").isNull() | F.col("id").isNull()
    return found.select(
        F.col("id").alias(id_col),
        F.when(lone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(lone, F.lit(1)).otherwise(F.col("group_size")).cast("bigint").alias("group_size"),
        F.when(lone, F.lit(True)).otherwise(F.col("id") == F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies; all columns stay. Whole texts are hashed only where length and prefix agree."""
    hashed = refine(docs, id_col, text_col)
    found = attach(hashed, duplicate_groups(hashed), ["n", "p", "text_sha256"], "group_size", hashed.count(), F.col("id"))
    return without(docs, materialise(found.filter("id <> keep_id").select("id", "h"), "exact-dropped"), id_col, text_col)
