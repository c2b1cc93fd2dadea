"""Pieces that several corpus operators share: shared storage, size-checked joins, skew-safe joins, text helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from marketlens.sources.shared import materialise

__all__ = ["ascii_space", "attach", "attach_wide", "bitmap", "kept_rows", "look_up", "materialise", "may_be_in", "of_checked_size", "pieces", "placed", "small_table", "text_hash", "without"]

#: Rows of whole documents that are worked on at once, of a batch whose bytes Spark bounds.
BATCH_ROWS = 256
#: 64-bit words of the bitmap that tells most rows that stay (at most 40 MB as a table).
BITMAP_WORDS = 1 << 20
#: Ids (16 bytes each with overhead) that may be broadcast; past that the join shuffles.
BROADCAST_IDS = 1_000_000
#: A key is hot from this share of all rows on, so that fewer than HOT_KEYS keys can be hot.
HOT_KEYS = 2_000
#: Fewer rows than this are never worth a salt.
HOT_FLOOR = 64
#: What empties the caches that a worker keeps from task to task.
KEPT: list[Callable[[], None]] = []


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few rows of the driver's as a table, handed over by Arrow.

    For plain rows Spark starts workers of another kind on every executor, which stay beside those that work on batches."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds.types, strict=True)], schema=kinds), schema)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, give_back: bool = False, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of so many rows, at least one a batch; Spark bounds the bytes of a batch itself.

    A worker lives on between tasks: with give_back it returns what it has freed to the system at the end of one, and
    without keep also what other tasks have left in the caches of KEPT."""
    for b in batches:
        for at in range(0, max(1, b.num_rows), rows):
            yield b.slice(at, rows)
    if give_back:
        for forget in [] if keep else KEPT:
            forget()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library
            trim(0)


def kept_rows(docs: DataFrame, columns: Sequence[str], keep: Callable[[pa.RecordBatch], list[bool]]) -> DataFrame:
    """The rows of docs, all columns, that keep() says stay, given batches of the named columns. No row is moved."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, give_back=True):
            yield b.filter(pa.array(keep(b.select([names.index(c) for c in columns])), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def of_checked_size(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """Marks ids for broadcast if they are few enough; otherwise leaves the choice to Spark."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def bitmap(keys: DataFrame, columns: Sequence[str]) -> DataFrame:
    """_word, _bits: a bit for a hash of each row's columns, BITMAP_WORDS * 64 of them however many rows there are."""
    slot = F.xxhash64(*columns)
    word, bit = F.floor(F.pmod(slot, F.lit(BITMAP_WORDS * 64)) / 64).cast("long"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({', '.join(columns)}), 64) as int))")
    return keys.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))


def may_be_in(rows: DataFrame, bits: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows with a column _hit: whether the bit of their columns, named as in bitmap(), is set. No row is moved."""
    slot = F.xxhash64(*columns)
    seen = rows.withColumn("_word", F.floor(F.pmod(slot, F.lit(BITMAP_WORDS * 64)) / 64).cast("long")).join(F.broadcast(bits), "_word", "left")
    hit = F.expr(f"shiftrightunsigned(_bits, cast(pmod(xxhash64({', '.join(columns)}), 64) as int)) & 1L = 1L")
    return seen.withColumn("_hit", F.coalesce(hit, F.lit(False))).drop("_word", "_bits")


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs but for the rows that gone(id, h) names, h being text_hash() of the text; rows with a null id stay.

    Few rows are handed to all tasks. More than BROADCAST_IDS are told from the others by a bitmap of fixed size first, and
    only rows with a bit set, which are little more than those that go, are shuffled with their texts.
    """
    gone = gone.select("id", "h").filter("id is not null").distinct()
    named = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("h"))
    if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        return named.join(F.broadcast(gone), ["id", "h"], "left_anti").select("_row.*")
    seen = may_be_in(named, bitmap(gone, ["id", "h"]), ["id", "h"])
    left = seen.filter("not _hit").select("_row").unionAll(seen.filter("_hit").join(gone, ["id", "h"], "left_anti").select("_row"))
    return left.select("_row.*")


def text_hash(text: Column) -> Column:
    """Together with an id it tells rows apart; equal rows share one."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, rows: int, spread: Column) -> DataFrame:
    """Left join to a right side that is unique by non-null keys, safe against hot keys.

    weight is the right-hand column that says how many left rows a key has. Keys with at least rows/HOT_KEYS of
    them are at most HOT_KEYS in number, so they are broadcast; left rows of those keys are dealt out by `spread`,
    and only the other keys meet in a shuffle.
    """
    values = [c for c in right.columns if c not in keys]
    bound = max(HOT_FLOOR, rows // HOT_KEYS)
    zero = (F.col(weight) - F.col(weight)).cast("bigint")  # not a literal, which the optimiser would take out of the join's keys
    hot = right.filter(F.col(weight) >= bound).select(*keys, F.struct(*values).alias("_hot"))
    cold = right.filter(F.col(weight) < bound).select(*keys, zero.alias("_salt"), F.struct(*values).alias("_cold"))
    marked = left.join(F.broadcast(hot), list(keys), "left").withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.xxhash64(spread)))
    found = F.coalesce("_hot", "_cold")
    return marked.join(cold, [*keys, "_salt"], "left").select(*left.columns, *(found[c].alias(c) for c in values))


def attach_wide(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, rows: int, spread: Column) -> DataFrame:
    """attach() for values of any width: none is broadcast, a hot key's row is repeated for each share of rows/HOT_KEYS of its left rows.

    Only the hot keys and their numbers of shares go to all tasks, so the repeated rows are at most HOT_KEYS more."""
    values = [c for c in right.columns if c not in keys]
    shares = F.ceil(F.col(weight) / max(HOT_FLOOR, rows // HOT_KEYS)).cast("int")
    hot = right.select(*keys, shares.alias("_shares")).filter("_shares > 1")
    dealt = left.join(F.broadcast(hot), list(keys), "left").withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_shares", F.lit(1))).cast("int"))
    wide = right.select(*keys, *values, F.explode(F.sequence(F.lit(0), F.greatest(shares, F.lit(1)) - 1)).alias("_salt"))
    return dealt.join(wide, [*keys, "_salt"], "left").select(*left.columns, *values)


def look_up(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, rows: int, spread: Column) -> DataFrame:
    """attach(), without a shuffle of left where right, which is materialised, has few rows."""
    if right.limit(BROADCAST_IDS // 4 + 1).count() > BROADCAST_IDS // 4:
        return attach(left, right, keys, weight, rows, spread)
    return left.join(F.broadcast(right), list(keys), "left").select(*left.columns, *(c for c in right.columns if c not in keys))


def placed(rows: DataFrame, by: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """rows with _place: 0, 1, 2... among the rows of equal `by`, which has no nulls, in the order given; ties in any order.

    No group goes through one task: all rows are sorted by range, ties parted by a salt, and a row's place is that in its part
    plus the rows of its group in the parts before, of which there is a number for each part and group.
    """
    held = materialise(rows.withColumn("_salt", F.monotonically_increasing_id()), name + "-rows")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), held.count() // 1_000_000)
    keys = [*(F.col(c).asc() for c in by), *order, F.col("_salt").asc()]
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the number of a row within its part
    dealt = held.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumns({"_part": F.spark_partition_id(), "_at": inside})
    dealt = materialise(dealt.drop("_salt"), name + "-sorted")
    runs = dealt.groupBy("_part", *by).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    runs = runs.select("_part", *by, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    found = dealt.join(of_checked_size(materialise(runs, name + "-runs")), ["_part", *by])
    return found.withColumn("_place", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def ascii_space(text: Column) -> Column:
    """Each run of the six ASCII white-space characters becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")
