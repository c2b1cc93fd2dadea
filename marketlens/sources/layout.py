"""Tables laid out for pages and for lookups: what is read follows what is asked for, not how much there is.

SortedTable keeps rows in one order, numbered, in parts of which first and last number are known. A page that goes on from a
row reads the parts from there until it is full, so the thousandth page costs what the first does.
IdTable keeps rows by hash of their id in folders, sorted by id with Bloom filters, so that a lookup opens the ids' folders alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.sources.shared import materialise, new_folder

#: The number of a row, from 0, and the part it is in.
PLACE, PART = "_lugar", "_parte"


@dataclass
class SortedTable:
    """Rows in order under a folder; parts: number -> first place and number of rows, a few numbers for each file."""

    spark: SparkSession
    path: str
    parts: list[tuple[int, int, int]]
    #: The parts that pages have opened, for tests and for those who want to know.
    opened: list[int] = field(default_factory=list)

    @classmethod
    def build(cls, rows: DataFrame, order: Sequence[Column], parts: int, name: str = "sorted") -> SortedTable:
        """Sorts rows by range into `parts` parts; a salt parts rows that are alike, so no part grows with a repeated key."""
        spark, path = rows.sparkSession, new_folder(rows.sparkSession, name)
        held = materialise(rows.withColumn("_salt", F.monotonically_increasing_id()), f"{name}-rows")
        keys = [*order, F.col("_salt").asc()]
        inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the number of a row within its part
        dealt = held.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumns({PART: F.spark_partition_id(), PLACE: inside})
        dealt = materialise(dealt.drop("_salt"), f"{name}-dealt")
        counts = dict(dealt.groupBy(PART).agg(F.count("*")).collect())
        firsts, place = [], 0
        for part in sorted(counts):
            firsts.append((part, place, counts[part]))
            place += counts[part]
        starts = spark.createDataFrame([(p, first) for p, first, _ in firsts], f"{PART} int, _first long")
        numbered = dealt.join(F.broadcast(starts), PART).withColumn(PLACE, F.col(PLACE) + F.col("_first")).drop("_first")
        numbered.repartition(max(1, len(firsts)), PART).sortWithinPartitions(PART, PLACE).write.partitionBy(PART).parquet(path)
        return cls(spark, path, firsts)

    def __len__(self) -> int:
        return self.parts[-1][1] + self.parts[-1][2] if self.parts else 0

    def _read(self, parts: Sequence[int]) -> DataFrame:
        self.opened += parts
        return self.spark.read.parquet(self.path).filter(F.col(PART).isin(list(parts))).drop(PART)

    def page_at(self, offset: int, size: int) -> DataFrame:
        """Rows offset to offset + size - 1 of the whole table."""
        return self._read([p for p, first, n in self.parts if first < offset + size and first + n > offset]).filter(F.col(PLACE).between(offset, offset + size - 1)).orderBy(PLACE)

    def page_after(self, place: int, size: int, where: Column | None = None, among: DataFrame | None = None) -> DataFrame:
        """The first `size` rows after `place` (-1: from the start) that hold, and whose columns named as among's are one of its rows.

        Parts are opened in order, twice as many each time, until the page is full: where few rows hold, more are opened."""
        left = [p for p, first, n in self.parts if first + n - 1 > place]
        taken: list[int] = []
        while True:
            taken += left[len(taken) : 2 * len(taken) or 1]
            rows = self.spark.read.parquet(self.path).filter(F.col(PART).isin(taken)).drop(PART).filter(F.col(PLACE) > place)
            rows = rows.filter(where) if where is not None else rows
            rows = rows.join(among, among.columns, "left_semi") if among is not None else rows
            if len(taken) >= len(left) or rows.limit(size).count() == size:
                self.opened += taken
                return rows.orderBy(PLACE).limit(size)


@dataclass
class IdTable:
    """Rows by hash of an id, in `buckets` folders under path; ids sorted and with Bloom filters in each file."""

    spark: SparkSession
    path: str
    id_col: str
    buckets: int

    @classmethod
    def build(cls, rows: DataFrame, id_col: str, buckets: int, name: str = "by-id", spread: int = 1) -> IdTable:
        """spread: files a folder, dealt by all columns, so that an id of very many rows isn't one task's."""
        path = new_folder(rows.sparkSession, name)
        deal = F.pmod(F.xxhash64(*rows.columns), F.lit(spread))
        dealt = rows.withColumns({"_cubo": _bucket(id_col, buckets), "_deal": deal}).repartition(max(1, buckets * spread), "_cubo", "_deal").sortWithinPartitions("_cubo", id_col).drop("_deal")
        options = {f"parquet.bloom.filter.enabled#{id_col}": "true", f"parquet.bloom.filter.expected.ndv#{id_col}": "1000000", "parquet.bloom.filter.adaptive.enabled": "true"}
        dealt.write.options(**options).partitionBy("_cubo").parquet(path)
        return cls(rows.sparkSession, path, id_col, buckets)

    def lookup(self, ids: DataFrame) -> DataFrame:
        """ids(id_col) with all columns of their rows, or nulls; only folders that some id falls in are opened."""
        asked = ids.select(self.id_col, _bucket(self.id_col, self.buckets).alias("_cubo")).distinct()
        folders = [r[0] for r in asked.select("_cubo").distinct().collect()]  # as many as folders
        rows = self.spark.read.parquet(self.path).filter(F.col("_cubo").isin(folders))
        return asked.join(rows, ["_cubo", self.id_col], "left").drop("_cubo")

    def get(self, *values: object) -> DataFrame:
        """The rows of a few ids; the files' Bloom filters and sort order leave out most of a folder."""
        known = self.spark.createDataFrame([(v,) for v in values], self.spark.read.parquet(self.path).select(self.id_col).schema)
        folders = [r[0] for r in known.select(_bucket(self.id_col, self.buckets)).distinct().collect()]
        return self.spark.read.parquet(self.path).filter(F.col("_cubo").isin(folders) & F.col(self.id_col).isin(list(values))).drop("_cubo")


def _bucket(id_col: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(buckets)).cast("int")


class TrigramIndex:
    """Which distinct values of a column hold a text, whatever the case: three letters at a time lead to the values that have them.

    The index is over distinct values, by hash of the trigram in folders, so a search opens as many folders as the text has trigrams;
    candidates are then compared whole. Texts of under three letters are compared with every value.
    """

    def __init__(self, spark: SparkSession, path: str, column: str, buckets: int):
        self.spark, self.path, self.column, self.buckets = spark, path, column, buckets

    @classmethod
    def build(cls, rows: DataFrame, column: str, buckets: int = 64, name: str = "trigrams") -> TrigramIndex:
        path = new_folder(rows.sparkSession, name)
        values = rows.select(F.col(column).alias("value")).filter("value is not null").distinct()
        values.write.parquet(f"{path}/values")
        found = rows.sparkSession.read.parquet(f"{path}/values")
        grams = found.select("value", F.explode(_trigrams(F.lower("value"))).alias("gram")).withColumn("_cubo", _bucket("gram", buckets))
        grams.repartition(buckets, "_cubo").sortWithinPartitions("_cubo", "gram").write.partitionBy("_cubo").parquet(f"{path}/grams")
        return cls(rows.sparkSession, path, column, buckets)

    def holding(self, text: str) -> DataFrame:
        """The values that contain text, as a column named like the one indexed."""
        needle = text.lower()
        grams = sorted({needle[k : k + 3] for k in range(len(needle) - 2)})
        if grams:
            asked = self.spark.createDataFrame([(g,) for g in grams], "gram string")
            folders = [r[0] for r in asked.select(_bucket("gram", self.buckets)).distinct().collect()]
            hits = self.spark.read.parquet(f"{self.path}/grams").filter(F.col("_cubo").isin(folders) & F.col("gram").isin(grams))
            values = hits.groupBy("value").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select("value")
        else:
            values = self.spark.read.parquet(f"{self.path}/values")
        return values.filter(F.contains(F.lower("value"), F.lit(needle))).select(F.col("value").alias(self.column))


def _trigrams(text: Column) -> Column:
    """The distinct runs of three characters; none of a shorter text."""
    starts = F.when(F.length(text) >= 3, F.sequence(F.lit(1), F.length(text) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda k: F.substring(text, k, F.lit(3))))
