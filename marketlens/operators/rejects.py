"""Rows that can't be used, kept with the reason: readers mark them, split() parts and counts them in the one pass that writes the batch.

A marked frame has two more columns: REASON, the first reason that holds (null for a good row), and RAW, what was read, as text.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from marketlens.sources.shared import new_folder

REASON, RAW = "_motivo", "_fila"


def marked(rows: DataFrame, reasons: Mapping[str, Column], raw: Column) -> DataFrame:
    """rows with the first of the reasons that holds, and what was read of those rows; a reason that is null doesn't hold."""
    found = F.coalesce(*(F.when(holds, F.lit(name)) for name, holds in reasons.items()), F.lit(None).cast("string"))
    return rows.withColumn(REASON, found).withColumn(RAW, F.when(F.col(REASON).isNotNull(), raw))


def good(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col(REASON).isNull()).drop(REASON, RAW)


def unmarked(rows: DataFrame) -> DataFrame:
    """Rows of a reader that marks none, as a marked frame."""
    none = F.lit(None).cast("string")
    return rows if REASON in rows.columns else rows.withColumns({REASON: none, RAW: none})


@dataclass(frozen=True)
class Parts:
    """What split() wrote: the good rows, the rejected ones' REASON and RAW, how many of both were read, and the folder."""

    good: DataFrame
    bad: DataFrame
    read: int
    rejected: int
    folder: str


def split(rows: DataFrame, name: str) -> Parts:
    """A marked frame, written once in two folders; the counts are observed while it is written, the source is read once."""
    spark, path, seen = rows.sparkSession, new_folder(rows.sparkSession, name), Observation(name)
    counted = rows.observe(seen, F.count("*").alias("read"), F.count_if(F.col(REASON).isNotNull()).alias("rejected"))
    bad = F.col(REASON).isNotNull().cast("int")
    counted.withColumn("_bad", bad).write.partitionBy("_bad").option("compression", "zstd").parquet(path)
    back = spark.read.schema(StructType([*rows.schema, StructField("_bad", IntegerType())])).parquet(path)
    numbers = seen.get
    return Parts(back.filter("_bad = 0").drop("_bad", REASON, RAW), back.filter("_bad = 1").select(REASON, RAW), numbers["read"], numbers["rejected"], path)
