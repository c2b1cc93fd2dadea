"""As-of joins: for each row of one table the latest row of another at or before its moment, by any number of keys.

What is sought depends on keys and moment alone, so only distinct (keys, moment) points of the left table are looked up, however
many rows share one. Points and known rows are sorted together by range, each part fills forward within itself, and what
a part ends with is carried on to the parts after it; carrying needs one row a part and key, so no series goes through one
task. Rows of the left table are not sorted: they meet their point by an equality join, by broadcast where the points are few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.sources.shared import materialise

#: Points (some 50 bytes each) that may be broadcast; past that the join shuffles, and adaptive execution splits hot points.
BROADCAST_POINTS = 500_000
#: Rows of a range.
RANGE_ROWS = 1_000_000


def last_known(points: DataFrame, known: DataFrame, by: Sequence[str], at: str, ranges: int | None = None) -> DataFrame:
    """points(by, at), distinct, and known(by, at, value), unique by (by, at) -> by, at, value: that of the last known row up to at.

    Nulls in keys or moment match nothing."""
    there = [F.col(c).isNotNull() for c in (*by, at)]
    sought, found = points.select(*by, at), known.select(*by, at, F.struct(F.col(at).alias("at"), "value").alias("_known"))
    for c in there:
        sought, found = sought.filter(c), found.filter(c)
    both = materialise(found.withColumn("_asks", F.lit(False)).unionByName(sought.withColumns({"_known": F.lit(None), "_asks": F.lit(True)})), "asof-points")
    parts = ranges or max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), both.count() // RANGE_ROWS)
    dealt = materialise(both.repartitionByRange(parts, *by, at, "_asks").withColumn("_part", F.spark_partition_id()), "asof-ranges")
    # what each part ends with, by key, and the last of those before it
    ends = dealt.filter("not _asks").groupBy("_part", *by).agg(F.max("_known").alias("_end"))
    touched = dealt.select("_part", *by).distinct().join(ends, ["_part", *by], "left")
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = touched.select("_part", *by, F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    so_far = Window.partitionBy("_part", *by).orderBy(at, "_asks").rowsBetween(Window.unboundedPreceding, 0)
    filled = dealt.withColumn("_known", F.last("_known", ignorenulls=True).over(so_far)).filter("_asks").join(carried, ["_part", *by])
    best = F.coalesce("_known", "_carried")
    return filled.select(*by, at, best["at"].alias("_at"), best["value"].alias("_value"))


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], left_at: str, right_at: str, values: Sequence[str], found_at: str | None = None, ranges: int | None = None) -> DataFrame:
    """left with `values` of right's latest row with equal `by` and right_at <= left_at; found_at, if given, is that row's moment.

    Where several rows of right share keys and moment, the one with the greatest values is taken. Left rows without a match keep
    nulls; nulls in keys or moment match nothing. Left columns keep their names; values must not be among them.
    """
    known = right.groupBy(*by, F.col(right_at).alias("_when")).agg(F.max(F.struct(*values)).alias("value"))
    points = left.select(*by, F.col(left_at).alias("_when")).distinct()
    looked_up = materialise(last_known(points, known, by, "_when", ranges), "asof-found")
    few = looked_up.limit(BROADCAST_POINTS + 1).count() <= BROADCAST_POINTS
    asked = left.withColumn("_when", F.col(left_at)).join(F.broadcast(looked_up) if few else looked_up, [*by, "_when"], "left")
    moment = [F.col("_at").alias(found_at)] if found_at else []
    return asked.select(*left.columns, *moment, *(F.col("_value")[v].alias(v) for v in values))
