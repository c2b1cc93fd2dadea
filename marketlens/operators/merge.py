"""Keyed, idempotent merges of a batch into a table, and what they did."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.operators.rejects import REASON


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Of rows with equal keys the last in the order given; null keys are equal."""
    last = Window.partitionBy(*keys).orderBy(*(F.desc(c) if isinstance(c, str) else c for c in order))
    return df.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def merge_upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], compare: Sequence[str], set_columns: Sequence[str] | None = None, as_of: datetime | None = None) -> DataFrame:
    """The table after the merge, and in `action` what happened to each row: insert, update, unchanged or kept.

    Keys of both sides are unique (see dedupe_last) and match null-safely. A row is updated if one of `compare` differs;
    then `set_columns` (the compared ones, if not given) take the batch's values. With as_of, `updated_at` is set for
    inserts and updates. A replay changes nothing.
    """
    set_columns = list(set_columns or compare)
    t, b = target.withColumn("_t", F.lit(True)).alias("t"), batch.withColumn("_b", F.lit(True)).alias("b")
    same_key = reduce(and_, (F.col(f"t.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))
    both = t.join(b, same_key, "full_outer")
    differs = reduce(or_, (~F.col(f"t.{c}").eqNullSafe(F.col(f"b.{c}")) for c in compare))
    action = F.when(F.col("_t").isNull(), "insert").when(F.col("_b").isNull(), "kept").when(differs, "update").otherwise("unchanged")
    in_batch = set(batch.columns)

    def column(c: str) -> Column:
        if c == "updated_at" and as_of is not None:
            return F.when(action.isin("insert", "update"), F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("t.updated_at")).alias(c)
        if c not in in_batch:
            return F.col(f"t.{c}").alias(c)
        taken = F.lit("insert") if c not in set_columns else None
        new = (action == taken) if taken is not None else action.isin("insert", "update")
        return F.when(new, F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")).alias(c)

    return both.select(*(column(c) for c in target.columns), action.alias("action"))


def merge_last(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str], compare: Sequence[str], set_columns: Sequence[str], as_of: datetime) -> DataFrame:
    """merge_upsert() of the last row of each key of a batch (see dedupe_last), in one shuffle of both sides by key.

    The batch has the target's columns, and may have more to order by."""
    more = [f for f in batch.schema if f.name not in target.columns]
    stored = target.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in more), F.lit(False).alias("_b"))
    near = Window.partitionBy(*keys).orderBy("_b", *(F.desc(c) for c in order))  # the stored row, then the batch's from the last on
    rows = stored.unionByName(batch.withColumn("_b", F.lit(True)))
    before = (F.lag(c).over(near).alias(f"_t_{c}") for c in ("_b", *target.columns))  # one by one, as a struct would be made before the shuffle
    rows = rows.select("*", F.row_number().over(near).alias("_n"), F.lead("_b").over(near).alias("_next"), *before)
    matched = F.col("_b") & (F.col("_n") == 2) & ~F.col("_t__b")
    rows = rows.withColumn("_both", F.coalesce(matched, F.lit(False))).filter(F.when(F.col("_b"), (F.col("_n") == 1) | F.col("_both")).otherwise(F.col("_next").isNull()))
    differs = reduce(or_, (~F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in compare))
    action = F.when(~F.col("_b"), "kept").when(~F.col("_both"), "insert").when(differs, "update").otherwise("unchanged")

    def column(c: str) -> Column:
        if c == "updated_at":
            return F.when(action.isin("insert", "update"), F.lit(as_of).cast("timestamp_ntz")).when(F.col("_both"), F.col("_t_updated_at")).otherwise(F.col(c)).alias(c)
        old = (action == "unchanged") if c in set_columns else F.col("_both")
        return F.when(old, F.col(f"_t_{c}")).otherwise(F.col(c)).alias(c)

    return rows.select(*(column(c) for c in target.columns), action.alias("action"))


def summary(raw: DataFrame, batch: DataFrame, merged: DataFrame, day: str = "fecha") -> DataFrame:
    """One row: rows read and rejected (those that raw marks with a reason), duplicates among the others, what was done with the rest, and the dates covered."""
    refused = F.count_if(F.col(REASON).isNotNull()) if REASON in raw.columns else F.lit(0).cast("bigint")
    kept = batch.agg(F.count("*")).scalar()
    names = {"insert": "insertados", "update": "actualizados", "unchanged": "sin_cambios", "kept": "conservados"}
    done = merged.agg(F.struct(*(F.count_if(F.col("action") == a).alias(name) for a, name in names.items()))).scalar()
    read = raw.agg(F.count("*").alias("leidos"), F.min(day).alias("desde"), F.max(day).alias("hasta"), refused.alias("rechazados"))
    one = read.select("*", kept.alias("unicos"), done.alias("d")).select("leidos", "desde", "hasta", "unicos", "rechazados", "d.*")
    return one.withColumn("duplicados", F.col("leidos") - F.col("rechazados") - F.col("unicos")).withColumn("estado", F.when(F.col("leidos") > 0, "success").otherwise("no_data"))


def with_fallback(primary: Sequence[DataFrame], other: DataFrame) -> DataFrame:
    """The rows of all primary sources; those of the other one only if the primary sources have none at all, or rejected ones alone."""
    first = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), primary)
    usable = first.filter(F.col(REASON).isNull()) if REASON in first.columns else first
    found = usable.limit(1).agg(F.count("*")).scalar()
    return first.unionByName(other.filter(found == 0), allowMissingColumns=True)
