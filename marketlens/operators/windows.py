"""Period-over-period measures on month calendars, shares, and changes between snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.parse import change_percent
from marketlens.sources.shared import materialise


def kpi_vs_previous(df: DataFrame, first: date, last: date, day: str = "fecha", measure: str = "cantidad") -> DataFrame:
    """The measure's sum from first to last, that of the equally long period before, and the change in percent."""
    before = first - (last - first) - timedelta(days=1)
    now, was = (F.sum(F.when(F.col(day).between(F.lit(a), F.lit(b)), F.col(measure))) for a, b in ((first, last), (before, first - timedelta(days=1))))
    rows = df.filter(F.col(day).between(F.lit(before), F.lit(last)))
    return rows.agg(now.alias("actual"), was.alias("anterior")).withColumn("variacion", F.round(change_percent(F.col("actual").cast("double"), F.col("anterior")), 4))


def monthly(df: DataFrame, by: Sequence[str] = (), measure: str = "cantidad", day: str = "fecha") -> DataFrame:
    """Sums by month and group: mes, the groups, total."""
    return df.groupBy(F.trunc(day, "MM").alias("mes"), *by).agg(F.sum(measure).cast("bigint").alias("total"))


def on_calendar(months: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds the months without rows (total null) between a group's first and last, so that lags count months."""
    span = months.groupBy(*by).agg(F.min("mes").alias("a"), F.max("mes").alias("z"))
    days = span.filter("a is not null").select(*by, F.explode(F.sequence("a", "z", F.expr("interval 1 month"))).alias("mes"))
    if not by:
        return days.join(months, "mes", "left")
    there = months.select(*(F.col(c).alias(f"_{c}") for c in ("mes", *by)), "total")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("mes", *by)]
    return days.join(there, same, "left").select("mes", *by, "total")


def growth(df: DataFrame, lag: int, name: str, by: Sequence[str] = (), measure: str = "cantidad") -> DataFrame:
    """Monthly sums, those of `lag` months before, and the change in percent: 12 for year on year, 1 for month on month."""
    full = on_calendar(materialise(monthly(df, by, measure), "months"), by)  # a row a month and group, read more than once
    order = Window.partitionBy(*by).orderBy("mes") if by else Window.partitionBy(F.lit(0)).orderBy("mes")  # a row a month
    was = full.withColumn("anterior", F.lag("total", lag).over(order)).filter("total is not null")
    return was.withColumn(name, F.round(change_percent(F.col("total").cast("double"), F.col("anterior")), 4))


def year_to_date(df: DataFrame, by: Sequence[str] = (), measure: str = "cantidad") -> DataFrame:
    """Cumulative sums within each year, and the change against the same month's of the year before."""
    months = materialise(monthly(df, by, measure), "months").withColumn("anio", F.year("mes"))
    so_far = Window.partitionBy("anio", *by).orderBy("mes").rowsBetween(Window.unboundedPreceding, 0)
    now = months.select("mes", *by, F.sum("total").over(so_far).alias("acumulado"))
    was = now.select(F.add_months("mes", 12).alias("_mes"), *(F.col(c).alias(f"_{c}") for c in by), F.col("acumulado").alias("anterior"))
    same = [now["mes"] == was["_mes"], *(now[c].eqNullSafe(was[f"_{c}"]) for c in by)]
    found = now.join(was, same, "left").select("mes", *by, "acumulado", "anterior")
    return found.withColumn("variacion", F.round(change_percent(F.col("acumulado").cast("double"), F.col("anterior")), 4))


def cap_per_group(df: DataFrame, group: str, cap: int, order: Sequence[Column | str]) -> DataFrame:
    """The first `cap` rows of each group, in order."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("posicion", place).filter(F.col("posicion") <= cap)


def market_share(df: DataFrame, by: str = "marca", measure: str = "cantidad") -> DataFrame:
    """Each brand's share of its month, in percent, and its rank."""
    months = monthly(df.filter(F.col(by).isNotNull()), [by], measure)
    month = Window.partitionBy("mes")
    share = F.round(100.0 * F.col("total") / F.sum("total").over(month), 4)
    return months.select("mes", by, "total", share.alias("participacion"), F.dense_rank().over(month.orderBy(F.desc("total"))).alias("puesto"))


def rolling_mean(df: DataFrame, by: Sequence[str] = ("marca",), months: int = 3, measure: str = "cantidad") -> DataFrame:
    """Monthly sums and their mean over the month and those before it that have rows."""
    rows = monthly(df, by, measure)
    frame = Window.partitionBy(*by).orderBy("mes").rowsBetween(1 - months, 0)
    return rows.withColumn("media_movil", F.round(F.avg("total").over(frame), 4))


def price_changes(df: DataFrame) -> DataFrame:
    """Listings whose price differs from that of their snapshot before."""
    order = Window.partitionBy("meli_id").orderBy("fecha_snapshot")
    was = df.select("meli_id", "fecha_snapshot", "precio", F.lag("precio").over(order).alias("precio_anterior"))
    changed = was.filter(F.col("precio_anterior").isNotNull() & (F.col("precio") != F.col("precio_anterior")))
    change = F.round(change_percent(F.col("precio").cast("double"), F.col("precio_anterior").cast("double")), 4)
    return changed.select("meli_id", "fecha_snapshot", F.col("precio").cast("double").alias("precio"), F.col("precio_anterior").cast("double").alias("precio_anterior"), change.alias("variacion"))
