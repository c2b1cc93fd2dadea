"""Filters, listings, rankings and summaries of the stored tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Options that stand for no filter.
ALL = ("Todos", "Todas")


def given(value: Any) -> bool:
    """None, the empty string and an `all` option switch a filter off."""
    return value not in (None, "", *ALL)


def where(df: DataFrame, *terms: tuple[Any, Column]) -> DataFrame:
    """Keeps rows for which every column holds whose value is given."""
    on = [column for value, column in terms if given(value)]
    return df.filter(reduce(and_, on)) if on else df


def between(column: str, first: Any = None, last: Any = None) -> list[tuple[Any, Column]]:
    return [(first, F.col(column) >= F.lit(first)), (last, F.col(column) <= F.lit(last))]


def like(column: str, text: str | None) -> tuple[Any, Column]:
    """Contains, whatever the case; % and _ of the text are wildcards."""
    return text, F.col(column).ilike(f"%{text}%")


def equals(column: str, value: Any) -> tuple[Any, Column]:
    return value, F.col(column) == F.lit(value)


def latest(df: DataFrame, column: str, limit: int, ties: Sequence[str]) -> DataFrame:
    """The newest rows; ties go by the other columns, so that the result is fixed."""
    return df.orderBy(F.desc(column), *(F.col(c).asc_nulls_last() for c in ties)).limit(limit)


def registrations_list(df: DataFrame, first: Any = None, last: Any = None, brand: str | None = None, kind: str | None = None, limit: int = 100) -> DataFrame:
    found = where(df, *between("fecha", first, last), like("marca", brand), equals("tipo_vehiculo", kind))
    return latest(found.select("fecha", "marca", "modelo", "tipo_vehiculo", "cantidad", "fuente"), "fecha", limit, ["marca", "modelo", "tipo_vehiculo", "fuente", "cantidad"])


def production_list(df: DataFrame, first: Any = None, last: Any = None, terminal: str | None = None, limit: int = 100) -> DataFrame:
    found = where(df, *between("fecha", first, last), like("terminal", terminal))
    return latest(found.select("fecha", "terminal", "unidades_producidas", "unidades_exportadas"), "fecha", limit, ["terminal"])


def macro_list(df: DataFrame, first: Any = None, last: Any = None, series: str | None = None, limit: int = 100) -> DataFrame:
    found = where(df, *between("fecha", first, last), equals("indicador", series))
    return latest(found.select("fecha", "indicador", F.col("valor").cast("double").alias("valor"), "unidad"), "fecha", limit, ["indicador"])


def listings_list(df: DataFrame, snapshot: Any = None, brand: str | None = None, condition: str | None = None, limit: int = 100) -> DataFrame:
    found = where(df, equals("fecha_snapshot", snapshot), like("marca", brand), equals("condicion", condition))
    shown = found.select("meli_id", "fecha_snapshot", "marca", "modelo", "anio", F.col("precio").cast("double").alias("precio"), "moneda", "condicion", "url")
    return latest(shown, "fecha_snapshot", limit, ["meli_id", "precio"])


def indicators_list(df: DataFrame, first: Any = None, last: Any = None, name: str | None = None, brand: str | None = None, limit: int = 100) -> DataFrame:
    found = where(df, *between("fecha", first, last), equals("indicador", name), like("marca", brand))
    return latest(found.select("fecha", "indicador", "marca", F.col("valor").cast("double").alias("valor"), "detalles"), "fecha", limit, ["indicador", "marca"])


def listing_search(
    df: DataFrame, brand: str | None = None, model: str | None = None, year_from: int | None = None, year_to: int | None = None, condition: str | None = None,
    max_price: float | None = None, state: str | None = None, limit: int = 50, offset: int = 0,
) -> DataFrame:
    """A page of the cheapest listings; pages have 50 rows at most."""
    found = where(
        df, like("marca", brand), like("modelo", model), (year_from, F.col("anio") >= F.lit(year_from)), (year_to, F.col("anio") <= F.lit(year_to)),
        equals("condicion", condition), (max_price, F.col("precio") <= F.lit(max_price)), equals("provincia", state),
    )
    return found.orderBy("precio", "meli_id", "fecha_snapshot").offset(offset).limit(min(limit, 50))


def options(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Distinct values that aren't null, in order."""
    found = df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)
    return found.limit(limit) if limit else found


def top_brands(df: DataFrame, first: date | None = None, last: date | None = None, kind: str = "0km", n: int = 10, as_of: date | None = None, nulls: bool = True) -> DataFrame:
    """Brands by units in a period, by default the 30 days up to as_of; rows without a brand are a group, or left out."""
    last = last or as_of
    first = first or (last - timedelta(days=30) if last else None)
    found = where(df, *between("fecha", first, last), equals("tipo_vehiculo", kind))
    found = found if nulls else found.filter("marca is not null")
    return found.groupBy("marca").agg(F.sum("cantidad").alias("total")).orderBy(F.desc("total"), F.col("marca").asc_nulls_last()).limit(n)


def totals(df: DataFrame, by: Sequence[str], column: str = "cantidad", name: str = "total") -> DataFrame:
    return df.groupBy(*by).agg(F.sum(column).alias(name))


def top_counts(df: DataFrame, by: Sequence[str], n: int, name: str = "cantidad") -> DataFrame:
    """The n most frequent combinations without nulls."""
    found = df.dropna(subset=list(by)).groupBy(*by).agg(F.count("*").alias(name))
    return found.orderBy(F.desc(name), *by).limit(n)


def mean(column: str) -> Column:
    """The mean of a decimal column, to full precision."""
    return F.sum(column).cast("double") / F.count(column)


def listing_kpis(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("publicaciones"), mean("precio").alias("precio_promedio"), F.countDistinct("marca").alias("marcas"))


def histogram(df: DataFrame, column: str = "precio", bins: int = 50) -> DataFrame:
    """Equal bins from the least to the largest value; the largest falls into the last one. Empty bins have no row."""
    value = F.col(column).cast("double")
    edges = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    rows = df.filter(F.col(column).isNotNull()).select(value.alias("x"), edges.alias("e"))
    width = (F.col("e.hi") - F.col("e.lo")) / bins
    at = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("x") - F.col("e.lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
    dealt = rows.select(at.cast("int").alias("bin"), F.col("e.lo").alias("lo"), width.alias("width"))
    return dealt.groupBy("bin").agg(F.count("*").alias("cantidad"), F.round(F.min(F.col("lo") + F.col("bin") * F.col("width")), 4).alias("desde"))


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.lit(name).alias("tabla"), F.count("*").alias("filas")) for name, df in tables.items()]
    return reduce(DataFrame.unionAll, counts)


def listings_by_condition(df: DataFrame) -> DataFrame:
    return df.groupBy("marca").agg(F.count_if(F.col("condicion") == "new").alias("nuevos"), F.count_if(F.col("condicion") == "used").alias("usados"), F.count("*").alias("total"))


def price_ranking(df: DataFrame) -> DataFrame:
    """Mean, exact median and largest price of brands, currencies apart; equal prices are counted before they meet."""
    found = df.filter("marca is not null").groupBy("marca", "moneda")
    middle = F.round(F.percentile(F.col("precio").cast("double"), 0.5), 4)
    return found.agg(F.count("*").alias("publicaciones"), mean("precio").alias("precio_promedio"), middle.alias("precio_mediano"), F.max("precio").cast("double").alias("precio_maximo"))


def price_trend(df: DataFrame) -> DataFrame:
    found = df.groupBy("fecha_snapshot", "moneda")
    return found.agg(F.count("*").alias("publicaciones"), mean("precio").alias("precio_promedio"))


def macro_monthly(df: DataFrame) -> DataFrame:
    """Mean and last value of each series in each month."""
    found = df.groupBy(F.trunc("fecha", "MM").alias("mes"), "indicador")
    return found.agg(mean("valor").alias("promedio"), F.max_by("valor", "fecha").cast("double").alias("ultimo"))


def weekly(df: DataFrame, column: str = "fecha", measure: str = "valor") -> DataFrame:
    found = df.groupBy(F.date_trunc("week", column).cast("date").alias("semana"), "indicador")
    return found.agg(F.count("*").alias("dias"), mean(measure).alias("promedio"))


def latest_values(df: DataFrame) -> DataFrame:
    """The last value of each series."""
    return df.groupBy("indicador").agg(F.max("fecha").alias("fecha"), F.max_by("valor", "fecha").cast("double").alias("valor"))
