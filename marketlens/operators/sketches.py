"""Listings summed up by month, brand and currency in sketches that merge: counts, quantiles and distinct models of any range of months.

A range is answered from a row a month and group instead of its listings: sums and counts exactly, quantiles by KLL sketches (the rank is
off by under a hundredth in nearly all cases), distinct models by HyperLogLog (a few hundredths). The exact forms are in explore.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Precision of both kinds of sketch: values that a level of a KLL sketch keeps, and the logarithm of HyperLogLog's registers.
KLL_K, HLL_LOG = 400, 12


def by_month(listings: DataFrame) -> DataFrame:
    """mes, marca, moneda, n, precios (how many have one), suma, maximo, and the sketches of prices and models; null where there are no values."""
    price, month = F.col("precio").cast("double"), F.trunc("fecha_snapshot", "MM").alias("mes")
    sums = [F.count("*").alias("n"), F.count("precio").alias("precios"), F.sum(F.col("precio").cast("decimal(18,2)")).alias("suma"), F.max(price).alias("maximo")]
    return listings.groupBy(month, "marca", "moneda").agg(*sums, F.kll_sketch_agg_double(price, F.lit(KLL_K)).alias("kll"), F.hll_sketch_agg("modelo", F.lit(HLL_LOG)).alias("hll"))


def within(sketches: DataFrame, first: Any = None, last: Any = None) -> DataFrame:
    """The months from first to last."""
    for bound, keep in ((first, lambda d: F.col("mes") >= d), (last, lambda d: F.col("mes") <= d)):
        sketches = sketches.filter(keep(F.lit(bound).cast("date"))) if bound is not None else sketches
    return sketches


def _mean() -> Column:
    return F.sum("suma").cast("double") / F.nullif(F.sum("precios"), F.lit(0))


def price_ranking(sketches: DataFrame, quantile: float = 0.5) -> DataFrame:
    """Mean, a quantile (near) and largest price of brands, currencies apart."""
    found = sketches.filter("marca is not null").groupBy("marca", "moneda")
    merged = found.agg(F.sum("n").alias("publicaciones"), _mean().alias("precio_promedio"), F.kll_merge_agg_double("kll", F.lit(KLL_K)).alias("_kll"), F.max("maximo").alias("precio_maximo"), F.sum("precios").alias("_precios"))
    near = F.when(F.col("_precios") > 0, F.kll_sketch_get_quantile_double("_kll", F.lit(quantile)))
    return merged.select("marca", "moneda", "publicaciones", "precio_promedio", near.alias("precio_cuantil"), "precio_maximo")


def kpis(sketches: DataFrame) -> DataFrame:
    """Listings, mean price, brands, and models (near)."""
    return sketches.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("publicaciones"), _mean().alias("precio_promedio"), F.countDistinct("marca").alias("marcas"), F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("modelos"))
