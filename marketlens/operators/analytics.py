"""Forecasts, anomalies, correlation and seasonality, by grouped aggregates over monthly frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.operators.windows import monthly
from marketlens.sources.shared import materialise

HORIZON, MIN_POINTS, Z95, UNUSUAL, BASELINE = 12, 24, 1.96, 3.0, 12


def forecast(df: DataFrame, by: str = "marca", horizon: int = HORIZON, min_points: int = MIN_POINTS) -> DataFrame:
    """By series: a linear trend plus the mean residual of each month of the year, with a 95 % interval."""
    months = materialise(monthly(df.filter(F.col(by).isNotNull()), [by]), "months")  # a row a month and series, read more than once
    points = months.select(by, "mes", F.month("mes").alias("m"), (F.year("mes") * 12 + F.month("mes")).cast("double").alias("x"), F.col("total").cast("double").alias("y"))
    fit = points.groupBy(by).agg(F.regr_slope("y", "x").alias("pendiente"), F.regr_intercept("y", "x").alias("origen"), F.max("mes").alias("ultimo"), F.count("*").alias("n")).filter(F.col("n") >= min_points)
    left = points.join(fit, by).withColumn("r", F.col("y") - F.col("origen") - F.col("pendiente") * F.col("x"))
    season = left.groupBy(by, "m").agg(F.avg("r").alias("efecto"))
    noise = left.join(season, [by, "m"]).groupBy(by).agg(F.stddev_samp(F.col("r") - F.col("efecto")).alias("sigma"))
    ahead = fit.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("mes", F.add_months("ultimo", F.col("k")))
    ahead = ahead.withColumn("m", F.month("mes")).join(season, [by, "m"], "left").join(noise, by)
    value = F.col("origen") + F.col("pendiente") * (F.year("mes") * 12 + F.month("mes")) + F.coalesce("efecto", F.lit(0.0))
    return ahead.select(by, "mes", F.round(value, 3).alias("pronostico"), F.round(value - Z95 * F.col("sigma"), 3).alias("minimo"), F.round(value + Z95 * F.col("sigma"), 3).alias("maximo"))


def anomalies(df: DataFrame, by: str = "marca", limit: float = UNUSUAL) -> DataFrame:
    """Months further than `limit` standard deviations from the mean of the series' twelve months before."""
    months = monthly(df.filter(F.col(by).isNotNull()), [by])
    before = Window.partitionBy(by).orderBy("mes").rowsBetween(-BASELINE, -1)
    z = (F.col("total") - F.avg("total").over(before)) / F.nullif(F.stddev_samp("total").over(before), F.lit(0.0))
    full = F.count("total").over(before) == BASELINE
    return months.withColumn("z", F.when(full, F.round(z, 4))).filter(F.abs("z") > limit)


def lagged_correlation(df: DataFrame, macro: DataFrame, lags: int = 6) -> DataFrame:
    """Correlation of monthly registrations with each series' monthly mean 0 to `lags` months before."""
    units = monthly(df).select("mes", F.col("total").cast("double").alias("y"))
    rates = macro.groupBy(F.trunc("fecha", "MM").alias("desde"), "indicador").agg(F.avg("valor").cast("double").alias("x"))
    moved = rates.withColumn("rezago", F.explode(F.sequence(F.lit(0), F.lit(lags)))).withColumn("mes", F.add_months("desde", F.col("rezago")))
    return moved.join(units, "mes").groupBy("indicador", "rezago").agg(F.count("*").alias("meses"), F.round(F.corr("x", "y"), 4).alias("correlacion"))


def seasonality(df: DataFrame) -> DataFrame:
    """Mean of each month of the year over the mean of all months."""
    months = monthly(df)
    by_month = months.groupBy(F.month("mes").alias("mes_del_anio")).agg(F.avg("total").alias("media"), F.sum("total").alias("s"), F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))  # twelve rows
    overall = F.sum("s").over(every) / F.sum("n").over(every)
    return by_month.select("mes_del_anio", F.round("media", 4).alias("media"), F.round(F.col("media") / overall, 4).alias("indice"))

