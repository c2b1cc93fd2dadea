"""Stored tables summed up by month: what the indicators need of them, small enough to be read whole, and the state of the daily job.

A roll-up of some months depends on these months' rows alone, so after a load only the months that it touched are read again.
The stock is the exception: it runs on from the month before the first touched one, whose closing stock is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _month() -> Column:
    return F.trunc("fecha", "MM").alias("fecha")


def registrations(rows: DataFrame) -> DataFrame:
    return rows.groupBy(_month(), "tipo_vehiculo", "marca").agg(F.sum("cantidad").cast("bigint").alias("cantidad"))


def production(rows: DataFrame) -> DataFrame:
    return rows.groupBy(_month(), "terminal").agg(*(F.sum(c).cast("bigint").alias(c) for c in ("unidades_producidas", "unidades_exportadas")))


def macro(rows: DataFrame) -> DataFrame:
    """Sum and number of the month's values, its last day and the value of that."""
    found = rows.groupBy(_month(), "indicador").agg(F.sum("valor").alias("suma"), F.count("valor").alias("n"), F.max(F.struct("fecha", "valor")).alias("ultimo"))
    return found.select("fecha", "indicador", F.col("suma").cast("decimal(28,4)").alias("suma"), "n", F.col("ultimo.fecha").alias("ultimo_dia"), F.col("ultimo.valor").cast("decimal(18,4)").alias("ultimo"))


def listings(rows: DataFrame) -> DataFrame:
    """By brand: sum and number of the prices of new vehicles, and active listings."""
    new, day = F.when(F.col("condicion") == "new", F.col("precio")), F.trunc("fecha_snapshot", "MM").alias("fecha")
    found = rows.groupBy(day, "marca").agg(F.sum(new).alias("suma"), F.count(new).alias("n"), F.count_if(F.col("estado") == "active").alias("activas"))
    return found.withColumn("suma", F.col("suma").cast("decimal(28,2)"))


ROLLED = {"registrations": registrations, "production": production, "macro": macro, "listings": listings}
SCHEMAS = {
    "registrations": "fecha DATE, tipo_vehiculo STRING, marca STRING, cantidad BIGINT",
    "production": "fecha DATE, terminal STRING, unidades_producidas BIGINT, unidades_exportadas BIGINT",
    "macro": "fecha DATE, indicador STRING, suma DECIMAL(28,4), n BIGINT, ultimo_dia DATE, ultimo DECIMAL(18,4)",
    "listings": "fecha DATE, marca STRING, suma DECIMAL(28,2), n BIGINT, activas BIGINT",
    "stock": "fecha DATE, marca STRING, internas BIGINT, vendidas BIGINT, stock BIGINT",
}


def flows(made: DataFrame, sold: DataFrame) -> DataFrame:
    """By month and brand: units made for the home market and new ones registered, of production and registrations, rolled up or not."""
    inner = made.groupBy(_month(), F.col("terminal").alias("marca")).agg(F.sum(F.col("unidades_producidas") - F.col("unidades_exportadas")).cast("bigint").alias("internas"))
    new = sold.filter("tipo_vehiculo = '0km' and marca is not null").groupBy(_month(), "marca").agg(F.sum("cantidad").cast("bigint").alias("vendidas"))
    return inner.join(new, ["fecha", "marca"], "full_outer").na.fill(0, ["internas", "vendidas"])


def stock(moved: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """flows() with the running stock of each brand, on top of what it had before: opening(marca, stock)."""
    so_far = Window.partitionBy("marca").orderBy("fecha").rowsBetween(Window.unboundedPreceding, 0)
    running = moved.withColumn("stock", F.sum(F.col("internas") - F.col("vendidas")).over(so_far))
    if opening is None:
        return running
    had = running.join(opening.select(F.col("marca").alias("_marca"), F.col("stock").alias("_stock")), F.col("marca").eqNullSafe(F.col("_marca")), "left")
    return had.select("fecha", "marca", "internas", "vendidas", (F.col("stock") + F.coalesce("_stock", F.lit(0))).alias("stock"))
