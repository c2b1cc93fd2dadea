"""The four composite indicators and what belongs to them, from the stored tables or from their roll-ups by month (see rollups)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marketlens.functions.parse import instalment
from marketlens.operators import rollups
from marketlens.operators.asof import as_of
from marketlens.operators.windows import growth, monthly
from marketlens.sources.shared import materialise

#: Weights of the demand indicator's parts.
DEMAND = {"registros": 0.5, "tasa": -0.3, "interes": 0.2}
MONTHS_TO_PAY, OVERSTOCK_DAYS, SPREAD = 36, 90, 1.0


def _all() -> WindowSpec:
    """One window over a frame of one row a month, or a brand."""
    return Window.partitionBy(F.lit(0))


def _z(c: str) -> Column:
    return (F.col(c) - F.avg(c).over(_all())) / F.nullif(F.stddev_samp(c).over(_all()), F.lit(0.0))


def _rolled(rows: DataFrame, table: str) -> DataFrame:
    """A table's roll-up by month; one that is rolled up already stays."""
    return rows if "suma" in rows.columns else rollups.ROLLED[table](rows)


def _mean() -> Column:
    return F.col("suma").cast("double") / F.col("n")


def rate_by_month(macro: DataFrame, series: str) -> DataFrame:
    return _rolled(macro, "macro").filter((F.col("indicador") == series) & (F.col("n") > 0)).select(F.col("fecha").alias("mes"), _mean().alias("tasa"))


def demand_tension(registrations: DataFrame, macro: DataFrame, interest: DataFrame, series: str = "tasa_badlar") -> DataFrame:
    """By month: 0.5 z(year-on-year registrations) - 0.3 z(change of the rate) + 0.2 z(search interest).

    Parts that are missing are left out and the others' weights made up for; `confianza` is the part of parts there."""
    units = growth(registrations.filter("tipo_vehiculo = '0km'"), 12, "interanual").select("mes", F.col("interanual").alias("registros"))
    rate = rate_by_month(macro, series)
    before = rate.select(F.add_months("mes", 1).alias("mes"), F.col("tasa").alias("antes"))
    change = rate.join(before, "mes", "left").select("mes", (F.col("tasa") - F.col("antes")).alias("tasa"))
    seen = interest.groupBy(F.trunc("fecha", "MM").alias("mes")).agg(F.sum("busquedas").cast("double").alias("interes"))
    months = units.join(change, "mes", "left").join(seen, "mes", "left")
    z = months.select("mes", *(_z(c).alias(c) for c in DEMAND))
    total = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in DEMAND.items()), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNotNull(), abs(w)).otherwise(0.0) for c, w in DEMAND.items()), F.lit(0.0))
    there = sum((F.col(c).isNotNull().cast("int") for c in DEMAND), F.lit(0))
    out = z.select("mes", *(F.round(c, 4).alias(c) for c in DEMAND), F.round(total / F.nullif(weight, F.lit(0.0)), 4).alias("valor"), F.round(there / 3, 4).alias("confianza"))
    return out


def stock_rotation(production: DataFrame, registrations: DataFrame) -> DataFrame:
    """By brand and month: stock is the running sum of units produced for the home market less those registered new."""
    return days_of_stock(rollups.stock(rollups.flows(production, registrations)))


def days_of_stock(stock: DataFrame) -> DataFrame:
    """rollups.stock() with the days that the stock lasts at the month's pace."""
    stock = stock.withColumnRenamed("fecha", "mes")
    days = F.col("stock") * F.dayofmonth(F.last_day("mes")) / F.nullif(F.col("vendidas"), F.lit(0)).cast("double")
    return stock.withColumn("dias_stock", F.round(days, 4))


def overstock_flags(rotation: DataFrame) -> DataFrame:
    """Months with over 90 days of stock, or over a standard deviation above the brand's mean."""
    brand = Window.partitionBy("marca")
    high = F.avg("dias_stock").over(brand) + SPREAD * F.stddev_samp("dias_stock").over(brand)
    marked = rotation.withColumn("limite", F.round(high, 4))
    return marked.filter((F.col("dias_stock") > OVERSTOCK_DAYS) | (F.col("dias_stock") > F.col("limite"))).select("mes", "marca", "stock", "dias_stock", "limite")


def affordability(listings: DataFrame, wages: DataFrame, macro: DataFrame, series: str = "tasa_pf_30_dias") -> DataFrame:
    """By month: the instalment of the mean new listing at the month's last known rate, and the wage as a percentage of it."""
    sums = _rolled(listings, "listings").groupBy(F.col("fecha").alias("mes")).agg(F.sum("suma").alias("suma"), F.sum("n").alias("n")).filter("n > 0")
    price = sums.select("mes", _mean().alias("precio"))
    rates = _rolled(macro, "macro").filter("ultimo is not null")
    wage = wages.groupBy(F.trunc("fecha", "MM").alias("mes")).agg(F.avg("salario").cast("double").alias("salario"))
    asked = materialise(price.join(wage, "mes", "left").withColumns({"_dia": F.last_day("mes"), "indicador": F.lit(series)}), "months")  # read more than once
    months = as_of(asked, rates, ["indicador"], "_dia", "ultimo_dia", ["ultimo"])
    known = F.col("ultimo").cast("double")
    cost = instalment(F.col("precio"), known, MONTHS_TO_PAY)
    return months.select("mes", F.round("precio", 4).alias("precio"), F.round("salario", 4).alias("salario"), F.round(known, 4).alias("tasa"), F.round(cost, 4).alias("cuota"), F.round(100 * F.col("salario") / cost, 4).alias("indice"))


def interest_index(interest: DataFrame, by: tuple[str, ...] = ("fecha", "marca"), within: tuple[str, ...] = ("marca",)) -> DataFrame:
    """Searches as a percentage of the largest number within the group."""
    sums = interest.groupBy(*by).agg(F.sum("busquedas").cast("bigint").alias("busquedas"))
    top = F.max("busquedas").over(Window.partitionBy(*within) if within else _all())
    return sums.withColumn("indice", F.round(100.0 * F.col("busquedas") / F.nullif(top, F.lit(0)), 4))


def attention_ranking(interest: DataFrame, listings: DataFrame) -> DataFrame:
    """Brands by half their search index and half their index of active listings."""
    searched = interest.groupBy("marca").agg(F.sum("busquedas").cast("bigint").alias("busquedas"))
    listed = _rolled(listings, "listings").filter("marca is not null").groupBy("marca").agg(F.sum("activas").cast("bigint").alias("activas")).filter("activas > 0")
    both = searched.join(listed, "marca", "full_outer").na.fill(0, ["busquedas", "activas"])  # a row a brand
    parts = [50.0 * F.col(c) / F.nullif(F.max(c).over(_all()), F.lit(0)) for c in ("busquedas", "activas")]
    scored = both.withColumn("puntaje", F.round(F.coalesce(parts[0], F.lit(0.0)) + F.coalesce(parts[1], F.lit(0.0)), 4))
    return scored.withColumn("puesto", F.dense_rank().over(_all().orderBy(F.desc("puntaje"))))


def production_vs_demand(production: DataFrame, registrations: DataFrame) -> DataFrame:
    made = production.groupBy(F.trunc("fecha", "MM").alias("mes")).agg(F.sum(F.col("unidades_producidas") - F.col("unidades_exportadas")).cast("bigint").alias("internas"))
    sold = monthly(registrations.filter("tipo_vehiculo = '0km'")).withColumnRenamed("total", "vendidas")
    return made.join(sold, "mes", "full_outer").withColumn("razon", F.round(F.col("internas").cast("double") / F.nullif(F.col("vendidas"), F.lit(0)), 4))


def as_records(values: DataFrame, name: str, unit: str, parts: list[str], brand: str | None = None) -> DataFrame:
    """Indicator rows in the stored long form, the parts kept as JSON."""
    there = sum((F.col(c).isNotNull().cast("int") for c in parts), F.lit(0)) / len(parts)
    details = F.to_json(F.struct(F.struct(*parts).alias("componentes"), F.round(there, 4).alias("confianza")))
    return values.filter("valor is not null").select(
        F.col("mes").alias("fecha"), F.date_format("mes", "yyyy-MM").alias("periodo"), F.lit(name).alias("indicador"), (F.col(brand) if brand else F.lit(None).cast("string")).alias("marca"),
        F.lit(None).cast("string").alias("segmento"), F.col("valor").cast("decimal(18,4)").alias("valor"), details.alias("detalles"), F.lit(None).cast("string").alias("descripcion"), F.lit(unit).alias("unidad"),
    )
