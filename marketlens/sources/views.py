"""The stored tables as views of the given star schema."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Views:
    """registrations, production, macro, listings, interest, wages and interest_monthly of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, bounds: Mapping[str, tuple[date, date]] | None = None):
        self.spark, self.sf_dir, self.bounds = spark, sf_dir, dict(bounds or {})

    def within(self, column: str, first: date, end: date) -> Views:
        """The same views over rows of the given tables with first <= column < end only; the bounds reach the scan."""
        return Views(self.spark, self.sf_dir, self.bounds | {column: (first, end)})

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        for column, (first, end) in self.bounds.items():
            if column in df.columns:
                df = df.filter((F.col(column) >= F.lit(first)) & (F.col(column) < F.lit(end)))
        return df

    def _lines(self, orders: DataFrame | None = None) -> DataFrame:
        lines = self.table("lineitem").join(orders or self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        return lines.join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))

    @property
    def brand(self) -> Column:
        return F.when(F.col("p_partkey") % 50 != 0, F.col("p_brand"))

    @property
    def registrations(self) -> DataFrame:
        day = F.trunc(F.col("o_orderdate").cast("date"), "MM")
        return self._lines().select(
            day.alias("fecha"), F.year("o_orderdate").alias("anio"), F.month("o_orderdate").alias("mes"), F.when(F.col("l_returnflag") == "N", "0km").otherwise("usado").alias("tipo_vehiculo"),
            self.brand.alias("marca"), F.col("p_name").alias("modelo"), F.col("p_type").alias("segmento"), F.col("l_quantity").cast("int").alias("cantidad"),
            F.when(F.col("l_linestatus") == "F", "ACARA").otherwise("FACCARA").alias("fuente"),
        )

    @property
    def production(self) -> DataFrame:
        lines = self.table("lineitem").join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        units = F.col("l_quantity").cast("int")
        found = lines.groupBy(F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("fecha"), F.col("p_brand").alias("terminal"))
        return found.agg(F.sum(units).alias("unidades_producidas"), F.sum(F.when(F.col("l_returnflag") == "A", units).otherwise(0)).alias("unidades_exportadas"))

    @property
    def macro(self) -> DataFrame:
        series = F.when(F.col("l_returnflag") == "N", "tasa_badlar").when(F.col("l_returnflag") == "R", "tasa_pf_30_dias").otherwise("tasa_pf_90_dias")
        found = self.table("lineitem").groupBy(F.col("l_shipdate").cast("date").alias("fecha"), series.alias("indicador"))
        return found.agg(F.round(F.avg("l_discount") * 1000, 4).cast("decimal(18,4)").alias("valor"))

    @property
    def listings(self) -> DataFrame:
        placed = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        return self._lines(placed).select(  # orders, not their lines, are shuffled to the customers
            F.concat(F.lit("MLA"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("meli_id"), F.col("l_shipdate").cast("date").alias("fecha_snapshot"),
            self.brand.alias("marca"), F.col("p_name").alias("modelo"), F.year("o_orderdate").alias("anio"), F.col("l_extendedprice").cast("decimal(18,2)").alias("precio"),
            F.when(F.col("l_linestatus") == "F", "USD").otherwise("ARS").alias("moneda"),
            F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "P", "paused").otherwise("closed").alias("estado"),
            F.when(F.col("l_returnflag") == "N", "new").otherwise("used").alias("condicion"), F.col("n_name").alias("provincia"),
        )

    @property
    def interest(self) -> DataFrame:
        seen = self.table("events").filter(F.col("event_type").isin("view", "click"))
        brand = F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string"))
        return seen.groupBy(F.col("ts").cast("date").alias("fecha"), brand.alias("marca")).agg(F.count("*").alias("busquedas"))

    @property
    def wages(self) -> DataFrame:
        rows = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return rows.groupBy(F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("fecha")).agg(F.round(F.avg("c_acctbal"), 2).alias("salario"))

    @property
    def interest_monthly(self) -> DataFrame:
        return self.table("orders").groupBy(F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("fecha")).agg(F.countDistinct("o_custkey").alias("busquedas"))
