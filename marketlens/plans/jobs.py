"""Batch jobs over a landing zone: sources into the store, then the indicators. A source that fails doesn't stop the others."""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens import schemas
from marketlens.operators import indicators, rollups
from marketlens.operators.merge import with_fallback
from marketlens.operators.rejects import REASON
from marketlens.operators.windows import cap_per_group
from marketlens.sources import landing
from marketlens.sources.store import Store
from marketlens.streaming.ingest import PRECEDENCE, Merged, merge_into

log = logging.getLogger(__name__)

#: Folders of the landing zone. The ones marked optional may be missing.
PAGES, USED_PAGES, OTHER_PAGES, GRIDS, SHEETS = "registration_pages", "used_pages", "fallback_pages", "production_grids", "production_sheets"
SERIES, LOANS, LISTINGS, INTEREST, WAGES = "series", "loans", "listing_pages", "interest", "wages"


def last_month(as_of: datetime) -> tuple[date, date]:
    """The calendar month up to as_of: one month back, clamped to the month's end."""
    year, month = (as_of.year, as_of.month - 1) if as_of.month > 1 else (as_of.year - 1, 12)
    last = (date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)).day
    return date(year, month, min(as_of.day, last)), as_of.date()


def landed(spark: SparkSession, zone: str, name: str, schema: str) -> DataFrame:
    """An optional folder of the zone; an empty frame where it is missing."""
    try:
        return spark.read.parquet(f"{zone}/{name}")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def sync_macro(spark: SparkSession, zone: str, store: Store, as_of: datetime, first: date | None = None, last: date | None = None) -> Merged:
    """All known series and the pledge loans within a window, in one merge."""
    a, z = first or last_month(as_of)[0], last or last_month(as_of)[1]
    pages = spark.read.parquet(f"{zone}/{SERIES}")
    points = landing.macro_rows(pages, landing.series_map(spark))
    loans = landing.loan_rows(landing.loans_csv(spark, f"{zone}/{LOANS}"))
    batch = points.unionByName(loans, allowMissingColumns=True).filter(F.col(REASON).isNotNull() | F.col("fecha").between(F.lit(a), F.lit(z)))
    return merge_into(store, "macro", batch, ["valor"], ["valor"], as_of, ["valor"])


def market_snapshot(spark: SparkSession, zone: str, store: Store, as_of: datetime, brands: list[str] | None = None, per_brand: int = 100) -> Merged:
    """The landed search pages of the brands (all landed ones, if not given), the first items of each, flattened and merged."""
    items = landing.listing_items(spark.read.parquet(f"{zone}/{LISTINGS}"))
    items = items.filter(F.col("query_brand").isin(brands)) if brands else items
    first = cap_per_group(items.filter("item is not null"), "query_brand", per_brand, ["offset", "pos"]).drop("posicion")
    rows = landing.listing_rows(first.unionByName(items.filter("item is null")), as_of.date().isoformat())  # pages that can't be read are rejects
    return merge_into(store, "listings", rows, ["precio"], ["precio", "estado"], as_of, ["precio"])


def load_registrations(spark: SparkSession, zone: str, store: Store, as_of: datetime) -> Merged:
    """New and used vehicles of the first source; those of the other source, of both kinds, only if the first has none at all."""
    page = "url string, html string"
    new = landing.registrations_rows(spark.read.parquet(f"{zone}/{PAGES}"))
    used = landing.registrations_rows(landed(spark, zone, USED_PAGES, page), "usado")
    other = landing.registrations_rows(landed(spark, zone, OTHER_PAGES, page), None, "ACARA")
    return merge_into(store, "registrations", with_fallback([new, used], other), ["cantidad"], ["cantidad"], as_of, ["cantidad"])


def load_production(spark: SparkSession, zone: str, store: Store, as_of: datetime) -> Merged:
    """All reports: of a month and maker that a grid and a sheet both have the grid's row, every other row of either."""
    grid = landing.grid_rows(spark.read.parquet(f"{zone}/{GRIDS}")).withColumn(PRECEDENCE, F.lit(2))
    sheet = landing.sheet_rows(landing.sheets_csv(spark, f"{zone}/{SHEETS}")).withColumn(PRECEDENCE, F.lit(1))
    measures = ["unidades_producidas", "unidades_exportadas"]
    return merge_into(store, "production", grid.unionByName(sheet), measures, measures, as_of, measures)


def refresh_state(store: Store, table: str, months: list[str] | None) -> None:
    """Rolls up these months of a stored table anew, all of them if there is no state yet; no other month is read."""
    if not store.has(f"state_{table}"):
        months = None
    rows = store.read(table, getattr(schemas, table.upper()), months)
    store.write(f"state_{table}", rollups.ROLLED[table](rows), "fecha")


def state(store: Store, table: str, months: Column | None = None) -> DataFrame:
    rows = store.read(f"state_{table}", rollups.SCHEMAS[table])
    return rows if months is None else rows.filter(months)


def advance_stock(store: Store, first: str | None) -> None:
    """Carries the stock on from the month (2024-01) given, on top of each brand's last stock before it; from the start if none is given."""
    if first is None or not store.has("state_stock"):
        moved = rollups.stock(rollups.flows(state(store, "production"), state(store, "registrations")))
    else:
        since = F.lit(f"{first}-01").cast("date")
        before = state(store, "stock", F.col("fecha") < since).groupBy("marca").agg(F.max_by("stock", "fecha").alias("stock"))
        moved = rollups.stock(rollups.flows(*(state(store, t, F.col("fecha") >= since) for t in ("production", "registrations"))), before)
    store.write("state_stock", moved, "fecha")


def update_state(store: Store, touched: dict[str, list[str]]) -> None:
    """Brings the state up to the tables, given the months that loads have touched."""
    for table in rollups.ROLLED:
        if touched.get(table) or not store.has(f"state_{table}"):
            refresh_state(store, table, touched.get(table))
    moved = sorted({*touched.get("production", []), *touched.get("registrations", [])})
    if moved or not store.has("state_stock"):
        advance_stock(store, moved[0] if moved else None)


def calculate_indicators(store: Store, as_of: datetime, interest: DataFrame | None = None, wages: DataFrame | None = None) -> Merged:
    """The four composite indicators and production against demand, from the store's state by month, search interest and wages."""
    spark = store.spark
    made, sold, macro, listed = (state(store, t) for t in ("production", "registrations", "macro", "listings"))
    interest = spark.createDataFrame([], schemas.INTEREST) if interest is None else interest
    wages = spark.createDataFrame([], schemas.WAGES) if wages is None else wages
    rotation = indicators.days_of_stock(state(store, "stock")).withColumn("valor", F.col("dias_stock"))
    ratio = indicators.production_vs_demand(made, sold).withColumn("valor", F.col("razon"))
    tension = indicators.demand_tension(sold, macro, interest)
    access = indicators.affordability(listed, wages, macro).withColumn("valor", F.col("indice"))
    month = F.lit(as_of).cast("date")
    attention = indicators.attention_ranking(interest, listed).withColumns({"valor": F.col("puntaje"), "mes": F.trunc(month, "MM")})
    records = [
        indicators.as_records(rotation, "rotacion_stock", "dias", ["internas", "vendidas", "stock"], "marca"),
        indicators.as_records(ratio, "produccion_demanda", "razon", ["internas", "vendidas"]),
        indicators.as_records(tension, "tension_demanda", "puntos", list(indicators.DEMAND)),
        indicators.as_records(access, "accesibilidad", "porcentaje", ["precio", "salario", "tasa", "cuota"]),
        indicators.as_records(attention, "atencion", "puntos", ["busquedas", "activas"], "marca"),
    ]
    rows = reduce(DataFrame.unionByName, records)
    return merge_into(store, "indicators", rows, ["valor"], ["valor", "detalles"], as_of, ["valor"])


Step = Callable[[SparkSession, str, Store, datetime], Merged]
SOURCES: dict[str, Step] = {"macro": sync_macro, "listings": market_snapshot, "registrations": load_registrations, "production": load_production}


def run(spark: SparkSession, zone: str, store: Store, as_of: datetime, sources: list[str]) -> dict[str, str]:
    """Runs the sources, brings the state of the months that they touched up to date, and calculates the indicators from it.

    How each source ended: success, no_data (nothing to merge) or an error."""
    done, touched = {}, {}
    for name in sources:
        try:
            merged = SOURCES[name](spark, zone, store, as_of)
            month = F.date_format(schemas.DAYS[name], "yyyy-MM")
            seen = merged.rows.filter("action <> 'kept'").groupBy(month).agg(F.bool_or(F.col("action") != "unchanged")).collect()  # a row a month
            done[name] = "success" if seen else "no_data"
            touched[name] = sorted(month for month, changed in seen if changed)
        except Exception as problem:  # noqa: BLE001  the others go on
            log.exception("source %s failed", name)
            done[name] = f"error: {type(problem).__name__}"
    update_state(store, touched)
    calculate_indicators(store, as_of, landed(spark, zone, INTEREST, schemas.INTEREST), landed(spark, zone, WAGES, schemas.WAGES))
    return done


def run_daily(spark: SparkSession, zone: str, store: Store, as_of: datetime) -> dict[str, str]:
    return run(spark, zone, store, as_of, ["macro", "listings"])


def run_monthly(spark: SparkSession, zone: str, store: Store, as_of: datetime) -> dict[str, str]:
    return run(spark, zone, store, as_of, ["registrations", "production"])


def run_full(spark: SparkSession, zone: str, store: Store, as_of: datetime, source: str = "all") -> dict[str, str]:
    return run(spark, zone, store, as_of, list(SOURCES) if source == "all" else [source])
