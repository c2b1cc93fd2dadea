"""The registered market queries: each wires the views of a directory to an operator with fixed parameters."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens import schemas
from marketlens.functions import parse
from marketlens.operators import analytics, clusters, explore, indicators, sketches, windows
from marketlens.operators.asof import as_of
from marketlens.operators.merge import dedupe_last, merge_upsert, summary, with_fallback
from marketlens.operators.rejects import marked
from marketlens.plans import jobs
from marketlens.sources import landing
from marketlens.sources.layout import PLACE, IdTable, SortedTable, TrigramIndex
from marketlens.sources.shared import materialise, new_folder
from marketlens.sources.store import Store, export_csv
from marketlens.sources.views import Views
from marketlens.streaming.ingest import ingest_listings, ingest_price_steps, price_changes as stored_price_changes

Query = Callable[[SparkSession, str], DataFrame]
BASE, LISTING = "https://base.example", "https://base.example/estadisticas"
CUT, EARLIER, AS_OF = "2000-01-01", "1999-07-01", datetime(2001, 9, 1)
EARLY = datetime(2001, 8, 15)
SKETCHED = (date(1996, 1, 1), date(1999, 12, 1))
REPORTED = (date(2000, 1, 1), date(2000, 12, 31))
_found: dict[str, Query] = {}


def query(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    _found[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
    return f


def queries() -> dict[str, Query]:
    return dict(_found)


def _day(text: str):
    return F.lit(text).cast("date")


# --- listings, rankings, summaries -----------------------------------------------------------------------------------


@query
def top_brands(v: Views) -> DataFrame:
    return explore.top_brands(v.within("o_orderdate", date(2001, 6, 1), date(2001, 8, 1)).registrations, as_of=date(2001, 7, 15))


@query
def top_brands_dashboard(v: Views) -> DataFrame:
    return explore.top_brands(v.within("o_orderdate", date(2000, 1, 1), date(2001, 1, 1)).registrations, *REPORTED, nulls=False)


@query
def registrations_list(v: Views) -> DataFrame:
    return explore.registrations_list(v.within("o_orderdate", date(1996, 1, 1), date(2000, 1, 1)).registrations, date(1996, 1, 1), date(1999, 12, 31), "brand#1", "0km")


@query
def registrations_list_all(v: Views) -> DataFrame:
    """The options that stand for all brands and kinds, and an empty bound: no filter, the newest two hundred rows."""
    return explore.registrations_list(v.registrations, None, "", "Todas", "Todos", 200)


@query
def registrations_exported(v: Views) -> DataFrame:
    """A month's registrations by brand exported as CSV with headers, and what the files hold when read again."""
    month = explore.totals(v.within("o_orderdate", date(1999, 3, 1), date(1999, 5, 1)).registrations, ["fecha", "marca", "tipo_vehiculo"])
    path = export_csv(month, new_folder(v.spark, "export"), "patentamientos", "19990430_120000")
    return v.spark.read.csv(path, header=True, schema="fecha date, marca string, tipo_vehiculo string, total bigint", enforceSchema=False)


@query
def production_list(v: Views) -> DataFrame:
    return explore.production_list(v.within("l_shipdate", date(1996, 1, 1), date(2100, 1, 1)).production, date(1996, 1, 1), None, "#2")


@query
def macro_list(v: Views) -> DataFrame:
    return explore.macro_list(v.within("l_shipdate", date(1900, 1, 1), date(2000, 7, 1)).macro.withColumn("unidad", F.lit("%")), None, date(2000, 6, 30), "tasa_badlar")


@query
def listings_list(v: Views) -> DataFrame:
    return explore.listings_list(v.listings.withColumn("url", F.concat(F.lit(BASE + "/"), "meli_id")), None, "brand", "new")


@query
def indicators_list(v: Views) -> DataFrame:
    values = indicators.production_vs_demand(v.production, v.registrations).withColumn("valor", F.col("razon"))
    rows = indicators.as_records(values, "produccion_demanda", "razon", ["internas", "vendidas"])
    shown = explore.indicators_list(rows, date(1996, 1, 1), date(2000, 12, 31), "produccion_demanda")
    part = F.get_json_object("detalles", "$.componentes.vendidas").cast("bigint").alias("vendidas")
    return shown.select("fecha", "indicador", "marca", "valor", part)


@query
def brand_options(v: Views) -> DataFrame:
    return explore.options(v.registrations, "marca")


@query
def series_default(v: Views) -> DataFrame:
    return explore.options(v.macro, "indicador", limit=3)


@query
def listing_search(v: Views) -> DataFrame:
    found = explore.listing_search(v.listings, "brand#3", "", 1996, 2000, "used", 40000, None, limit=80, offset=20)
    return found.select("meli_id", "fecha_snapshot", "marca", "anio", F.col("precio").cast("double").alias("precio"), "provincia")


@query
def load_range_registrations(v: Views) -> DataFrame:
    return explore.where(v.within("o_orderdate", date(1998, 1, 1), date(1998, 7, 1)).registrations, *explore.between("fecha", date(1998, 1, 1), date(1998, 6, 30)))


@query
def load_range_production(v: Views) -> DataFrame:
    return explore.where(v.within("l_shipdate", date(1998, 1, 1), date(2000, 1, 1)).production, *explore.between("fecha", date(1998, 1, 1), date(1999, 12, 31)))


@query
def load_range_macro(v: Views) -> DataFrame:
    found = explore.where(v.within("l_shipdate", date(1998, 1, 1), date(1999, 1, 1)).macro, *explore.between("fecha", date(1998, 1, 1), date(1998, 12, 31)))
    return found.filter(F.col("indicador").isin("tasa_badlar", "tasa_pf_90_dias")).withColumn("valor", F.col("valor").cast("double"))


@query
def load_snapshot(v: Views) -> DataFrame:
    found = explore.where(v.within("l_shipdate", date(1999, 3, 15), date(1999, 3, 16)).listings, explore.equals("fecha_snapshot", date(1999, 3, 15)))
    return found.withColumn("precio", F.col("precio").cast("double"))


@query
def registrations_trend(v: Views) -> DataFrame:
    return explore.totals(v.registrations.filter("tipo_vehiculo = '0km'"), ["fecha"])


@query
def registrations_by_type(v: Views) -> DataFrame:
    return explore.totals(v.registrations, ["fecha", "tipo_vehiculo"])


@query
def listing_kpis(v: Views) -> DataFrame:
    return explore.listing_kpis(v.listings)


@query
def listing_top_brands(v: Views) -> DataFrame:
    return explore.top_counts(v.listings, ["marca"], 10)


@query
def trending_models(v: Views) -> DataFrame:
    return explore.top_counts(v.listings, ["marca", "modelo"], 20)


@query
def price_histogram(v: Views) -> DataFrame:
    return explore.histogram(v.listings)


@query
def table_stats(v: Views) -> DataFrame:
    return explore.table_stats({"registrations": v.registrations, "production": v.production, "macro": v.macro, "listings": v.listings})


@query
def listings_by_condition(v: Views) -> DataFrame:
    return explore.listings_by_condition(v.listings)


@query
def price_ranking(v: Views) -> DataFrame:
    return explore.price_ranking(v.listings)


@query
def price_trend(v: Views) -> DataFrame:
    return explore.price_trend(v.listings)


@query
def macro_monthly(v: Views) -> DataFrame:
    return explore.macro_monthly(v.macro)


@query
def macro_latest(v: Views) -> DataFrame:
    return explore.latest_values(v.macro)


@query
def weekly_rollup(v: Views) -> DataFrame:
    return explore.weekly(v.macro)


@query
def price_ranking_sketches(v: Views) -> DataFrame:
    """Of four years, from monthly sketches, and whether between 48 and 52 of a hundred prices lie below each median found."""
    sums = materialise(sketches.by_month(v.listings), "sketches")
    found = materialise(sketches.price_ranking(sketches.within(sums, *SKETCHED)), "sketches-ranking")
    within = v.listings.filter(F.col("fecha_snapshot").between(*(F.lit(d) for d in (SKETCHED[0], F.last_day(F.lit(SKETCHED[1]))))))
    near = F.col("precio_cuantil").alias("_near")
    held = within.join(F.broadcast(found.select("marca", "moneda", near)), ["marca", "moneda"])  # a row a brand and currency
    price = F.col("precio").cast("double")
    ranks = held.groupBy("marca", "moneda").agg((F.count_if(price < F.col("_near")) / F.count("*")).alias("_below"), (F.count_if(price <= F.col("_near")) / F.count("*")).alias("_to"))
    return found.join(ranks, ["marca", "moneda"]).select("marca", "moneda", "publicaciones", F.round("precio_promedio", 4).alias("precio_promedio"), "precio_maximo", ((F.col("_below") <= 0.52) & (F.col("_to") >= 0.48)).alias("dentro"))


@query
def listing_kpis_sketches(v: Views) -> DataFrame:
    """All months, from monthly sketches, and whether the number of models found is within five hundredths."""
    sums = materialise(sketches.by_month(v.listings), "sketches")
    models = v.listings.agg(F.countDistinct("modelo")).scalar()
    return sketches.kpis(sums).select("publicaciones", F.round("precio_promedio", 4).alias("precio_promedio"), "marcas", (F.abs(F.col("modelos") - models) <= 0.05 * models).alias("dentro"))


# --- windows ---------------------------------------------------------------------------------------------------------


@query
def kpi_vs_previous(v: Views) -> DataFrame:
    return windows.kpi_vs_previous(v.within("o_orderdate", date(1998, 12, 1), date(2001, 1, 1)).registrations, *REPORTED)


@query
def yoy_growth(v: Views) -> DataFrame:
    return windows.growth(v.registrations.filter("marca is not null"), 12, "interanual", ["marca"])


@query
def mom_growth(v: Views) -> DataFrame:
    return windows.growth(v.registrations, 1, "intermensual")


@query
def ytd_growth(v: Views) -> DataFrame:
    return windows.year_to_date(v.registrations, ["tipo_vehiculo"])


@query
def cap_per_brand(v: Views) -> DataFrame:
    found = windows.cap_per_group(v.listings.filter("marca is not null"), "marca", 50, ["fecha_snapshot", "meli_id", "precio"])
    return found.select("marca", "posicion", "meli_id", "fecha_snapshot")


@query
def market_share(v: Views) -> DataFrame:
    return windows.market_share(v.registrations)


@query
def rolling_trend(v: Views) -> DataFrame:
    return windows.rolling_mean(v.registrations)


@query
def price_changes(v: Views) -> DataFrame:
    daily = v.listings.withColumn("meli_id", F.concat_ws("|", "marca", "modelo", "moneda"))
    return windows.price_changes(dedupe_last(daily, ["meli_id", "fecha_snapshot"], ["precio"]))


# --- parsing ---------------------------------------------------------------------------------------------------------


def _orders(v: Views) -> DataFrame:
    return v.table("orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("dia"), "o_totalprice")


def _thousands(n):
    return F.format_number(n, 0)


@query
def parse_counts(v: Views) -> DataFrame:
    n = F.floor("o_totalprice").cast("bigint")
    label = F.when(F.col("o_orderkey") % 5 == 0, "-").when(F.col("o_orderkey") % 5 == 1, F.replace(_thousands(n), F.lit(","), F.lit("."))).otherwise(_thousands(n))
    return _orders(v).select("o_orderkey", parse.count_cell(label).alias("cantidad"))


@query
def digits_only(v: Views) -> DataFrame:
    label = F.when(F.col("o_orderkey") % 4 == 0, F.lit("n/a")).otherwise(F.concat(_thousands(F.floor("o_totalprice")), F.lit(" km")))
    return _orders(v).select("o_orderkey", parse.digits_only(label).alias("unidades"))


@query
def parse_period_label(v: Views) -> DataFrame:
    short = F.initcap(F.element_at(F.array(*map(F.lit, schemas.SHORT_MONTHS)), F.month("dia")))
    full = F.initcap(F.element_at(F.array(*map(F.lit, schemas.MONTHS)), F.month("dia")))
    year, kind = F.year("dia").cast("string"), F.col("o_orderkey") % 6
    label = (
        F.when(kind == 0, F.concat(short, F.lit("-"), year)).when(kind == 1, F.date_format("dia", "MM/yyyy")).when(kind == 2, F.date_format("dia", "yyyy-MM"))
        .when(kind == 3, F.concat(full, F.lit("-"), year)).when(kind == 4, F.date_format("dia", "MM-yyyy")).otherwise(F.concat(F.lit("13/"), year))
    )
    return _orders(v).select("o_orderkey", parse.period_label(label).alias("fecha"))


def _report_name():
    month = F.element_at(F.array(*map(F.lit, schemas.MONTHS)), F.month("dia"))
    kind = F.col("o_orderkey") % 3
    return (
        F.when(kind == 0, F.concat(F.lit("produccion_"), F.date_format("dia", "yyyy_MM"), F.lit(".pdf"))).when(kind == 1, F.concat(F.lit("reporte-"), F.date_format("dia", "MM-yyyy"), F.lit(".xlsx")))
        .otherwise(F.concat(F.lit("Estadísticas "), month, F.lit(" "), F.year("dia").cast("string")))
    )


@query
def extract_period(v: Views) -> DataFrame:
    return _orders(v).select("o_orderkey", parse.period_in_text(_report_name()).alias("periodo"))


@query
def parse_decimal_locale(v: Views) -> DataFrame:
    whole, cents = _thousands(F.floor("o_totalprice")), F.lpad((F.floor(F.round(F.col("o_totalprice") * 100)) % 100).cast("string"), 2, "0")
    label = F.when(F.col("o_orderkey") % 7 == 0, "abc").otherwise(F.concat(F.replace(whole, F.lit(","), F.lit(".")), F.lit(","), cents))
    return _orders(v).select("o_orderkey", parse.locale_decimal(label).cast("double").alias("monto"))


@query
def attribute_lookup(v: Views) -> DataFrame:
    pair = lambda k, x: F.struct(F.lit(k).alias("id"), x.alias("value_name"))
    attributes = F.array(pair("BRAND", F.lit("otra")), pair("MODEL", F.col("p_name")), pair("BRAND", F.col("p_brand")))
    rows = v.table("part").select("p_partkey", attributes.alias("a"))
    return rows.select("p_partkey", *(parse.attribute(F.col("a"), k).alias(n) for k, n in (("BRAND", "marca"), ("MODEL", "modelo"), ("FUEL_TYPE", "combustible"))))


@query
def loan_instalment(v: Views) -> DataFrame:
    rate = F.col("o_orderkey") % 90
    return _orders(v).select("o_orderkey", F.round(parse.instalment(F.col("o_totalprice"), rate.cast("double")), 4).alias("cuota"))


# --- sources ---------------------------------------------------------------------------------------------------------


@query
def page_links(v: Views) -> DataFrame:
    return landing.page_links(v.table("pages"), BASE, LISTING)


@query
def report_index(v: Views) -> DataFrame:
    name = _report_name()
    href = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("/archivos/"), name)).otherwise(F.concat(F.lit("http://otro.example/"), name))
    links = _orders(v).select(href.alias("href"), F.concat(F.lit("Informe "), F.col("o_orderkey").cast("string")).alias("texto"))
    return landing.report_index(links, BASE, LISTING)


def _registration_pages(v: Views, kind: str = "0km") -> DataFrame:
    """Yearly pages with a table of brands by months."""
    new = v.registrations.filter((F.col("tipo_vehiculo") == kind) & F.col("marca").isNotNull())
    months = new.groupBy("anio", "marca").pivot("mes", list(range(1, 13))).agg(F.sum("cantidad"))
    cell = lambda m: F.concat(F.lit("<td> "), F.coalesce(F.replace(_thousands(F.col(str(m))), F.lit(","), F.lit(".")), F.lit("-")), F.lit("</td>"))
    row = months.select("anio", F.concat(F.lit("<tr><td>"), "marca", F.lit("</td>"), *(cell(m) for m in range(1, 13)), F.lit("</tr>")).alias("r"))
    head = F.concat(F.lit("<tr><th>Marca</th>"), *(F.concat(F.lit(f"<th>{m.capitalize()}-"), F.col("anio").cast("string"), F.lit("</th>")) for m in schemas.SHORT_MONTHS), F.lit("</tr>"))
    body = row.groupBy("anio").agg(F.array_join(F.sort_array(F.collect_list("r")), "").alias("rows"))  # a row a brand
    page = F.concat(F.lit("<html><body><table class='estadisticas'>"), head, "rows", F.lit("</table></body></html>"))
    return body.select(F.concat(F.lit(BASE + "/"), F.col("anio").cast("string")).alias("url"), page.alias("html"))


@query
def registrations_unpivot(v: Views) -> DataFrame:
    return landing.registrations_from_pages(_registration_pages(v))


@query
def registrations_union(v: Views) -> DataFrame:
    kinds = [v.registrations.filter(F.col("tipo_vehiculo") == k).select("fecha", "marca", "cantidad", F.lit(k).alias("tipo_vehiculo")) for k in ("0km", "usado")]
    return explore.totals(kinds[0].unionByName(kinds[1], allowMissingColumns=True), ["fecha", "tipo_vehiculo", "marca"])


@query
def source_fallback(v: Views) -> DataFrame:
    rows = v.registrations.select("fecha", "fuente", "tipo_vehiculo", "cantidad")
    other = rows.filter("fuente = 'ACARA'")
    both = with_fallback([rows.filter("fuente = 'x'"), rows.filter("fuente = 'y'")], other)
    return explore.totals(both, ["fecha", "fuente"])


def _cells(v: Views) -> DataFrame:
    made = v.production
    cells = F.array("terminal", F.replace(_thousands(F.col("unidades_producidas")), F.lit(","), F.lit(".")), F.col("unidades_exportadas").cast("string"))
    return made.select(parse.period_of(F.col("fecha")).alias("periodo"), F.lit(1).alias("row_no"), cells.alias("cells"))


@query
def production_from_grid(v: Views) -> DataFrame:
    return landing.production_from_grid(_cells(v))


@query
def production_from_sheet(v: Views) -> DataFrame:
    odd = F.month("fecha") % 2 == 1
    sheet = v.production.select(
        parse.period_of(F.col("fecha")).alias("periodo"), F.when(odd, F.col("terminal")).otherwise("").alias("Terminal"), F.when(odd, "otra").otherwise(F.col("terminal")).alias("Marca"),
        F.col("unidades_producidas").cast("string").alias("Producción"), F.when(odd, F.col("unidades_exportadas").cast("string")).alias("Exportación"),
    )
    return landing.production_from_sheet(sheet)


def _series_pages(v: Views) -> DataFrame:
    """A JSON page a series and month."""
    point = F.struct(F.col("fecha").cast("string").alias("fecha"), F.col("valor").cast("string").alias("valor"))
    pages = v.macro.groupBy("indicador", F.trunc("fecha", "MM")).agg(F.to_json(F.struct(F.collect_list(point).alias("results"))).alias("json"))  # 31 days at most
    return pages.join(landing.series_map(v.spark), "indicador").select("serie_id", "json")


@query
def macro_series_ingest(v: Views) -> DataFrame:
    found = landing.macro_from_json(_series_pages(v), landing.series_map(v.spark))
    return found.select("fecha", "indicador", F.col("valor").cast("double").alias("valor"), "fuente")


@query
def quotes_at(v: Views) -> DataFrame:
    point = F.struct(F.col("fecha").cast("string").alias("fecha"), F.col("indicador").alias("moneda"), F.col("valor").cast("string").alias("cotizacion"))
    pages = v.macro.groupBy(F.trunc("fecha", "MM")).agg(F.to_json(F.struct(F.collect_list(point).alias("results"))).alias("json"))  # 31 days of the series
    return landing.quotes_from_json(pages).withColumn("cotizacion", F.col("cotizacion").cast("double"))


def _loan_rows(v: Views) -> DataFrame:
    amount = F.replace(F.replace(F.replace(F.format_number("valor", 2), F.lit(","), F.lit("x")), F.lit("."), F.lit(",")), F.lit("x"), F.lit("."))
    return v.macro.filter("indicador = 'tasa_badlar'").select(F.date_format("fecha", "dd/MM/yyyy").alias("Fecha"), amount.alias("Monto"))


@query
def pledge_loans_csv(v: Views) -> DataFrame:
    return landing.pledge_loans(_loan_rows(v), "1998-01-01", "1999-12-31").withColumn("valor", F.col("valor").cast("double"))


def _page() -> Column:
    """Pages of some dozens of listings, the few lines of sixteen orders each."""
    return F.floor(F.substring_index(F.substring("meli_id", 4, 20), "-", 1).cast("bigint") / 16)


def _items(v: Views) -> DataFrame:
    """Landed search pages."""
    return _item_pages(v.listings, _page())


def _item_pages(listings: DataFrame, page: Column) -> DataFrame:
    pair = lambda k, x: F.struct(F.lit(k).alias("id"), x.alias("value_name"))
    item = lambda r: F.struct(
        r.meli_id.alias("id"), r.modelo.alias("title"), r.precio.alias("price"), r.moneda.alias("currency_id"), r.estado.alias("status"), r.condicion.alias("condition"),
        F.array(pair("BRAND", r.marca), pair("MODEL", r.modelo), pair("VEHICLE_YEAR", r.anio.cast("string")), pair("KILOMETERS", F.concat(r.anio.cast("string"), F.lit(".000 km")))).alias("attributes"),
        F.struct(F.struct(r.provincia.alias("name")).alias("state")).alias("location"),
    )
    listed = F.struct("meli_id", "modelo", "precio", "moneda", "estado", "condicion", "marca", "anio", "provincia")  # in the order of items; what is said twice is added after the shuffle
    pages = listings.groupBy(page.cast("int").alias("page")).agg(F.transform(F.sort_array(F.collect_list(listed)), item).alias("results"))
    return pages.select("page", F.to_json(F.struct(F.struct(F.col("page").alias("offset")).alias("paging"), "results")).alias("json"))


@query
def listing_flatten(v: Views) -> DataFrame:
    found = landing.flatten_listings(landing.listing_items(_items(v)), "2001-09-01").withColumn("precio", F.col("precio").cast("double"))
    return found.select("meli_id", "fecha_snapshot", "marca", "modelo", "anio", "kilometros", "combustible", "precio", "moneda", "provincia", "ciudad", "estado", "condicion", "titulo", "es_nuevo")


@query
def item_detail_lookup(v: Views) -> DataFrame:
    ids = v.table("lineitem").filter("l_orderkey % 100 = 0").select(F.concat(F.lit("MLA"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("meli_id")).distinct()
    details = v.listings.select("meli_id", "marca", "modelo", F.col("precio").cast("double").alias("precio"))
    return ids.join(details, "meli_id", "left")


@query
def item_by_id(v: Views) -> DataFrame:
    """Listings looked up by id in a table laid out for it; some ids are unknown."""
    table = IdTable.build(v.listings.select("meli_id", "marca", "modelo", F.col("precio").cast("double").alias("precio")), "meli_id", 16)
    asked = v.table("lineitem").filter("l_orderkey % 1000 = 7").select("l_orderkey", F.explode(F.array(F.col("l_linenumber").cast("int"), F.lit(99))).alias("n"))
    return table.lookup(asked.select(F.concat(F.lit("MLA"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("n").cast("string")).alias("meli_id")))


@query
def listing_pages(v: Views) -> DataFrame:
    """The first three pages of a text search, each going on from the last row of the page before, over a sorted table and a trigram index."""
    listed = v.listings.select("meli_id", "fecha_snapshot", "modelo", "condicion", F.col("precio").cast("double").alias("precio"))
    table = SortedTable.build(listed, [F.col("precio").asc(), F.col("meli_id").asc(), F.col("fecha_snapshot").asc()], 12)
    models = TrigramIndex.build(listed, "modelo", 16).holding("D Gi")
    shown, place = None, -1
    for page in (1, 2, 3):
        rows = materialise(table.page_after(place, 40, F.col("condicion") == "used", models), "listing-page").withColumn("pagina", F.lit(page))
        shown = rows if shown is None else shown.unionAll(rows)
        place = rows.agg(F.coalesce(F.max(PLACE), F.lit(place))).first()[0]
    return shown.drop(PLACE)


@query
def listing_page_1000(v: Views) -> DataFrame:
    """Page 1,000 of all listings, ten a page, by place."""
    listed = v.listings.select("meli_id", "fecha_snapshot", F.col("precio").cast("double").alias("precio"))
    table = SortedTable.build(listed, [F.col("precio").asc(), F.col("meli_id").asc(), F.col("fecha_snapshot").asc()], 12)
    return table.page_at(9990 % max(1, len(table)), 10).drop(PLACE)


# --- merges ----------------------------------------------------------------------------------------------------------


def _parts(df: DataFrame, table: str, day: str, order: list[str], raised: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A stored part, a later and overlapping batch in which some measures are raised, and the batch without duplicates."""
    keys = schemas.KEYS[table]
    stored = dedupe_last(df.filter(F.col(day) < _day(CUT)), keys, order)
    raw = df.filter(F.col(day) >= _day(EARLIER)).withColumns(raised)
    return stored, raw, dedupe_last(raw, keys, order)


def _registrations(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    return _parts(v.registrations, "registrations", "fecha", ["modelo", "segmento", "cantidad"], {"cantidad": F.when(F.col("cantidad") % 7 == 0, F.col("cantidad") + 1).otherwise(F.col("cantidad"))})


@query
def upsert_registrations(v: Views) -> DataFrame:
    stored, _, batch = _registrations(v)
    merged = merge_upsert(stored, batch, schemas.KEYS["registrations"], ["cantidad"])
    return merged.select("fecha", "marca", "tipo_vehiculo", "fuente", "cantidad", "action")


@query
def upsert_production(v: Views) -> DataFrame:
    made = v.production.withColumn("fuente", F.lit("ADEFA"))
    raised = {"unidades_exportadas": F.when(F.col("unidades_exportadas") % 7 == 0, F.col("unidades_exportadas") + 1).otherwise(F.col("unidades_exportadas"))}
    measures = ["unidades_producidas", "unidades_exportadas"]
    stored, _, batch = _parts(made, "production", "fecha", measures, raised)
    return merge_upsert(stored, batch, schemas.KEYS["production"], measures)


@query
def upsert_macro(v: Views) -> DataFrame:
    raised = {"valor": F.when(F.day("fecha") % 7 == 0, F.col("valor") + F.lit(1)).otherwise(F.col("valor")).cast("decimal(18,4)")}
    stored, _, batch = _parts(v.macro, "macro", "fecha", ["valor"], raised)
    return merge_upsert(stored, batch, schemas.KEYS["macro"], ["valor"]).withColumn("valor", F.col("valor").cast("double"))


@query
def upsert_listings(v: Views) -> DataFrame:
    raised = {"precio": F.when(F.floor("precio") % 7 == 0, F.col("precio") + F.lit(1)).otherwise(F.col("precio")).cast("decimal(18,2)"), "estado": F.lit("closed")}
    stored, _, batch = _parts(v.listings, "listings", "fecha_snapshot", ["precio", "modelo", "provincia", "moneda", "estado"], raised)
    merged = merge_upsert(stored, batch, schemas.KEYS["listings"], ["precio"], ["precio", "estado"])
    return merged.select("meli_id", "fecha_snapshot", F.col("precio").cast("double").alias("precio"), "estado", "action")


@query
def dedupe_last_record(v: Views) -> DataFrame:
    found = dedupe_last(v.registrations, schemas.KEYS["registrations"], ["modelo", "segmento", "cantidad"])
    return found.select("fecha", "marca", "tipo_vehiculo", "fuente", "modelo", "cantidad")


@query
def ingest_summary(v: Views) -> DataFrame:
    """Rows without a brand are rejected here."""
    stored, raw, batch = _registrations(v)
    read = marked(raw, {"sin marca": F.col("marca").isNull()}, F.to_json(F.struct("fecha", "modelo", "cantidad")))
    batch = batch.filter("marca is not null")
    return summary(read, batch, merge_upsert(stored, batch, schemas.KEYS["registrations"], ["cantidad"]))


@query
def ingest_rejects(v: Views) -> DataFrame:
    """Sources landed with faults of every kind, loaded, and what the store's rejects then hold."""
    folder = new_folder(v.spark, "rejects")
    zone, store = f"{folder}/zone", Store(v.spark, f"{folder}/store")
    december = F.regexp_replace("html", r"(<td>[^<]*</td>)(<td> [0-9.]+</td>)(</tr>)", "$1<td> s/d</td>$3")
    _registration_pages(v).withColumn("html", december).write.parquet(f"{zone}/{jobs.PAGES}")
    short = F.when(F.col("periodo").endswith("-11"), F.slice("cells", 1, 1)).otherwise(F.col("cells"))
    _cells(v).withColumns({"cells": short, "periodo": F.regexp_replace("periodo", "-12$", "-13")}).write.parquet(f"{zone}/{jobs.GRIDS}")
    spoilt = F.regexp_replace(F.regexp_replace("json", r'("fecha":"\d{4}-\d\d-13","valor":)"[^"]*"', r'$1"n/d"'), r'"fecha":"\d{4}-\d\d-14"', '"fecha":"ayer"')
    badlar, unknown = F.col("serie_id") == schemas.SERIES["tasa_badlar"], F.col("serie_id") == schemas.SERIES["tasa_pf_90_dias"]
    cut = F.when(badlar & F.col("json").rlike(r'"fecha":"\d{4}-02-'), F.substring("json", 1, 12)).otherwise(spoilt)
    _series_pages(v).withColumns({"json": cut, "serie_id": F.when(unknown, 99).otherwise(F.col("serie_id"))}).write.parquet(f"{zone}/{jobs.SERIES}")
    amount = F.when(F.substring("Fecha", 1, 2).cast("int") % 9 == 0, "abc").otherwise(F.col("Monto"))
    _loan_rows(v).withColumn("Monto", amount).write.csv(f"{zone}/{jobs.LOANS}", sep=";", header=True, encoding="ISO-8859-1")
    line = F.right("meli_id", F.lit(1))
    listed = v.listings.withColumns({"page": _page(), "precio": F.when(line != "6", F.col("precio")), "meli_id": F.when(line != "7", F.col("meli_id"))})
    _item_pages(listed, F.col("page")).select(F.lit("-").alias("query_brand"), "json").write.parquet(f"{zone}/{jobs.LISTINGS}")
    jobs.load_registrations(v.spark, zone, store, AS_OF)
    jobs.load_production(v.spark, zone, store, AS_OF)
    jobs.sync_macro(v.spark, zone, store, AS_OF, date(1990, 1, 1), date(2010, 1, 1))
    jobs.market_snapshot(v.spark, zone, store, AS_OF, per_brand=1 << 40)
    return store.read("rejects").groupBy("tabla", "motivo").agg(F.sum("veces").alias("rechazados"))


# --- landing zone to store -------------------------------------------------------------------------------------------


@query
def listing_stream(v: Views) -> DataFrame:
    """The listings landed as JSON, ingested by the stream in two rounds, of which the second replays the first."""
    folder = new_folder(v.spark, "stream")
    _items(v).select("json").write.text(f"{folder}/landing", compression="gzip")
    store = Store(v.spark, f"{folder}/store")
    for k in (1, 2):
        ingest_listings(v.spark, f"{folder}/landing", store, f"{folder}/checkpoint-{k}", AS_OF, "2001-09-01")
    return store.read("listings").select("meli_id", "fecha_snapshot", "marca", "modelo", "anio", F.col("precio").cast("double").alias("precio"), "estado", "es_nuevo")


@query
def price_change_stream(v: Views) -> DataFrame:
    """Quarterly snapshots that come out of order, some of them twice, each in a run of its own from the same checkpoint; then the stored price changes."""
    folder = new_folder(v.spark, "steps")
    store, quarter = Store(v.spark, f"{folder}/store"), F.trunc("fecha_snapshot", "quarter")
    listed = v.listings.withColumns({"snapshot": quarter, "meli_id": F.concat_ws("|", "marca", "moneda", "provincia"), "estado": F.lit("active")})
    prices = listed.groupBy("snapshot", "meli_id").agg(F.max("precio").alias("price")).select("snapshot", F.struct(F.col("meli_id").alias("id"), "price").alias("item"), F.pmod(F.xxhash64("meli_id"), F.lit(16)).alias("page"))
    pages = prices.groupBy("snapshot", "page").agg(F.to_json(F.struct(F.collect_list("item").alias("results"))).alias("json")).select("snapshot", "json")
    pages = materialise(pages, "steps-pages")
    year = F.year("snapshot")
    for come in (year.between(1997, 1998), year >= 1998, year < 1997):  # 1998 comes twice, the oldest last
        pages.filter(come).write.partitionBy("snapshot").mode("append").text(f"{folder}/landing")
        ingest_price_steps(v.spark, f"{folder}/landing", store, f"{folder}/checkpoint", AS_OF, "4000 days")
    return stored_price_changes(store)


def _land(v: Views, zone: str) -> None:
    """All sources but listings, as they are landed."""
    _registration_pages(v).write.parquet(f"{zone}/{jobs.PAGES}")
    _registration_pages(v, "usado").write.parquet(f"{zone}/{jobs.USED_PAGES}")
    v.interest_monthly.withColumn("marca", F.lit(None).cast("string")).select("fecha", "marca", "busquedas").write.parquet(f"{zone}/{jobs.INTEREST}")
    v.wages.withColumn("fecha", F.add_months("fecha", 2)).write.parquet(f"{zone}/{jobs.WAGES}")  # up to the snapshot's month
    _cells(v).write.parquet(f"{zone}/{jobs.GRIDS}")
    _series_pages(v).write.parquet(f"{zone}/{jobs.SERIES}")
    _loan_rows(v).write.csv(f"{zone}/{jobs.LOANS}", sep=";", header=True, encoding="ISO-8859-1")


def _search_pages(v: Views) -> DataFrame:
    """page, query_brand, json: a page is taken for the search of its first item's brand."""
    brand = F.get_json_object("json", "$.results[0].attributes[0].value_name")
    return _items(v).select("page", F.coalesce(brand, F.lit("-")).alias("query_brand"), "json")


def _ended_well(done: dict[str, str]) -> None:
    if set(done.values()) != {"success"}:
        raise RuntimeError(str(done))


def _full_load(v: Views) -> Store:
    """All sources landed and loaded into a store, and the indicators of what it holds."""
    folder = new_folder(v.spark, "job")
    zone, store = f"{folder}/zone", Store(v.spark, f"{folder}/store")
    _land(v, zone)
    _search_pages(v).drop("page").write.parquet(f"{zone}/{jobs.LISTINGS}")
    _ended_well(jobs.run_full(v.spark, zone, store, AS_OF))
    return store


@query
def job_full(v: Views) -> DataFrame:
    """The full load, and of what it stored the indicators of stock and production."""
    rows = _full_load(v).read("indicators").filter(F.col("indicador").isin("rotacion_stock", "produccion_demanda")).groupBy("indicador", "marca")
    return rows.agg(F.count("*").alias("meses"), F.max_by("valor", "fecha").cast("double").alias("ultimo"))


@query
def job_tables(v: Views) -> DataFrame:
    """The full load, and how many rows it stored in each table and of each indicator."""
    store = _full_load(v)
    counts = explore.table_stats({name: store.read(name) for name in ("registrations", "production", "macro", "listings")})
    return counts.unionByName(store.read("indicators").groupBy(F.concat(F.lit("indicators/"), "indicador").alias("tabla")).agg(F.count("*").alias("filas")))


@query
def job_daily(v: Views) -> DataFrame:
    """A full load in mid-month from half the listing pages; a fortnight later a daily run over all of them: every stored indicator."""
    folder = new_folder(v.spark, "daily")
    zone, store = f"{folder}/zone", Store(v.spark, f"{folder}/store")
    _land(v, zone)
    pages = _search_pages(v)
    pages.filter("page % 2 = 0").drop("page").write.parquet(f"{zone}/{jobs.LISTINGS}")
    _ended_well(jobs.run_full(v.spark, zone, store, EARLY))
    pages.filter("page % 2 = 1").drop("page").write.mode("append").parquet(f"{zone}/{jobs.LISTINGS}")
    _ended_well(jobs.run_daily(v.spark, zone, store, AS_OF))
    return store.read("indicators").select("indicador", "periodo", "marca", F.col("valor").cast("double").alias("valor"))


@query
def job_monthly(v: Views) -> DataFrame:
    """The monthly run where the first source of registrations is empty, and grids have half the makers, sheets all with other numbers."""
    folder = new_folder(v.spark, "monthly")
    zone, store = f"{folder}/zone", Store(v.spark, f"{folder}/store")
    v.spark.createDataFrame([("u", "<p>sin datos</p>")], "url string, html string").write.parquet(f"{zone}/{jobs.PAGES}")
    used = F.concat(F.lit("<h2>Vehículos usados</h2>"), "html")
    both = _registration_pages(v).unionByName(_registration_pages(v, "usado").withColumn("html", used))
    both.groupBy("url").agg(F.concat(F.lit("<h2>Vehículos 0km</h2>"), F.array_join(F.sort_array(F.collect_list("html"), asc=False), "")).alias("html")).write.parquet(f"{zone}/{jobs.OTHER_PAGES}")  # two tables a page
    _cells(v).filter(F.right(F.element_at("cells", 1), F.lit(1)).cast("int") % 2 == 0).write.parquet(f"{zone}/{jobs.GRIDS}")
    sheet = v.production.select(parse.period_of(F.col("fecha")).alias("periodo"), F.col("terminal").alias("Terminal"), F.lit(None).cast("string").alias("Marca"), (F.col("unidades_producidas") + 1).alias("Producción"), F.col("unidades_exportadas").alias("Exportación"))
    sheet.write.partitionBy("periodo").csv(f"{zone}/{jobs.SHEETS}", header=True)
    _ended_well(jobs.run_monthly(v.spark, zone, store, AS_OF))
    made = store.read("production").select(F.lit("production").alias("tabla"), F.col("terminal").alias("grupo"), F.col("unidades_producidas").alias("unidades"))
    sold = store.read("registrations").select(F.lit("registrations").alias("tabla"), F.concat("fuente", F.lit(" "), "tipo_vehiculo").alias("grupo"), F.col("cantidad").alias("unidades"))
    return made.unionByName(sold).groupBy("tabla", "grupo").agg(F.count("*").alias("filas"), F.sum("unidades").cast("bigint").alias("unidades"))


@query
def principal_variables(v: Views) -> DataFrame:
    point = F.struct(F.col("indicador").alias("descripcion"), F.col("valor").cast("string").alias("valor"), F.col("fecha").cast("string").alias("fecha"))
    pages = v.macro.groupBy(F.trunc("fecha", "MM")).agg(F.to_json(F.struct(F.collect_list(point).alias("results"))).alias("json"))  # 31 days of the series
    return landing.principal_variables(pages).withColumn("valor", F.col("valor").cast("double"))


@query
def first_rows(v: Views) -> DataFrame:
    """The first hundred rows of a filtered frame."""
    return explore.registrations_list(v.within("o_orderdate", date(1998, 1, 1), date(1999, 1, 1)).registrations, date(1998, 1, 1), date(1998, 12, 31), None, "usado")


# --- indicators and analytics ----------------------------------------------------------------------------------------


@query
def demand_tension(v: Views) -> DataFrame:
    return indicators.demand_tension(v.registrations, v.macro, v.interest_monthly)


@query
def stock_rotation(v: Views) -> DataFrame:
    return indicators.stock_rotation(v.production, v.registrations)


@query
def overstock_flags(v: Views) -> DataFrame:
    return indicators.overstock_flags(indicators.stock_rotation(v.production, v.registrations))


@query
def affordability(v: Views) -> DataFrame:
    return indicators.affordability(v.listings, v.wages, v.macro)


@query
def rate_asof(v: Views) -> DataFrame:
    """Each listing with the last rate of its currency's series that was published on or before its day; rates are published now and then."""
    published = v.macro.filter((F.day("fecha") % 5 == 0) & (F.month("fecha") != 2))
    series = F.when(F.col("moneda") == "USD", "tasa_pf_30_dias").when(F.col("condicion") == "new", "tasa_badlar").otherwise("tasa_pf_90_dias")
    listed = v.listings.select("meli_id", "fecha_snapshot", series.alias("indicador"))
    return as_of(listed, published, ["indicador"], "fecha_snapshot", "fecha", ["valor"], "fecha_tasa").withColumn("valor", F.col("valor").cast("double"))


@query
def attention_ranking(v: Views) -> DataFrame:
    return indicators.attention_ranking(v.interest, v.listings)


@query
def interest_index(v: Views) -> DataFrame:
    return indicators.interest_index(v.interest)


@query
def interest_by_region(v: Views) -> DataFrame:
    seen = v.table("events").filter(F.col("event_type").isin("view", "click"))
    rows = seen.select(F.concat(F.lit("Region#"), (F.col("user_id") % 5).cast("string")).alias("region"), F.lit(1).alias("busquedas"))
    return indicators.interest_index(rows, ("region",), ())


@query
def production_vs_demand(v: Views) -> DataFrame:
    return indicators.production_vs_demand(v.production, v.registrations)


@query
def forecast(v: Views) -> DataFrame:
    return analytics.forecast(v.registrations)


@query
def anomalies(v: Views) -> DataFrame:
    return analytics.anomalies(v.registrations, limit=2.0)


@query
def lagged_correlation(v: Views) -> DataFrame:
    return analytics.lagged_correlation(v.registrations, v.macro)


@query
def seasonality(v: Views) -> DataFrame:
    return analytics.seasonality(v.registrations)


@query
def segment_clusters(v: Views) -> DataFrame:
    """Each brand's features, and whether the centre of the group it was put in is the nearest."""
    return clusters.groups(clusters.brand_features(v.registrations, v.listings)).drop("grupo", "grupos", "silueta")


@query
def segment_groups(v: Views) -> DataFrame:
    """The groups themselves; what k-means ends in is beyond SQL, a test holds it against plain Python."""
    return clusters.groups(clusters.brand_features(v.registrations, v.listings)).select("marca", "grupo", "grupos", "silueta")
