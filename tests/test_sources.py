"""Readers of landed data, the store, jobs and the stream, from raw fixtures to stored tables."""

import json
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path
from random import Random

from pyspark.sql import functions as F

from marketlens import schemas
from marketlens.operators.merge import dedupe_last, merge_last, merge_upsert
from marketlens.plans import jobs
from marketlens.sources import landing
from marketlens.sources.shared import shared_dir
from marketlens.sources.store import Store, export_csv
from marketlens.streaming.ingest import ingest_listings, ingest_price_steps, merge_into, price_changes

PAGE = """<html><table class="other"><tr><th>x</th></tr><tr><td>1</td><td>2</td></tr></table>
<table class="estadisticas big"><tr><th>Marca</th><th> Ene-2024</th><th>Feb-2024 </th></tr>
<tr><td>Toyota</td><td>1.200</td><td>-</td><td>99</td></tr><tr><td>Sola</td></tr><tr><td>Ford &amp; Co</td><td>7</td><td>1,000</td></tr></table></html>"""


def item(k, price=100.0, **more):
    attributes = [{"id": "BRAND", "value_name": "otra"}, {"id": "BRAND", "value_name": "Toyota"}, {"id": "KILOMETERS", "value_name": "45.000 km"}, {"id": "VEHICLE_YEAR", "value_name": "2020"}]
    return {"id": k, "title": "t", "price": price, "currency_id": "ARS", "status": "active", "condition": "new", "permalink": "http://x/" + str(k), "attributes": attributes, **more}


def test_registration_pages(spark):
    pages = spark.createDataFrame([("u", PAGE), ("v", None), ("w", "<table class='estadisticas'></table>")], "url string, html string")
    rows = sorted((r.marca, r.fecha, r.cantidad, r.periodo_reportado) for r in landing.registrations_from_pages(pages).collect())
    assert rows == [("Ford & Co", date(2024, 1, 1), 7, "2024-01"), ("Ford & Co", date(2024, 2, 1), 1000, "2024-02"), ("Toyota", date(2024, 1, 1), 1200, "2024-01")]


SPANS = """<h2>Vehículos 0km</h2><table class="estadisticas"><tr><th rowspan="2">Marca</th><th colspan="2">2024</th><th>2025</th></tr><tr><th>Ene</th><th>Feb</th><th>Ene</th></tr>
<tr><td>Fiat</td><td>1</td><td colspan="2">2</td></tr><tr><th scope="row">Ford</th><td rowspan="2">7</td><td>8</td><td>9<table class="estadisticas"><caption>Usados</caption>
<tr><th>Marca</th><th>Mar-2024</th></tr><tr><td>Audi</td><td>5</td></tr></table></td></tr><tr><td>BMW</td><td>x</td><td></td></tr></table>
<h3>Autos usados</h3><div><table class="estadisticas"><tr><th>Marca</th><th>Ene-2024</th></tr><tr><td>Fiat</td><td>33</td><td>44</td></tr></table></div>"""


def test_tables_with_spans_nested_and_of_both_kinds(spark):
    pages = spark.createDataFrame([("u", SPANS)], "url string, html string")
    every = landing.registrations_rows(pages, None).collect()
    rows = sorted((r.tipo_vehiculo, r.marca, r.periodo_reportado, r.cantidad) for r in every if r["_motivo"] is None)
    assert rows == [
        ("0km", "BMW", "2024-01", 7), ("0km", "Fiat", "2024-01", 1), ("0km", "Fiat", "2024-02", 2), ("0km", "Fiat", "2025-01", 2), ("0km", "Ford", "2024-01", 7), ("0km", "Ford", "2024-02", 8), ("0km", "Ford", "2025-01", 9),
        ("usado", "Audi", "2024-03", 5), ("usado", "Fiat", "2024-01", 33),
    ]
    assert sorted((r["_motivo"], json.loads(r["_fila"])["cell"]) for r in every if r["_motivo"]) == [("cantidad", "x"), ("sin encabezado", "44")]


def test_links_and_reports(spark):
    html = '<a class="k" href="/a_2024_02.pdf">Uno <b>x</b></a><A HREF="b.html">no</A><a href="http://o/Marzo.XLSX">Marzo 2023</a><a href="c.pdf">sin fecha</a>'
    links = landing.page_links(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"), "http://b", "http://b/l")
    assert [r.direccion for r in links.orderBy("pos").collect()] == ["http://b/a_2024_02.pdf", "http://b/l/b.html", "http://o/Marzo.XLSX", "http://b/l/c.pdf"]
    rows = [(r.url, r.periodo, r.formato) for r in landing.report_index(links, "http://b", "http://b/l").collect()]
    assert rows == [("http://b/a_2024_02.pdf", "2024-02", "pdf"), ("http://o/Marzo.XLSX", "2023-03", "excel")]


def test_production_grid_and_sheet(spark):
    grid = spark.createDataFrame(
        [("2024-01", 0, ["Terminal", "P", "E"]), ("2024-01", 1, ["Toyota", "15.000", "5000"]), ("2024-01", 2, ["Ford", "12000"]), ("2024-01", 3, ["solo"]), ("2024-99", 1, ["X", "1", "2"])],
        "periodo string, row_no int, cells array<string>",
    )
    rows = sorted((r.terminal, r.unidades_producidas, r.unidades_exportadas) for r in landing.production_from_grid(grid).collect())
    assert rows == [("Ford", 12000, 0), ("Toyota", 15000, 5000)]
    sheet = spark.createDataFrame([("2024-01", "", "Fiat", "10")], "periodo string, Terminal string, Marca string, `Producción` string")
    assert [(r.terminal, r.unidades_producidas, r.unidades_exportadas) for r in landing.production_from_sheet(sheet).collect()] == [("Fiat", 10, 0)]


def test_loans_csv(spark, tmp_path):
    path = tmp_path / "loans.csv"
    path.write_bytes("Fecha;Monto\n2024-01-05;1.234,56\n31/01/2024;2,5\nmañana;3\n2024-02-01;abc\n".encode("latin-1"))
    raw = landing.loans_csv(spark, str(path))
    assert sorted((r.fecha, r.valor) for r in landing.pledge_loans(raw).collect()) == [(date(2024, 1, 5), Decimal("1234.5600")), (date(2024, 1, 31), Decimal("2.5000"))]
    assert landing.pledge_loans(raw, "2024-01-06", "2024-01-31").count() == 1


def test_flatten(spark):
    page = json.dumps({"paging": {"total": 3, "limit": 50, "offset": 0}, "results": [item("a"), item("b", None), item(None), item("c", attributes=[], location={"state": {"name": "S"}})]})
    found = landing.flatten_listings(landing.listing_items(spark.createDataFrame([(page,)], "json string")), "2024-01-01")
    rows = {r.meli_id: r for r in found.collect()}
    assert set(rows) == {"a", "c"}
    assert (rows["a"].marca, rows["a"].kilometros, rows["a"].anio, rows["a"].provincia, rows["a"].es_nuevo) == ("Toyota", 45000, 2020, None, True)
    assert (rows["c"].marca, rows["c"].kilometros, rows["c"].provincia) == (None, None, "S")
    strict = landing.flatten_listings(landing.listing_items(spark.createDataFrame([(page,)], "json string")), "2024-01-01", strict_mileage=True)
    assert {r.kilometros for r in strict.collect()} == {None}


def test_quotes(spark):
    page = json.dumps({"results": [{"fecha": "2024-01-01", "moneda": "USD", "cotizacion": "800"}, {"fecha": "2024-01-02", "moneda": "USD", "cotizacion": "810.5"}, {"fecha": "x", "moneda": "USD", "cotizacion": "1"}]})
    pages = spark.createDataFrame([(page,)], "json string")
    assert [tuple(r) for r in landing.quotes_from_json(pages).collect()] == [(date(2024, 1, 2), "USD", Decimal("810.5000"))]
    assert [r.cotizacion for r in landing.quotes_from_json(pages, "2024-01-01").collect()] == [Decimal("800.0000")]


def _zone(spark, tmp_path):
    zone = str(tmp_path / "zone")
    spark.createDataFrame([("u", PAGE)], "url string, html string").write.parquet(f"{zone}/{jobs.PAGES}")
    spark.createDataFrame([("2024-01", 0, ["T"]), ("2024-01", 1, ["Toyota", "2000", "500"])], "periodo string, row_no int, cells array<string>").write.parquet(f"{zone}/{jobs.GRIDS}")
    series = json.dumps({"results": [{"fecha": "2024-01-10", "valor": "100.5"}, {"fecha": "2024-01-11", "valor": "101"}, {"fecha": "2020-01-01", "valor": "1"}]})
    spark.createDataFrame([(7, series), (12345, series)], "serie_id int, json string").write.parquet(f"{zone}/{jobs.SERIES}")
    (tmp_path / "zone" / jobs.LOANS).mkdir()
    (tmp_path / "zone" / jobs.LOANS / "l.csv").write_text("Fecha;Monto\n2024-01-15;10,5\n")
    page = json.dumps({"paging": {"offset": 0}, "results": [item("a"), item("b"), item("a", 120.0)]})
    spark.createDataFrame([("Toyota", page), ("Nadie", page)], "query_brand string, json string").write.parquet(f"{zone}/{jobs.LISTINGS}")
    return zone


def test_jobs_end_to_end(spark, tmp_path):
    zone, store, now = _zone(spark, tmp_path), Store(spark, str(tmp_path / "store")), datetime(2024, 1, 31, 12)
    assert set(jobs.run_full(spark, zone, store, now).values()) == {"success"}
    counts = {t: store.read(t).count() for t in ("registrations", "production", "macro", "listings")}
    assert counts == {"registrations": 3, "production": 1, "macro": 3, "listings": 2}
    assert {(r.visitas, r.ventas, r.moneda) for r in store.read("listings").collect()} == {(0, 0, "ARS")}
    rows = {(r.indicador, r.marca): r for r in store.read("indicators").collect()}
    days = rows["rotacion_stock", "Toyota"]
    assert float(days.valor) == round((1500 - 1200) * 31 / 1200, 4) and json.loads(days.detalles)["componentes"]["vendidas"] == 1200
    before = {t: sorted(map(str, store.read(t).collect())) for t in (*counts, "indicators")}
    jobs.run_full(spark, zone, store, datetime(2024, 1, 31, 18))
    assert {t: sorted(map(str, store.read(t).collect())) for t in before} == before  # a replay changes nothing
    assert jobs.run_full(spark, str(tmp_path / "nowhere"), store, now, "macro")["macro"].startswith("error")
    assert "registrations_x" in export_csv(store.read("registrations"), str(tmp_path / "out"), "registrations", "x")


def test_used_and_fallback_registrations_and_sheets(spark, tmp_path):
    zone, store, now = str(tmp_path / "zone"), Store(spark, str(tmp_path / "store")), datetime(2024, 3, 1)
    page, none = spark.createDataFrame([("u", PAGE)], "url string, html string"), spark.createDataFrame([("u", "<p>")], "url string, html string")
    page.write.parquet(f"{zone}/{jobs.PAGES}")
    page.write.parquet(f"{zone}/{jobs.USED_PAGES}")
    page.write.parquet(f"{zone}/{jobs.OTHER_PAGES}")
    jobs.load_registrations(spark, zone, store, now)
    assert sorted((r.tipo_vehiculo, r.fuente) for r in store.read("registrations").collect()) == [("0km", "FACCARA")] * 3 + [("usado", "FACCARA")] * 3
    none.write.mode("overwrite").parquet(f"{zone}/{jobs.PAGES}")
    none.write.mode("overwrite").parquet(f"{zone}/{jobs.USED_PAGES}")
    other = Store(spark, str(tmp_path / "other"))
    jobs.load_registrations(spark, zone, other, now)
    assert {(r.fuente, r.tipo_vehiculo) for r in other.read("registrations").collect()} == {("ACARA", "0km")}
    spark.createDataFrame([("u", SPANS)], "url string, html string").write.mode("overwrite").parquet(f"{zone}/{jobs.OTHER_PAGES}")
    both = Store(spark, str(tmp_path / "both"))
    jobs.load_registrations(spark, zone, both, now)
    assert sorted((r.tipo_vehiculo, r.marca) for r in both.read("registrations").collect() if r.mes == 1 and r.anio == 2024) == [("0km", "BMW"), ("0km", "Fiat"), ("0km", "Ford"), ("usado", "Fiat")]
    spark.createDataFrame([("2024-01", 1, ["Toyota", "20", "5"])], "periodo string, row_no int, cells array<string>").write.parquet(f"{zone}/{jobs.GRIDS}")
    for month, line in (("2024-01", "Toyota,,99,1\n,Ford,3,1"), ("2024-02", ",Fiat,7,"), ("2024-17", ",Audi,7,")):
        folder = tmp_path / "zone" / jobs.SHEETS / f"periodo={month}"
        folder.mkdir(parents=True)
        (folder / "a.csv").write_text("Terminal,Marca,Producción,Exportación\n" + line + "\n")
    jobs.load_production(spark, zone, store, now)
    assert sorted((r.terminal, r.unidades_producidas, r.unidades_exportadas) for r in store.read("production").collect()) == [("Fiat", 7, 0), ("Ford", 3, 1), ("Toyota", 20, 5)]
    assert [(r.tabla, r.motivo, json.loads(r.fila)["Marca"], r.veces) for r in store.read("rejects").filter("tabla = 'production'").collect()] == [("production", "periodo", "Audi", 1)]


def test_rejects_are_kept_and_counted(spark, tmp_path):
    zone, store, now = _zone(spark, tmp_path), Store(spark, str(tmp_path / "store")), datetime(2024, 1, 31)
    page = json.dumps({"results": [{"fecha": "ayer", "valor": "1"}, {"fecha": "2024-01-12", "valor": "n/d"}, {"fecha": "2024-01-12", "valor": "5"}, {"fecha": "ayer", "valor": "1"}]})
    spark.createDataFrame([(7, page), (99, page), (7, "{"), (7, "[]"), (7, '{"results": []}'), (7, None)], "serie_id int, json string").write.mode("overwrite").parquet(f"{zone}/{jobs.SERIES}")
    (tmp_path / "zone" / jobs.LOANS / "l.csv").write_text("Fecha;Monto\n2024-01-15;10,5\n2024-01-16;mucho\n")
    done = jobs.sync_macro(spark, zone, store, now)
    assert (done.read, done.rejected, done.months) == (13, 11, ["2024-01"])
    counted = {(r.tabla, r.motivo): r.n for r in store.read("rejects").groupBy("tabla", "motivo").agg(F.sum("veces").alias("n")).collect()}
    assert counted == {("macro", "fecha"): 2, ("macro", "valor"): 2, ("macro", "serie"): 4, ("macro", "json"): 3}
    before = sorted(map(str, store.read("rejects").collect()))
    assert max(r.veces for r in store.read("rejects").collect()) == 2
    jobs.sync_macro(spark, zone, store, now)
    assert sorted(map(str, store.read("rejects").collect())) == before
    page = json.dumps({"results": [item("a"), item(None), item("b", None)]})
    spark.createDataFrame([("Toyota", page), ("Toyota", "no")], "query_brand string, json string").write.mode("overwrite").parquet(f"{zone}/{jobs.LISTINGS}")
    done = jobs.market_snapshot(spark, zone, store, now)
    assert (done.read, done.rejected) == (4, 3) and {r.motivo for r in store.read("rejects").filter("tabla = 'listings'").collect()} == {"id", "precio", "json"}


def test_items_of_a_long_page_do_not_carry_it(spark):
    """Rows of a page would else take memory by the square of its items."""
    listed = json.dumps({"paging": {"offset": 3}, "results": [item(f"MLA{k}") for k in range(8000)]})
    pages = spark.createDataFrame([(listed,), ("no",), (None,)], "json string")
    found = landing.listing_rows(landing.listing_items(pages), "2024-01-31").filter(F.length("_fila").isNull() | (F.length("_fila") < 10))
    assert sorted((r.motivo or "", r.n) for r in found.groupBy(F.col("_motivo").alias("motivo")).agg(F.count("titulo").alias("n")).collect()) == [("", 8000), ("json", 0)]
    points = json.dumps({"results": [{"fecha": "2024-01-12", "valor": str(k)} for k in range(20000)]})
    read = landing.macro_rows(spark.createDataFrame([(7, points), (7, "no")], "serie_id int, json string"), landing.series_map(spark))
    assert sorted((r._motivo or "", r._fila) for r in read.filter("valor = 19999 or _motivo is not null").collect()) == [("", None), ("json", "no")]


def test_rows_without_a_day(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    batch = spark.createDataFrame([("a", None, 1), ("a", date(2024, 1, 1), 2)], "terminal string, fecha date, unidades_producidas int")
    done = merge_into(store, "production", batch, ["unidades_producidas"], ["unidades_producidas"], datetime(2024, 1, 1), ["unidades_producidas"])
    assert (done.read, done.rejected, done.rows.count()) == (2, 1, 1) and store.read("rejects").first().motivo == "sin fecha"


def test_nothing_to_load_is_no_data(spark, tmp_path):
    zone = _zone(spark, tmp_path)
    assert jobs.run_full(spark, zone, Store(spark, str(tmp_path / "s")), datetime(2010, 1, 1), "macro") == {"macro": "no_data"}


def test_principal_variables(spark):
    page = json.dumps({"results": [{"descripcion": "Reservas", "valor": "10", "fecha": "2024-01-02"}, {"descripcion": "Reservas", "valor": "9", "fecha": "2024-01-01"}, {"descripcion": "x", "valor": "n/d", "fecha": "2024-01-01"}]})
    assert [tuple(r) for r in landing.principal_variables(spark.createDataFrame([(page,), (None,)], "json string")).collect()] == [("Reservas", date(2024, 1, 2), Decimal("10.0000"))]


def test_last_month():
    assert jobs.last_month(datetime(2024, 3, 31)) == (date(2024, 2, 29), date(2024, 3, 31))
    assert jobs.last_month(datetime(2024, 1, 15)) == (date(2023, 12, 15), date(2024, 1, 15))


def test_stream_replay(spark, tmp_path):
    landing_dir, store, now = tmp_path / "in", Store(spark, str(tmp_path / "store")), datetime(2024, 1, 1)
    landing_dir.mkdir()
    (landing_dir / "1.json").write_text(json.dumps({"results": [item("a"), item("b")]}))
    ingest_listings(spark, str(landing_dir), store, str(tmp_path / "c1"), now, "2024-01-01")
    (landing_dir / "2.json").write_text(json.dumps({"results": [item("b", 150.0), item("c")]}))
    ingest_listings(spark, str(landing_dir), store, str(tmp_path / "c1"), now, "2024-01-01")
    rows = sorted((r.meli_id, float(r.precio)) for r in store.read("listings").collect())
    assert rows == [("a", 100.0), ("b", 150.0), ("c", 100.0)]
    ingest_listings(spark, str(landing_dir), store, str(tmp_path / "c1"), now, "2024-01-01")
    assert sorted((r.meli_id, float(r.precio)) for r in store.read("listings").collect()) == rows
    assert [p.name for p in (tmp_path / "store" / "listings").iterdir() if p.is_dir()] == ["_month=2024-01"]
    assert store.read("listings").columns == [f.split()[0] for f in schemas.LISTINGS.replace("DECIMAL(18,2)", "D").split(", ")]


def test_stream_keeps_the_store_alone(spark, tmp_path):
    """What a merge writes on its way goes when it ends, rejects included."""
    shared = Path(shared_dir(spark).removeprefix("file://")) / "marketlens"
    before = set(shared.glob("*"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps({"results": [item("a"), item("a", 120.0), item("b", None)]}))
    store = Store(spark, str(tmp_path / "store"))
    for k in (1, 2):
        ingest_listings(spark, str(tmp_path / "in"), store, str(tmp_path / f"c{k}"), datetime(2024, 1, 1), "2024-01-01")
    assert [(r.meli_id, float(r.precio)) for r in store.read("listings").collect()] == [("a", 120.0)]
    assert [(r.motivo, r.veces) for r in store.read("rejects").collect()] == [("precio", 1)]
    assert set(shared.glob("*")) == before


def test_merge_last_in_one_shuffle(spark):
    """The same rows and actions as merge_upsert() of the batch without duplicates, null keys and all."""
    schema = "k string, d int, v int, w int, created_at timestamp_ntz, updated_at timestamp_ntz"
    old, now = datetime(2024, 1, 1), datetime(2024, 2, 1)

    def rows(n, seed, at):
        r = Random(seed)
        return [(r.choice([None, "a", "b", "c", "d"]), r.choice([None, 1, 2, 3]), r.choice([None, 1, 2]), k, at, at) for k in range(n)]

    for seed in range(3):
        target = dedupe_last(spark.createDataFrame(rows(12, seed, old), schema), ["k", "d"], ["v", "w"])
        batch = spark.createDataFrame([(*r, r[3] % 2) for r in rows(30, seed + 9, now)], schema + ", first int")
        found = merge_last(target, batch, ["k", "d"], ["first", "v", "w"], ["v"], ["v"], now)
        want = merge_upsert(target, dedupe_last(batch, ["k", "d"], ["first", "v", "w"]).drop("first"), ["k", "d"], ["v"], as_of=now)
        assert sorted(map(str, found.collect())) == sorted(map(str, want.select(*found.columns).collect()))
    stored = spark.createDataFrame(rows(12, 1, old), schema)
    assert merge_last(stored, batch, ["k", "d"], ["first", "v", "w"], ["v"], ["v"], now)._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def _snapshot(folder, day, name, prices):
    (folder / f"snapshot={day}").mkdir(parents=True, exist_ok=True)
    (folder / f"snapshot={day}" / name).write_text(json.dumps({"results": [item(k, p) for k, p in prices.items()]}))


def test_snapshots_by_folder(spark, tmp_path):
    """The day is that of the file; files of one day in two runs meet in one row a listing."""
    store, now = Store(spark, str(tmp_path / "store")), datetime(2024, 3, 1)
    for n, (day, prices) in enumerate((("2024-02-01", {"a": 5.0, "b": 6.0}), ("2024-01-01", {"a": 4.0}), ("2024-02-01", {"b": 7.0}))):
        _snapshot(tmp_path / "in", day, f"{n}.json", prices)
        ingest_listings(spark, str(tmp_path / "in"), store, str(tmp_path / "c"), now)
    rows = sorted((r.meli_id, str(r.fecha_snapshot), float(r.precio)) for r in store.read("listings").collect())
    assert rows == [("a", "2024-01-01", 4.0), ("a", "2024-02-01", 5.0), ("b", "2024-02-01", 7.0)]


def test_price_steps_out_of_order(spark, tmp_path):
    store, now = Store(spark, str(tmp_path / "store")), datetime(2024, 6, 1)

    def come(day, name, prices):
        _snapshot(tmp_path / "in", day, name, prices)
        ingest_price_steps(spark, str(tmp_path / "in"), store, str(tmp_path / "c"), now, "60 days")
        return sorted((r.meli_id, str(r.fecha_snapshot), r.precio_anterior, r.precio) for r in price_changes(store).collect())

    assert come("2024-03-01", "1.json", {"a": 10.0, "b": 1.0}) == []
    assert come("2024-03-20", "2.json", {"a": 12.0, "b": 1.0}) == [("a", "2024-03-20", 10.0, 12.0)]
    between = [("a", "2024-03-10", 10.0, 12.0), ("b", "2024-03-10", 1.0, 2.0), ("b", "2024-03-20", 2.0, 1.0)]
    assert come("2024-03-10", "3.json", {"a": 12.0, "b": 2.0}) == between  # late, but not too late
    assert come("2024-03-10", "4.json", {"a": 12.0, "b": 2.0}) == between  # repeated
    assert come("2024-02-25", "5.json", {"a": 9.0}) == [("a", "2024-03-01", 9.0, 10.0), *between]
    later = [*[("a", "2024-03-01", 9.0, 10.0), between[0]], ("a", "2024-07-01", 12.0, 13.0), *between[1:]]
    assert come("2024-07-01", "6.json", {"a": 13.0}) == later
    assert come("2024-03-15", "7.json", {"a": 99.0, "c": 1.0}) == later  # before the watermark
    assert {(r.tabla, r.motivo, json.loads(r.fila)["meli_id"]) for r in store.read("rejects").collect()} == {("price_steps", "tarde", "a"), ("price_steps", "tarde", "c")}
    assert come("2024-05-10", "8.json", {"b": 5.0}) == [*later, ("b", "2024-05-10", 1.0, 5.0)]  # the last price before the watermark is kept
