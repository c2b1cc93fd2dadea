"""The daily job: its state by month equals a recalculation from the tables, and only touched months are read."""

import json
import shutil
from datetime import date, datetime

import pytest

from marketlens.operators import rollups
from marketlens.plans import jobs
from marketlens.sources.store import Store
from marketlens.streaming.ingest import merge_into


def load(store, table, rows, schema, measure, now):
    return {table: merge_into(store, table, store.spark.createDataFrame(rows, schema), measure, measure, now, measure).months}


def sales(store, rows, now):
    return load(store, "registrations", rows, "fecha date, marca string, tipo_vehiculo string, cantidad int", ["cantidad"], now)


def made(store, rows, now):
    return load(store, "production", rows, "fecha date, terminal string, unidades_producidas int, unidades_exportadas int", ["unidades_producidas", "unidades_exportadas"], now)


def values(store):
    return sorted((r.indicador, r.periodo, r.marca or "", float(r.valor), json.loads(r.detalles)["confianza"]) for r in store.read("indicators").collect())


@pytest.fixture
def filled(spark, tmp_path):
    store, now = Store(spark, str(tmp_path / "store")), datetime(2024, 6, 30)
    months = [date(2023 + k // 12, k % 12 + 1, 1) for k in range(18)]
    touched = sales(store, [(m, b, kind, 10 * k + len(b)) for k, m in enumerate(months) for b in ("Fiat", "Ford") for kind in ("0km", "usado")], now)
    touched |= made(store, [(m, b, 40 + k, k) for k, m in enumerate(months) for b in ("Fiat", "Toyota")], now)
    touched |= load(store, "macro", [(m.replace(day=d), s, float(k + d)) for k, m in enumerate(months) for d in (3, 9) for s in ("tasa_badlar", "tasa_pf_30_dias")], "fecha date, indicador string, valor double", ["valor"], now)
    touched |= load(store, "listings", [(f"{k}", m, "Fiat", 1000.0 + k, "new", "active") for k, m in enumerate(months)], "meli_id string, fecha_snapshot date, marca string, precio double, condicion string, estado string", ["precio"], now)
    jobs.update_state(store, touched)
    return store


def test_state_equals_recalculation(spark, filled, tmp_path):
    wages = spark.createDataFrame([(date(2024, 4, 1), 500.0), (date(2024, 6, 1), 700.0)], "fecha date, salario double")
    interest = spark.createDataFrame([(date(2024, 5, 1), "Fiat", 7), (date(2024, 6, 1), "Ford", 9)], "fecha date, marca string, busquedas long")
    now = datetime(2024, 6, 30)
    touched = sales(filled, [(date(2024, 3, 1), "Fiat", "0km", 999), (date(2024, 6, 1), "Audi", "0km", 5)], now)
    touched |= made(filled, [(date(2024, 2, 1), "Audi", 77, 7)], now)
    touched |= load(filled, "macro", [(date(2024, 6, 20), "tasa_badlar", 50.0)], "fecha date, indicador string, valor double", ["valor"], now)
    touched |= load(filled, "listings", [("x", date(2024, 6, 30), "Ford", 5.0, "new", "active"), ("3", date(2023, 4, 1), "Fiat", 1.0, "new", "closed")], "meli_id string, fecha_snapshot date, marca string, precio double, condicion string, estado string", ["precio"], now)
    jobs.update_state(filled, touched)
    jobs.calculate_indicators(filled, now, interest, wages)
    for name in ("registrations", "production", "macro", "listings"):
        shutil.copytree(f"{filled.root}/{name}", tmp_path / "fresh" / name)
    fresh = Store(spark, str(tmp_path / "fresh"))
    jobs.update_state(fresh, {})
    jobs.calculate_indicators(fresh, now, interest, wages)
    assert values(fresh) == values(filled) and {v[0] for v in values(filled)} == {"rotacion_stock", "produccion_demanda", "tension_demanda", "accesibilidad", "atencion"}
    for name in (*rollups.ROLLED, "stock"):
        assert sorted(map(str, jobs.state(fresh, name).collect())) == sorted(map(str, jobs.state(filled, name).collect()))


def test_only_touched_months_are_read(filled, monkeypatch):
    read = []
    plain = Store.read

    def watched(self, table, schema=None, months=None):
        found = plain(self, table, schema, months)
        plan = found._jdf.queryExecution().executedPlan()
        plan.executeCollect()
        metrics = plan.collectLeaves().head().metrics()
        read.append((table, months, metrics.apply("numPartitions").value()))  # folders that the scan opened
        return found

    touched = sales(filled, [(date(2024, 3, 1), "Fiat", "0km", 999)], datetime(2024, 7, 1))
    monkeypatch.setattr(Store, "read", watched)
    jobs.update_state(filled, touched)
    assert [x for x in read if not x[0].startswith("state_")] == [("registrations", ["2024-03"], 1)]
    last = {r.marca: r.stock for r in jobs.state(filled, "stock").filter("fecha = '2024-06-01'").collect()}
    assert last["Fiat"] == sum(40 for _ in range(18)) - sum(10 * k + 4 for k in range(18)) - (999 - 144)


def test_a_run_without_news_touches_nothing(filled):
    before = sorted(map(str, jobs.state(filled, "stock").collect()))
    assert sales(filled, [], datetime(2024, 7, 1)) == {"registrations": []}
    jobs.update_state(filled, {"registrations": []})
    assert sorted(map(str, jobs.state(filled, "stock").collect())) == before
