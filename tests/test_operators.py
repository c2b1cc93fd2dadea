"""Filters, merges, fallbacks and calendars on small rows."""

from datetime import date, datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from marketlens.operators import explore, windows
from marketlens.operators.merge import dedupe_last, merge_upsert, summary, with_fallback

SCHEMA = "fecha date, marca string, cantidad int, updated_at timestamp_ntz"
D = [date(2024, m, 1) for m in range(1, 13)]


def frame(spark, rows):
    return spark.createDataFrame([(d, m, c, datetime(2024, 1, 1)) for d, m, c in rows], SCHEMA)


def test_filters_skip_what_is_not_given(spark):
    df = frame(spark, [(D[0], "Toyota", 1), (D[0], None, 2), (D[1], "Ford_X", 3)])
    assert explore.where(df, explore.like("marca", ""), explore.equals("cantidad", None)).count() == 3
    assert explore.where(df, explore.like("marca", "Todas")).count() == 3
    assert [r.cantidad for r in explore.where(df, explore.like("marca", "toy")).collect()] == [1]
    assert [r.cantidad for r in explore.where(df, explore.like("marca", "d_x")).collect()] == [3]
    assert explore.where(df, *explore.between("fecha", D[0], D[0])).count() == 2


def test_top_brands_nulls(spark):
    df = spark.createDataFrame([(D[0], "a", 5, "0km"), (D[0], None, 9, "0km"), (D[0], "b", 5, "0km"), (D[0], "b", 50, "usado")], "fecha date, marca string, cantidad int, tipo_vehiculo string")
    assert [tuple(r) for r in explore.top_brands(df, D[0], D[0]).collect()] == [(None, 9), ("a", 5), ("b", 5)]
    assert [tuple(r) for r in explore.top_brands(df, D[0], D[0], nulls=False, n=1).collect()] == [("a", 5)]


def test_histogram_of_one_value_and_of_nothing(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "precio double")
    assert [tuple(r) for r in explore.histogram(df).collect()] == [(0, 2, 5.0)]
    assert explore.histogram(df.filter("false")).count() == 0


def test_merge_actions(spark):
    target = frame(spark, [(D[0], "a", 1), (D[0], None, 2), (D[1], "k", 3)])
    batch = frame(spark, [(D[0], "a", 1), (D[0], None, 5), (D[2], "n", 7)])
    now = datetime(2024, 5, 5)
    rows = {(r.fecha, r.marca): r for r in merge_upsert(target, batch, ["fecha", "marca"], ["cantidad"], as_of=now).collect()}
    assert {k: (r.action, r.cantidad) for k, r in rows.items()} == {(D[0], "a"): ("unchanged", 1), (D[0], None): ("update", 5), (D[1], "k"): ("kept", 3), (D[2], "n"): ("insert", 7)}
    assert rows[D[0], "a"].updated_at == datetime(2024, 1, 1) and rows[D[0], None].updated_at == now


ROWS = st.lists(st.tuples(st.sampled_from(D[:3]), st.sampled_from(["a", "b", None]), st.integers(0, 3)), max_size=8)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(ROWS, ROWS)
def test_merge_properties(spark, old, new):
    key = ["fecha", "marca"]
    target, batch = (dedupe_last(frame(spark, rows), key, ["cantidad"]) for rows in (old, new))
    merged = merge_upsert(target, batch, key, ["cantidad"]).cache()
    actions = [r.action for r in merged.collect()]
    assert len(actions) == len({(d, m) for d, m, _ in old + new})
    assert sum(a != "kept" for a in actions) == len({(d, m) for d, m, _ in new})
    again = merge_upsert(merged.drop("action"), batch, key, ["cantidad"])
    assert {r.action for r in again.collect()} <= {"unchanged", "kept"}
    one = summary(frame(spark, new), batch, merged).first()
    assert one.leidos == len(new) and one.insertados == actions.count("insert") and one.estado == ("success" if new else "no_data")


def test_fallback(spark):
    a, b = frame(spark, []), frame(spark, [(D[0], "b", 1)])
    assert with_fallback([a, a], b).count() == 1
    assert [r.marca for r in with_fallback([a, frame(spark, [(D[0], "x", 1)])], b).collect()] == ["x"]


def test_growth_counts_missing_months(spark):
    df = frame(spark, [(D[0], "a", 10), (D[2], "a", 30), (D[3], "a", 15)])
    rows = {r.mes: r.intermensual for r in windows.growth(df, 1, "intermensual").collect()}
    assert rows == {D[0]: None, D[2]: None, D[3]: -50.0}
    assert {r.mes: r.x for r in windows.growth(df, 1, "x", ["marca"]).collect()} == rows


def test_kpi_without_rows(spark):
    r = windows.kpi_vs_previous(frame(spark, []), D[0], D[1]).first()
    assert (r.actual, r.anterior, r.variacion) == (None, None, None)
