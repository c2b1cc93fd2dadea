"""Merged sketches against the exact numbers."""

import random
from datetime import date

from marketlens.operators import sketches

SCHEMA = "fecha_snapshot date, marca string, moneda string, modelo string, precio double"


def test_ranges_from_months(spark):
    rng = random.Random(8)
    rows = [(date(2023 + k % 2, rng.randint(1, 12), rng.randint(1, 28)), rng.choice(["a", "b", None]), "ARS", f"m{rng.randint(0, 3000)}", round(rng.lognormvariate(8, 1), 2)) for k in range(6000)]
    sums = sketches.by_month(spark.createDataFrame(rows, SCHEMA))
    part = [r for r in rows if date(2023, 4, 1) <= r[0] < date(2024, 3, 1)]
    found = sketches.within(sums, date(2023, 4, 1), date(2024, 2, 1))
    for quantile in (0.1, 0.5, 0.99):
        for r in sketches.price_ranking(found, quantile).collect():
            mine = sorted(x[4] for x in part if x[1] == r.marca)
            assert r.publicaciones == len(mine) and abs(r.precio_promedio - sum(mine) / len(mine)) < 0.01 and r.precio_maximo == mine[-1]
            assert abs(sum(x <= r.precio_cuantil for x in mine) / len(mine) - quantile) < 0.02
    one = sketches.kpis(found).first()
    models = len({x[3] for x in part})
    assert one.publicaciones == len(part) and one.marcas == 2 and abs(one.modelos - models) < 0.05 * models


def test_without_values(spark):
    rows = spark.createDataFrame([(date(2024, 1, 1), "a", "ARS", None, None), (date(2024, 1, 1), "b", "ARS", "m", 5.0)], SCHEMA)
    assert sorted((r.marca, r.publicaciones, r.precio_cuantil) for r in sketches.price_ranking(sketches.by_month(rows)).collect()) == [("a", 1, None), ("b", 1, 5.0)]
    none = sketches.by_month(rows.limit(0))
    assert sketches.price_ranking(none).count() == 0 and sketches.kpis(none).first().publicaciones == 0
