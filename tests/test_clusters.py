"""Groups of brands against k-means and silhouettes in plain Python."""

import random
from datetime import date

import numpy as np
import pytest

from marketlens.operators import clusters


def plain(points, volume, most):
    names = sorted(points)
    x = np.array([points[n] for n in names], float)
    sd = x.std(axis=0)
    z = np.where(sd > 0, (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1), 0.0)
    first = min(range(len(names)), key=lambda i: (-volume[names[i]], names[i]))
    taken = [z[first]]
    while len(taken) < most:
        away = np.min([((z - t) ** 2).sum(axis=1) for t in taken], axis=0)
        if away.max() <= 1e-12:
            break
        taken.append(z[min(range(len(names)), key=lambda i: (-round(away[i], 12), names[i]))])
    best = None
    for k in range(2, len(taken) + 1):
        centres = np.array(taken[:k])
        for _ in range(100):
            put = ((z[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([z[put == g].mean(axis=0) if (put == g).any() else centres[g] for g in range(k)])
            if np.allclose(new, centres, atol=1e-10):
                break
            centres = new
        d = ((z[:, None] - z[None]) ** 2).sum(axis=2)
        s = []
        for i in range(len(z)):
            own = put == put[i]
            if own.sum() == 1:
                s.append(0.0)
                continue
            a = d[i][own].sum() / (own.sum() - 1)
            b = min(d[i][put == g].mean() for g in set(put.tolist()) - {put[i]})
            s.append((b - a) / max(a, b) if max(a, b) else 0.0)
        score = round(float(np.mean(s)), 9)
        if best is None or score > best[0]:
            best = score, dict(zip(names, (put + 1).tolist(), strict=True)), k
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_groups(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(30):
        base = [(0, 0), (9, 1), (4, 9)][k % 3]
        rows.append((f"m{k:02}", float(rng.randint(1, 50)), base[0] + rng.random(), base[1] + rng.random()))
    df = spark.createDataFrame(rows, "marca string, volumen double, a double, b double").repartition(3)
    found = clusters.groups(df, features=("a", "b"), most=5).collect()
    score, put, k = plain({r[0]: r[2:] for r in rows}, {r[0]: r[1] for r in rows}, 5)
    assert {r.marca: r.grupo for r in found} == put and k == 3
    assert all(r.propio and r.grupos == 3 and abs(r.silueta - score) < 1e-5 for r in found)


def test_few_points(spark):
    schema = "marca string, volumen double, crecimiento double, precio double, participacion double"
    same = spark.createDataFrame([("a", 1.0, 2.0, None, 3.0), ("b", 1.0, 2.0, None, 3.0)], schema)
    assert {(r.grupo, r.propio) for r in clusters.groups(same).collect()} == {(1, True)}
    two = spark.createDataFrame([("a", 1.0, 2.0, None, 3.0), ("b", 9.0, 2.0, 5.0, 3.0)], schema)
    assert {r.grupo for r in clusters.groups(two).collect()} == {1, 2}
    assert clusters.groups(same.limit(0)).count() == 0


def test_features(spark):
    sold = spark.createDataFrame([("a", date(2020, 1, 1), 10), ("a", date(2021, 1, 1), 15), ("b", date(2021, 1, 1), 75), (None, date(2022, 1, 1), 9)], "marca string, fecha date, cantidad int")
    listed = spark.createDataFrame([("a", 4.0), ("a", 8.0), ("c", 1.0)], "marca string, precio double")
    assert sorted(map(tuple, clusters.brand_features(sold, listed).collect())) == [("a", 25.0, 50.0, 6.0, 25.0), ("b", 75.0, 0.0, None, 75.0)]
