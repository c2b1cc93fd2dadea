"""Brands in groups by k-means with fixed starting points, and a number of groups chosen by silhouette.

All is done on a frame of a row a brand: distances are expressions over the centres, which are the only thing that comes to the
driver (MOST_GROUPS rows of a few numbers for each number of groups), and all numbers of groups go through each pass together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from marketlens.sources.shared import materialise

FEATURES = ["volumen", "crecimiento", "precio", "participacion"]
MOST_GROUPS, MOST_PASSES = 6, 60

Centres = dict[int, list[list[float]]]


def brand_features(registrations: DataFrame, listings: DataFrame) -> DataFrame:
    """By brand: units, their change in percent (the data's last twelve months against the twelve before), mean price of its listings, share in percent.

    Brands that are never registered are left out; without twelve earlier months the change is 0, without listings the price is null."""
    months = registrations.filter("marca is not null").groupBy("marca", F.trunc("fecha", "MM").alias("mes")).agg(F.sum("cantidad").alias("n"))
    last = registrations.filter("marca is not null").agg(F.trunc(F.max("fecha"), "MM")).scalar()
    ago = F.months_between(last, F.col("mes")).cast("int")
    sums = [F.sum(F.when((ago >= a) & (ago < a + 12), F.col("n"))).cast("double") for a in (0, 12)]
    totals = months.groupBy("marca").agg(F.sum("n").cast("double").alias("volumen"), sums[0].alias("_now"), sums[1].alias("_was"))
    every = months.agg(F.sum("n").cast("double")).scalar()
    price = listings.filter("marca is not null").groupBy("marca").agg(F.avg(F.col("precio").cast("double")).alias("precio"))
    change = 100 * (F.coalesce("_now", F.lit(0.0)) - F.col("_was")) / F.nullif(F.col("_was"), F.lit(0.0))
    found = totals.join(price, "marca", "left")
    return found.select("marca", "volumen", F.round(F.coalesce(change, F.lit(0.0)), 4).alias("crecimiento"), F.round("precio", 4).alias("precio"), F.round(100 * F.col("volumen") / every, 4).alias("participacion"))


def standardised(rows: DataFrame, name: str, features: Sequence[str]) -> DataFrame:
    """name and x, an array of the features less their mean over their deviation; a missing one is the mean, one that is alike for all is 0."""
    parts = [f(F.col(c)) for c in features for f in (F.avg, F.stddev_pop)]
    stats = rows.agg(*(p.alias(f"_{k}") for k, p in enumerate(parts))).first()
    scaled = [F.coalesce((F.col(c) - stats[2 * k]) / stats[2 * k + 1], F.lit(0.0)) if stats[2 * k + 1] else F.lit(0.0) for k, c in enumerate(features)]
    return rows.select(name, F.array(*scaled).alias("x"))


def _square(x: Column, centre: Sequence[float]) -> Column:
    return sum(((x[k] - c) * (x[k] - c) for k, c in enumerate(centre)), F.lit(0.0))


def _nearest(x: Column, centres: Sequence[Sequence[float]]) -> Column:
    """The number of the nearest centre, of equal ones the first."""
    return F.array_min(F.array(*(F.struct(_square(x, c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centres))))["k"]


def starts(points: DataFrame, name: str, volume: str, most: int) -> list[list[float]]:
    """The point with most volume, and again and again the one that is farthest from those taken; ties by name."""
    taken = [points.orderBy(F.desc(volume), name).select("x").first()]
    while taken[0] is not None and len(taken) < most:
        away = F.least(*(_square(F.col("x"), t.x) for t in taken)) if len(taken) > 1 else _square(F.col("x"), taken[0].x)
        far: Row | None = points.withColumn("_away", away).filter("_away > 1e-12").orderBy(F.desc("_away"), name).select("x").first()
        if far is None:
            break
        taken.append(far)
    return [list(t.x) for t in taken if t is not None]


def fit(points: DataFrame, first: list[list[float]], dims: int) -> Centres:
    """k-means from the first k starting points, for each k from 2 on, until no centre moves; a group without points keeps its centre."""
    centres: Centres = {k: [list(c) for c in first[:k]] for k in range(2, len(first) + 1)}
    for _ in range(MOST_PASSES if centres else 0):
        put = F.array(*(F.struct(F.lit(k).alias("k"), _nearest(F.col("x"), c).alias("g")) for k, c in centres.items()))
        means = points.select("x", F.explode(put).alias("p")).groupBy("p.k", "p.g").agg(*(F.avg(F.col("x")[d]).alias(f"m{d}") for d in range(dims)))
        moved = 0.0
        for r in means.collect():  # MOST_GROUPS squared at most
            new = [r[f"m{d}"] for d in range(dims)]
            moved = max(moved, *(abs(a - b) for a, b in zip(new, centres[r.k][r.g], strict=True)))
            centres[r.k][r.g] = new
        if moved < 1e-9:
            break
    return centres


def silhouettes(points: DataFrame, centres: Centres, dims: int) -> dict[int, float]:
    """The mean silhouette of each number of groups, from squared distances; it takes sums by group, no pairs of points."""
    norm = sum((F.col("x")[d] * F.col("x")[d] for d in range(dims)), F.lit(0.0))
    put = F.array(*(F.struct(F.lit(k).alias("k"), _nearest(F.col("x"), c).alias("g")) for k, c in centres.items()))
    flat = points.select("x", norm.alias("norm"), F.explode(put).alias("p"))
    sums = {(r.k, r.g): r for r in flat.groupBy("p.k", "p.g").agg(F.count("*").alias("n"), F.avg("norm").alias("norm"), *(F.avg(F.col("x")[d]).alias(f"m{d}") for d in range(dims))).collect()}
    out = {}
    for k in centres:
        there = [g for g in range(k) if (k, g) in sums]
        if len(there) < 2:
            out[k] = 0.0
            continue
        mean_to = {g: F.col("norm") + sums[k, g].norm - 2 * sum((F.col("x")[d] * sums[k, g][f"m{d}"] for d in range(dims)), F.lit(0.0)) for g in there}
        score = F.lit(0.0)
        for g in there:
            n = sums[k, g].n
            own = mean_to[g] * n / (n - 1) if n > 1 else F.lit(0.0)
            others = [mean_to[h] for h in there if h != g]
            other = F.least(*others) if len(others) > 1 else others[0]
            value = (other - own) / F.nullif(F.greatest(other, own), F.lit(0.0)) if n > 1 else F.lit(0.0)
            score = F.when(F.col("p.g") == g, F.coalesce(value, F.lit(0.0))).otherwise(score)
        out[k] = flat.filter(F.col("p.k") == k).agg(F.avg(score)).first()[0]
    return out


def groups(rows: DataFrame, name: str = "marca", volume: str = "volumen", features: Sequence[str] = tuple(FEATURES), most: int = MOST_GROUPS) -> DataFrame:
    """rows with grupo (1 is that of the first starting point), the number of groups, its silhouette, and propio: whether the centre of its group is nearest.

    The number with the greatest silhouette is taken, of equal ones the smallest. Fewer than two different points are one group.
    """
    held = materialise(rows, "clusters-rows")
    points = materialise(standardised(held, name, features).join(held.select(name, F.col(volume).alias("_volume")), name), "clusters-points")
    dims = len(features)
    centres = fit(points, starts(points, name, "_volume", most), dims)
    if not centres:
        return held.withColumns({"grupo": F.lit(1), "grupos": F.lit(1), "silueta": F.lit(0.0), "propio": F.lit(True)})
    scores = silhouettes(points, centres, dims)
    best = min(scores, key=lambda k: (-round(scores[k], 9), k))
    put = points.select(name, "x", _nearest(F.col("x"), centres[best]).alias("_g"))
    means = {r["_g"]: [r[f"m{d}"] for d in range(dims)] for r in put.groupBy("_g").agg(*(F.avg(F.col("x")[d]).alias(f"m{d}") for d in range(dims))).collect()}
    order = sorted(means)
    own = put.withColumn("_near", F.element_at(F.array(*map(F.lit, order)), _nearest(F.col("x"), [means[g] for g in order]) + 1))
    numbered = own.select(name, (F.col("_g") + 1).alias("grupo"), F.lit(len(order)).alias("grupos"), F.lit(round(scores[best], 6)).alias("silueta"), (F.col("_g") == F.col("_near")).alias("propio"))
    return held.join(numbered, name)
