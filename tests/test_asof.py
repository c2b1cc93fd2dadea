"""As-of joins against brute force, whatever the ranges."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from marketlens.operators import asof


def expected(left, right):
    out = []
    for k, g, t in left:
        best = max(((when, v) for key, when, v in right if None not in (key, when, g, t) and key == g and when <= t), default=(None, None), key=lambda x: (x[0], x[1] is not None, x[1] or 0))
        out.append((k, g, t, *best))
    return sorted(out, key=str)


def run(spark, left, right, ranges=None):
    a = spark.createDataFrame(left, "k int, g string, t int").repartition(3)
    b = spark.createDataFrame(right, "g string, desde int, v int").repartition(2)
    return sorted(map(tuple, asof.as_of(a, b, ["g"], "t", "desde", ["v"], "cuando", ranges).collect()), key=str)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_as_of(spark, ranges):
    rng = random.Random(ranges)
    left = [(k, rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None, *range(60)])) for k in range(200)]
    right = [(rng.choice(["a", "b", "d", None]), rng.choice([None, *range(5, 90, 7)]), rng.choice([None, 1, 2, 3])) for _ in range(40)]
    assert run(spark, left, right, ranges) == expected(left, right)


def test_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(asof, "BROADCAST_POINTS", 3)
    left = [(k, "a", 5 if k % 3 else k) for k in range(90)]  # two thirds share a moment
    assert run(spark, left, [("a", 4, 1), ("a", 40, 2)]) == expected(left, [("a", 4, 1), ("a", 40, 2)])


def test_empty(spark):
    assert run(spark, [], [("a", 1, 1)]) == []
    assert run(spark, [(1, "a", 1)], []) == [(1, "a", 1, None, None)]


moments = st.integers(0, 12) | st.none()
keys = st.sampled_from(["a", "b", None])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), keys, moments), max_size=12), st.lists(st.tuples(keys, moments, st.integers(0, 3)), max_size=8), st.integers(1, 6))
def test_as_of_property(spark, left, right, ranges):
    assert run(spark, left, right, ranges) == expected(left, right)


def test_no_window_without_keys(spark):
    a = spark.createDataFrame([(1, "a", 3)], "k int, g string, t int")
    b = spark.createDataFrame([("a", 1, 1)], "g string, desde int, v int")
    plan = asof.last_known(a.select("g", "t"), b.selectExpr("g", "desde as t", "v as value"), ["g"], "t")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
