"""Exact and SimHash deduplication against brute force, with odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from marketlens.llm import common, exact_dedup, graph, near_copies, simhash
from marketlens.llm.common import attach

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n int, fp string, keep_id int"


def docs(spark, texts):
    return spark.createDataFrame([(k, t, None, None, 0, "x", 1, "y", 2) for k, t in texts], SCHEMA).repartition(3)


def words(rng, n):
    return [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(400)) for _ in range(n)]


TEXTS = [(5, "a  b"), (3, "a\n\tb"), (9, "a b"), (1, None), (2, ""), (4, " "), (6, "\x0b"), (7, "A b"), (8, "a b"), (10, "x" * 300 + "1"), (11, "x" * 300 + "2"), (12, "x" * 300 + "1"), (None, "a b"), (3, "a\n\tb")]


def test_exact(spark):
    rows = exact_dedup.label(docs(spark, TEXTS)).collect()
    assert len(rows) == len(TEXTS)
    groups = {}
    for k, t in TEXTS:
        if k is not None:
            groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t or ""), []).append(k)
    by_id = {k: (min(g), len(g), t) for t, g in groups.items() for k in g}
    for r in rows:
        if r.doc_id is None:
            assert (r.keep_id, r.group_size, r.kept) == (None, 1, True)
            continue
        keep, size, t = by_id[r.doc_id]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, size, r.doc_id == keep, hashlib.sha256(t.encode()).hexdigest())


def test_exact_stage_keeps_columns(spark):
    d = docs(spark, TEXTS)
    left = exact_dedup.drop_exact_copies(d)
    assert left.columns == d.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in left.collect()) == sorted((k is None, k) for k in [3, 3, 1, 4, 7, 8, 10, 11, None])


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_rows_are_dropped_not_ids(spark, monkeypatch, most):
    """A repeated id only goes with the text that is a copy; so too where dropped rows are too many to be handed out."""
    monkeypatch.setattr(common, "BROADCAST_IDS", most)
    rows = [(1, "a b c d"), (5, "a b c d"), (5, "a text of its own"), (6, "a  b c d"), (None, "a b c d"), (7, None), (8, ""), *[(k, f"text {k % 50} of many") for k in range(100, 300)]]
    for stage in (exact_dedup.drop_exact_copies, near_copies.drop_near_copies):
        d = docs(spark, rows)
        left = stage(d)
        kept = sorted((r.doc_id or 0, r.text or "") for r in left.collect())
        want = [(0, "a b c d"), (1, "a b c d"), (5, "a text of its own"), (7, ""), *([] if stage is exact_dedup.drop_exact_copies else [(8, "")]), *((k, f"text {k % 50} of many") for k in range(100, 150))]
        assert kept == want and left.columns == d.columns


def test_a_bitmap_misses_nothing(spark):
    keys = spark.range(0, 3000, 3).selectExpr("id AS n", "id * 7 AS p")
    rows = spark.range(3000).selectExpr("id AS n", "id * 7 AS p")
    hit = {r.n for r in common.may_be_in(rows, common.bitmap(keys, ["n", "p"]), ["n", "p"]).filter("_hit").collect()}
    assert hit >= set(range(0, 3000, 3)) and len(hit) < 1010


def test_exact_empty_table(spark):
    assert exact_dedup.label(docs(spark, [])).count() == 0
    assert exact_dedup.drop_exact_copies(docs(spark, [])).count() == 0


def test_attach_hot_and_cold(spark):
    left = spark.createDataFrame([(k, 0 if k % 2 else k) for k in range(600)], "i long, k long")
    right = left.groupBy("k").count().withColumnRenamed("count", "w")
    got = attach(left, right, ["k"], "w", 600, left["i"])
    assert sorted(map(tuple, got.collect())) == sorted((k, 0 if k % 2 else k, 301 if k % 2 or k == 0 else 1) for k in range(600))


def test_attach_deals_hot_rows_out(spark):
    """The salt is part of what rows are dealt out by."""
    left = spark.range(1000).selectExpr("id AS i", "id % 7 AS k")
    right = left.groupBy("k").count().withColumnRenamed("count", "w")
    plan = attach(left, right, ["k"], "w", 1000, left["i"])._jdf.queryExecution().optimizedPlan().toString()
    join = next(x for x in plan.splitlines() if "Join LeftOuter" in x and "_salt" in x)
    assert join.count("_salt") == 2


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(shape)
    edges = {"path": [(k, k + 1) for k in range(60)], "star": [(500, k) for k in range(80)], "none": [], "random": [(rng.randrange(90), rng.randrange(90)) for _ in range(60)]}[shape]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    rng = random.Random(1)
    for t in ["", None, "one", "Two Words", "É é ñ\x0b Ünï", "a a a a a a", " ".join(words(rng, 300)), "x " * 40_000]:
        assert simhash.fingerprint((t or "").encode()) == slow_fingerprint(t)


@pytest.mark.parametrize("k", [8, 14, 20, 40])
def test_anchors_meet(k):
    """Any two fingerprints that differ in up to four bits share an anchor; the numbers of replicas are as foretold."""
    rng = np.random.default_rng(k)
    a = rng.integers(0, 2**64, 120, dtype=np.uint64)
    b = a.copy()
    for row in range(len(b)):
        for bit in rng.choice(64, row % 5, replace=False):
            b[row] ^= np.uint64(1 << int(bit))
    assert sum(simhash.blocks(k)) == 64 and all(n % 2 for n in simhash.blocks(k))
    at = [{} for _ in range(2)]
    for side, fp in enumerate((a, b)):
        for row, anchor in zip(*(x.tolist() for x in simhash.anchors(fp, k, 2)), strict=True):
            at[side].setdefault(row, set()).add(anchor)
    assert all(at[0][row] & at[1][row] for row in range(len(a)))
    assert abs(np.mean([len(x) for x in at[0].values()]) / simhash.replicas_each(k, 2) - 1) < 0.3


def near(rng, base, changes):
    w = list(base)
    for _ in range(changes):
        w[rng.randrange(len(w))] = "new" + str(rng.randrange(10**6))
    return " ".join(w)


@pytest.mark.parametrize("group", [4096, 8])
def test_near_duplicates(spark, monkeypatch, group):
    """Components equal those of all pairs, also where a group is cut into blocks."""
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "MEAN_GROUP", 16)
    rng = random.Random(2)
    base = [words(rng, 400) for _ in range(30)]
    texts = [(k, near(rng, base[k % 30], k % 4)) for k in range(150)] + [(200, None), (201, "  "), (202, "solo"), (203, "SOLO"), (None, "solo"), (7, near(rng, base[7], 1))]
    rows = simhash.near_duplicates(docs(spark, texts)).collect()
    assert len(rows) == len(texts)
    want = [(k, slow_fingerprint(t)) for k, t in texts if k is not None]
    root = list(range(len(want)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(want)):
        for j in range(i):
            if bin(want[i][1] ^ want[j][1]).count("1") <= 4 or want[i][0] == want[j][0]:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for x in range(len(want)):
        least[find(x)] = min(least.get(find(x), 10**9), want[x][0])
    expected = sorted((k, f"{fp:016x}", least[find(x)]) for x, (k, fp) in enumerate(want))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in rows if r.doc_id is not None) == expected
    assert [r.component_id for r in rows if r.doc_id is None] == [None]


def test_near_stage(spark):
    rng = random.Random(3)
    base = words(rng, 500)
    d = docs(spark, [(4, " ".join(base)), (2, " ".join(base) + " end"), (9, " ".join(words(rng, 500)))])
    left = near_copies.drop_near_copies(d)
    assert sorted(r.doc_id for r in left.collect()) == [2, 9] and left.columns == d.columns
    assert near_copies.drop_near_copies(docs(spark, [])).count() == 0


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_clashing_columns(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_IDS", most)
    names = ["_gone", "_row", "id", "h", "_hit", "_word", "node", "root", "fp"]
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(k, t, *range(len(names))) for k, t in ((1, text), (2, text), (3, text + " more"), (4, None), (None, text))], ["doc_id", "text", *names])
    left = exact_dedup.drop_exact_copies(df)
    assert left.columns == df.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "3", "4", "None"]
    left = near_copies.drop_near_copies(df)
    assert left.columns == df.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "4", "None"]
