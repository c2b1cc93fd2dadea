"""The Pitman-Yor model against plain dictionaries: seating, scores, base scores, and that it sums to one."""

import math
import random
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
import xxhash

from marketlens.llm import pitman_yor as py

SCHEMA = "doc_id long, text string, lang string, w string, uid int, score int, slot int"


def docs(spark, rows):
    return spark.createDataFrame([(k, t, None, "x", 1, 2, 3) for k, t in rows], SCHEMA).repartition(3)


def _seatings(c):
    """All ways to seat c customers, as table sizes in order of seating, by restricted growth."""
    for choice in product(range(c), repeat=c):
        most = -1
        for x in choice:
            if x > most + 1:
                break
            most = max(most, x)
        else:
            yield Counter(choice)


@pytest.mark.parametrize(("c", "others", "p", "d"), [(4, 3, 0.2, 0.6), (6, 0, 0.05, 0.3), (5, 40, 0.7, 0.9)])
def test_tables_follow_their_exact_distribution(c, others, p, d):
    weight = defaultdict(float)
    for tables in _seatings(c):
        w = 1.0
        for size in tables.values():
            w *= p * math.prod(j - d for j in range(1, size))
        for i in range(len(tables)):
            w *= py.STRENGTH + d * (others + i)
        weight[len(tables)] += w
    n = 40_000
    got = Counter(py.draw(np.full(n, c), np.full(n, float(others)), np.full(n, p), d, np.arange(n).astype(np.uint64), 3).astype(int).tolist())
    total = sum(weight.values())
    for t, w in weight.items():
        assert got[t] / n == pytest.approx(w / total, abs=0.01)


@pytest.mark.parametrize(("c", "others", "p", "d"), [(100, 10, 0.1, 0.5), (400, 2000, 0.2, 0.7), (300, 5, 0.001, 0.8), (900, 90_000, 0.04, 0.9), (700, 60, 0.3, 0.2)])
def test_many_customers(c, others, p, d):
    """Beyond EXACT customers tables follow the exact distribution closely."""
    s = np.array([0.0])  # log S(n, 1..n)
    for n in range(1, c):
        t = np.arange(1, n + 2)
        with np.errstate(divide="ignore"):
            s = np.logaddexp(np.concatenate([[-np.inf], s]), np.concatenate([s, [-np.inf]]) + np.log(n - d * np.minimum(t, n)))
    w = s + np.cumsum(np.log((py.STRENGTH + d * (others + np.arange(c))) * p))
    w = np.exp(w - w.max()) / np.exp(w - w.max()).sum()
    mean = (w * np.arange(1, c + 1)).sum()
    wide = math.sqrt((w * (np.arange(1, c + 1) - mean) ** 2).sum())
    n = 20_000
    got = py.draw(np.full(n, c), np.full(n, float(others)), np.full(n, p), d, np.arange(n).astype(np.uint64), 3)
    assert got.min() >= 1 and got.max() <= c
    assert abs(got.mean() - mean) < max(0.1, 0.3 * wide) and got.std() == pytest.approx(wide, rel=0.2, abs=0.1)
    assert py.draw(np.array([10**9]), np.zeros(1), np.full(1, 0.5), 0.5, np.arange(1).astype(np.uint64), 0)[0] >= 1


def _one(c, others, p, d, key, sweep):
    """Tables of one dish, by loops."""
    if c == 1:
        return 1.0
    if c > py.EXACT:
        return float(py.draw(np.array([c]), np.array([float(others)]), np.array([p]), d, np.array([key], np.uint64), sweep)[0])
    s = {1: {1: 1.0}}
    for n in range(1, c):
        s[n + 1] = {t: s[n].get(t - 1, 0.0) + (n - d * t) * s[n].get(t, 0.0) for t in range(1, n + 2)}
    w, pulls = [], 1.0
    for t in range(1, c + 1):
        pulls *= (py.STRENGTH + d * (others + t - 1)) * p
        w.append(s[c][t] * pulls)
    u, run = float(py.uniform(np.array([key], np.uint64), sweep, 1)[0]) * sum(w), 0.0
    for t, x in enumerate(w, 1):
        run += x
        if run > u:
            return float(t)
    return float(c)


def _slow_scores(train, texts):
    """log10 probabilities of texts by the docstring, with dictionaries."""
    split = lambda t: (t or "").lower().split()
    words = Counter(w for t in train for w in split(t))
    head = sorted((w for w in words if words[w] > 1), key=lambda w: (-words[w], w))
    number = {w: i for i, w in enumerate(head)}
    rare_id, end, width = len(head), len(head) + 1, len(head) + 2

    def pairs(t):
        before = end
        for w in [*split(t), None]:
            yield before, end if w is None else number.get(w, rare_id), w
            before = None if w is None else number.get(w, py._TAIL | xxhash.xxh64_intdigest(w.encode()) >> 22)

    menus = defaultdict(Counter)
    for t in train:
        for u, x, _ in pairs(t):
            menus[u][x] += 1
    cells = [c for m in menus.values() for c in m.values()]
    d = py._discount(cells.count(1), cells.count(2))
    key = lambda u, x: int(py.mix(np.array([u << py._DISH | x]))[0])
    tables = {(u, x): 1.0 for u, m in menus.items() for x in m}

    def root(opened, was, sweep):
        d0 = py._discount((opened == 1).sum(), (opened == 2).sum())
        now = (opened > 0).astype(float)
        if sweep is not None:
            now = np.array([_one(int(o), was.sum() - was[x], 1 / width, d0, int(py.mix(np.array([x]))[0]), sweep) if o else 0.0 for x, o in enumerate(opened)])
        return ((opened - d0 * now + (1 + d0 * now.sum()) / width) / (1 + opened.sum())).astype(np.float32), now

    def opened():
        return np.bincount([x for _, x in tables], list(tables.values()), width) if tables else np.zeros(width)

    p0, t0 = root(opened(), np.zeros(width), None)
    samples = []
    for sweep in range(py.BURN_IN + py.SAMPLES):
        sums = Counter()
        for (u, _), t in tables.items():
            sums[u] += t
        tables = {(u, x): _one(menus[u][x], sums[u] - t, float(p0[x]), d, key(u, x), sweep) for (u, x), t in tables.items()}
        p0, t0 = root(opened(), t0, sweep)
        if sweep >= py.BURN_IN:
            samples.append((dict(tables), p0))
    rare = {w: c for w, c in words.items() if w not in number}
    base = 1 / (len(rare) + 1)
    rare_d = py._discount(len(rare), 0)

    def inside(w):  # rare words of short tests occur once: each has one table
        return ((w in rare) * (1 - rare_d) + (1 + rare_d * len(rare)) * base) / (1 + len(rare))

    def log_p(u, x):
        total = 0.0
        for at, p in samples:
            sums = sum(at[u, y] for y in menus[u]) if u in menus else 0.0
            c = menus[u][x] if u in menus else 0
            n = sum(menus[u].values()) if u in menus else 0
            total += (c - d * at.get((u, x), 0.0) + (1 + d * sums) * float(p[x])) / (1 + n)
        return math.log10(total / len(samples))

    return [sum(log_p(u, x) + (math.log10(inside(w)) if x == rare_id else 0.0) for u, x, w in pairs(t)) for t in texts]


def _texts():
    rng = random.Random(10)
    common = ["the", "of", "and", "to", "a"]
    word = lambda: rng.choice(common) if rng.random() < 0.6 else f"w{rng.randrange(60)}" if rng.random() < 0.8 else f"x{rng.randrange(10**6)}"
    train = [" ".join(word() for _ in range(rng.randint(3, 60))) for _ in range(40)] + ["", None, "The THE of", "the"]
    test = [*train[:6], "zzz qqq zzz", None, "", "The THE the", " ".join(["the"] * 50), f"{train[0].split()[-1]} the unheard of"]
    return train, test


@pytest.mark.parametrize(("slot", "split", "chunk"), [(1 << 22, 1 << 21, 1 << 22), (50, 40, 100)])
def test_scores_by_brute_force(spark, monkeypatch, slot, split, chunk):
    """Small slots and chunks, and contexts dealt out over many slots, change nothing."""
    for name, value in (("SLOTS", 3), ("SLOT", slot), ("SPLIT", split), ("CHUNK", chunk)):
        monkeypatch.setattr(py, name, value)
    train, test = _texts()
    model = py.train(docs(spark, list(enumerate(train))))
    assert (model.vocabulary.parts.max() > 1) == (split < 100)
    rows = py.score(docs(spark, [*enumerate(test), (0, test[0]), (None, test[1])]), model).collect()
    assert len(rows) == len(test) + 2
    want = _slow_scores(train, test)
    for r in rows:
        assert r.score == pytest.approx(want[1 if r.doc_id is None else r.doc_id], abs=1e-4)
    counts = Counter(w for t in train for w in [*(t or "").lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        tokens = [*(test[1 if r.doc_id is None else r.doc_id] or "").lower().split(), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), abs=1e-6)


def test_the_model_sums_to_one():
    """Over all dishes, in restaurants that there are and in one that there isn't."""
    rng = np.random.default_rng(3)
    width, contexts = 50, 7
    pairs = np.unique(rng.integers(0, contexts, 120) << py._DISH | rng.integers(0, width, 120))
    n = rng.integers(1, 60, len(pairs))
    roots = [(x := rng.random(width) + 0.01) / x.sum() for _ in range(py.BURN_IN + py.SAMPLES + 1)]
    for context in (0, 3, 99):
        asked = np.int64(context) << py._DISH | np.arange(width)
        assert (10 ** py.pair_log_p(asked, (pairs, n), roots, 0.6)).sum() == pytest.approx(1)
    counts = {1: 2, 2: 1, 5: 1, 200: 1}
    rare = {"discount": 0.4, "base": 1 / 6, "customers": 209, "tables": [5.0]}
    for s in range(py.BURN_IN + py.SAMPLES):
        rare["tables"].append(sum(m * float(np.dot(*py._shares(c, rare["tables"][-1], 1 / 6, 0.4))) for c, m in counts.items()))
    rare["tables"][py.BURN_IN + 1 :] = [sum(m * float(np.dot(*py._shares(c, rare["tables"][s], 1 / 6, 0.4))) for c, m in counts.items()) for s in range(py.BURN_IN, py.BURN_IN + py.SAMPLES)]
    assert sum(m * 10 ** py.rare_log_p(c, rare) for c, m in counts.items()) + 10 ** py.rare_log_p(0, rare) == pytest.approx(1, rel=0.02)
    drawn = [py.rare_tables(counts, 5.0, 1 / 6, 0.4, s) for s in range(300)]
    assert np.mean(drawn) == pytest.approx(sum(m * float(np.dot(*py._shares(c, 5.0, 1 / 6, 0.4))) for c, m in counts.items()), rel=0.05)


def test_scores_without_training(spark):
    model = py.train(docs(spark, []))
    rows = py.score(docs(spark, [(1, "a b"), (2, None)]), model).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows} == {(3, 0, 0, 0.0), (1, 0, 0, 0.0)} and all(math.isfinite(r.score) for r in rows)
    assert py.score(docs(spark, []), model).count() == 0


def test_a_rare_word_is_one_row_of_its_text(spark, monkeypatch):
    """Repetitions are counted before rows are written and shuffled."""
    from marketlens.llm import pitman_yor

    kept, write = {}, pitman_yor.materialise
    monkeypatch.setattr(pitman_yor, "materialise", lambda df, name: kept.setdefault(name, write(df, name)))
    docs = spark.createDataFrame([(1, "a b a b"), (2, "zz zz zz yy")], "doc_id long, text string")
    pitman_yor.score(docs, pitman_yor.train(docs.filter("doc_id = 1")))
    assert sorted((r.w, r.n) for r in kept["lm-rows"].filter("w is not null").collect()) == [(b"yy", 1), (b"zz", 3)]
