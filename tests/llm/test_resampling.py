"""Resampling, personal data and the Merkle manifest against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from conftest import DATA
from oracle_tools import assert_same, connect
from pyspark.sql import functions as F

from marketlens.llm import common, merkle, pii, queries, resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op13_merkle_manifest"])
def test_same_rows_as_sql(spark, duck, name):
    assert_same(queries.queries()[name](spark, DATA), duck, queries.oracle_sql()[name])


# --- places ----------------------------------------------------------------------------------------------------------


def test_places(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaab"), rng.randint(0, 5)) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, x int").repartition(5)
    for by in (["g"], []):
        found = common.placed(df, by, [F.col("x").desc()], "t").collect()
        for g in {r.g for r in found} if by else {None}:
            mine = sorted((r._place, r.x) for r in found if not by or r.g == g)
            assert [p for p, _ in mine] == list(range(len(mine))) and [x for _, x in mine] == sorted((x for _, x in mine), reverse=True)
    assert common.placed(df.limit(0), ["g"], [F.col("x").asc()], "t").count() == 0


# --- resampling ------------------------------------------------------------------------------------------------------


def features_of(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return w, [zlib.crc32(f.encode()) % 10000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def drawn(rows, target, percent, least):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features_of(text)[1])
    for text in target:
        t.update(features_of(text)[1])
    every = sum(s.values()) + 10000, sum(t.values()) + 10000
    out, scored = {}, []
    for k, text in rows:
        w, own = features_of(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * every[0] / ((s[b] + 1) * every[1]))) for b in own]
        weight = sum(gain) // len(own) if own else 0
        score = None
        if k is not None:
            h = int(hashlib.sha256(f"7:{k}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out[k] = [len(own), weight, score, None]
        if len(w) >= least and k is not None:
            scored.append((-score, k))
    for place, (_, k) in enumerate(sorted(scored)[: percent * len(scored) // 100]):
        out[k][3] = place + 1
    return out


@pytest.mark.parametrize("long", [1 << 22, 37])
def test_resampling(spark, monkeypatch, long):
    """Also with texts cut into parts of a few words, which changes nothing."""
    monkeypatch.setattr(resampling, "LONG", long)
    rng = random.Random(9)
    words = ["the", "The", "öl", "x9", "ÄB", "a-b", "c\x00d", " ", "ß", "e" * 60]
    rows = [(k, rng.choice(" \n.,")[0].join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(80)]
    rows += [(80, None), (81, ""), (82, "!!! ..."), (83, "the " * 3000), (84, rows[0][1]), (85, rows[0][1]), (None, "the öl " * 30)]
    target = ["the the öl", "x9 x9", None, ""]
    df = spark.createDataFrame([(k, t, 1, "s") for k, t in rows], "doc_id long, text string, n_words int, bucket string").repartition(4)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    found = {r.doc_id: [r.n_features, r.weight, r.score, r.rank] for r in resampling.resample(df, goal, percent=40, min_words=10).collect()}
    assert found == drawn(rows, target, 40, 10)
    taken = resampling.sample(df, goal, percent=40, min_words=10)
    assert taken.columns == df.columns and {r.doc_id for r in taken.collect()} == {k for k, v in found.items() if v[3]}


def test_resampling_of_little(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(df, df).count() == 0
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "d")], "doc_id long, text string")
    rows = resampling.resample(twice, df, percent=100, min_words=1).collect()
    assert sorted(r.rank for r in rows) == [1, 2, 3] and len({r.score for r in rows if r.doc_id == 1}) == 1


# --- personal data ---------------------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    return kind == "email" or (9 <= len(digits) <= 15 if kind == "phone" else 13 <= len(digits) <= 19 and pii.luhn(digits))


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.luhn("79927398713")


def test_base_spans():
    rng = random.Random(5)
    bits = ["@", "a", ".", "-", "1", "2", "25", "255", "256", "+", "+1", " ", "(", ")", "b.c", "é", "4111111111111111", "411", "%", "_", "::", ":", "ff", " at ", " dot ", "tel: "]
    bits += ["DE89370400440532013000", "mailto:", "a%40b.com", "＠", "(at)", "/", " ", "😀"]
    for _ in range(8000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 24)))
        found = pii.find(text)
        assert [x[:3] for x in found if x[3]] == plain(text)
        for kind in pii.KINDS:
            own = [x for x in found if x[0] == kind]
            assert all(a[2] <= b[1] for a, b in zip(own, own[1:])) and all(0 <= x[1] < x[2] <= len(text) for x in own)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("an 4111111111111111 5500000000000004 x", "card", ["4111111111111111", "5500000000000004"]),
        ("4111 1111 1111 1111 2024", "card", ["4111 1111 1111 1111"]),
        ("4111.1111.1111.1111", "card", ["4111.1111.1111.1111"]),
        ("4111–1111–1111–1111", "card", ["4111–1111–1111–1111"]),
        ("4111111111111112", "card", []),
        ("97.51.17.173 4111111111111111", "card", ["4111111111111111"]),
        ("+1 (826) 555-4081 190.137.223.204", "phone", ["+1 (826) 555-4081"]),
        ("+1 (826) 555-4081 +1 (843) 555-7672", "phone", ["+1 (826) 555-4081", "+1 (843) 555-7672"]),
        ("+1 826 555 4081 4111111111111111", "phone", ["+1 826 555 4081"]),
        ("tel:030-1234567, hotel 1234567", "phone", ["030-1234567"]),
        ("Tel. 030 1234567; Telefon: (030) 12345-67", "phone", ["030 1234567", "(030) 12345-67"]),
        ("call (826) 555-4081 or f(826) 555-4081", "phone", ["(826) 555-4081"]),
        ("in 1998.10.20.30.40 x", "ip", ["10.20.30.40"]),
        ("10.20.30 and 300.1.2.3", "ip", []),
        ("fe80::1ff:fe23:4567:890a and 2001:db8::1", "ip", ["fe80::1ff:fe23:4567:890a", "2001:db8::1"]),
        ("std::vector at 12:30:45, a::b, x::1", "ip", []),
        ("josé@correo.ejemplo.es.", "email", ["josé@correo.ejemplo.es"]),
        ("josé.álvarez@correo.ejemplo.es.", "email", ["josé.á", "lvarez@correo.ejemplo.es"]),
        ("ann@exämple.de, ann@mail.exämple.de", "email", ["ann@exämple.de", "ann@mail.ex", "ämple.de"]),
        ("ann (at) example (dot) org; bob[at]example.com", "email", ["ann (at) example (dot) org", "bob[at]example.com"]),
        ("ann at example dot com, meet at noon dot", "email", ["ann at example dot com"]),
        ("mailto:ann%40example.com", "email", ["ann%40example.com"]),
        ("@home a@b x@", "email", []),
        ("IBAN DE89 3704 0044 0532 0130 00, DE89370400440532013001", "iban", ["DE89 3704 0044 0532 0130 00"]),
        ("ES9121000418450200051332", "iban", ["ES9121000418450200051332"]),
    ],
)
def test_further_spans(text, kind, found):
    assert [text[s:e] for k, s, e, _ in pii.find(text) if k == kind] == found


def test_long_texts_stay_linear():
    for text in ("1 " * 200_000, "a@" * 200_000, "1." * 200_000, "+1 " * 100_000, "a" * 500_000 + "@" + "a" * 500_000, "::" * 100_000, " at " * 100_000, "tel " * 100_000, "(at)" * 60_000, "4111.1111." * 50_000):
        pii.find(text)


def test_personal_data(spark):
    rows = [(1, "a@b.c 1.2.3.4"), (2, None), (3, ""), (None, "x +1 826 555 4081"), (1, "a@b.c 1.2.3.4"), (4, "😀 a@b.c " * 3), (5, "4111111111111111 5500000000000004")]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, spans string").repartition(3)
    found = [(r.doc_id, [tuple(s)[:3] for s in r.spans]) for r in pii.spans(df).collect()]
    key = lambda x: (str(x[0]), x[1])
    assert sorted(found, key=key) == sorted(((k, [x[:3] for x in pii.find(t)]) for k, t in rows), key=key)
    clean = pii.redact(df)
    assert clean.columns == df.columns
    assert {r.doc_id: r.text for r in clean.collect()} == {1: "[email] [ip]", 2: None, 3: "", None: "x [phone]", 4: "😀 [email] " * 3, 5: "[card] [card]"}
    assert pii.spans(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).count() == 0


def test_personal_data_query(spark, duck):
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    for r in queries.op12_personal_data(spark, DATA).collect():
        base = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in base) for k in PATTERNS)
        assert r.spans == ",".join(f"{k}:{s}:{e}" for k, s, e, _ in pii.find(texts[r.doc_id]))


# --- manifest --------------------------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if c is None else f"{len(str(c).encode())}:{c}" for c in row))


def levels_of(leaves, fanout):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + fanout]) for k in range(0, len(out[-1]), fanout)])
    return out


def others(levels, k, fanout):
    out = []
    for level in levels[:-1]:
        first = k - k % fanout
        out += [d for j, d in enumerate(level[first : first + fanout], first) if j != k]
        k //= fanout
    return out


def manifest_of(rows, fanout):
    groups = sorted({r[1] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    sets = [sorted((r for r in rows if r[1] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for g in groups]
    lower = [levels_of([leaf_of(r) for r in s], fanout) for s in sets]
    upper = levels_of([x[-1][0] for x in lower], fanout)
    return [
        (str(r[0]), str(r[1]), leaf_of(r), lower[j][-1][0], upper[-1][0], h(*others(lower[j], k, fanout), *others(upper, j, fanout)))
        for j, s in enumerate(sets) for k, r in enumerate(s)
    ]


@pytest.mark.parametrize("fanout", [2, 3])
@pytest.mark.parametrize("size", [1, 2, 41])
def test_manifest(spark, fanout, size):
    rng = random.Random(size)
    rows = [(k if k % 13 else None, rng.choice([None, "", "a", "é", "a", "a"]), rng.choice(["x", None, "ü" * 50, ""])) for k in range(size)]
    rows += rows[5:9]
    df = spark.createDataFrame([(*r, 1) for r in rows], "digest long, tree string, leaves string, n int").repartition(3)
    cells = [F.col("digest"), F.col("tree"), F.col("leaves")]
    found = merkle.verify(merkle.manifest(df, "digest", "tree", {"own": merkle.leaf(cells), "changed": merkle.leaf([*cells[:2], F.lit("?")])}, fanout), "own")
    shown = found.select("digest", "tree", *(F.lower(F.hex(c)) for c in ("leaves.own", "subroot", "root", "folded_root")), merkle.proof(F.col("path")), "verified").collect()
    assert sorted((str(r[0]), str(r[1]), r[2], r[3], r[4], r[6]) for r in shown) == sorted(manifest_of(rows, fanout))
    assert all(r[5] == r[4] and r.verified for r in shown)
    if size > 2:
        assert not any(r.verified for r in merkle.verify(found, "changed").collect())


def test_manifest_of_nothing(spark):
    df = spark.createDataFrame([], "a long, b string")
    assert merkle.verify(merkle.manifest(df, "a", "b", {"own": merkle.leaf([F.col("a")])}), "own").count() == 0
