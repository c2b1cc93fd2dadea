"""Language, decontamination, quality and language-model scores on small texts."""

import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from marketlens.llm import decontamination, language, quality

SCHEMA = "doc_id long, text string, lang string, w string, uid int, score int"


def docs(spark, rows):
    return spark.createDataFrame([(k, t, lang, "x", 1, 2) for k, t, lang in rows], SCHEMA).repartition(3)


def sentences(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


A, B = ["the", "ing", "er", "and", "sh", "ow"], ["ción", "que", "os", "ll", "ñi", "ar"]


def corpus(rng, n):
    return [(k, sentences(rng, A if k % 2 else B, rng.randint(20, 120)), "aa" if k % 2 else "bb") for k in range(n)]


def test_language(spark):
    rng = random.Random(0)
    train = docs(spark, [*corpus(rng, 80), (None, "x", "aa"), (500, None, "bb"), (501, "zz", None)])
    model = language.train(train, F.lit(True))
    assert set(model.dictionaries) == {"aa", "bb"}
    test = [*corpus(rng, 60), (900, None, "aa"), (901, "", "aa"), (902, "123 !?", None), (903, "THE!! ANDER!! SHING!! THEOW!! ANDING!! ERTHE!! SHERAND!!", None), (None, "theing", None)]
    rows = {r.doc_id: r for r in language.classify(docs(spark, test), model).collect()}
    assert sum(rows[k].lang_pred == lang for k, _, lang in test[:60]) >= 58
    assert all(rows[k].lang_pred == "und" and rows[k].score == 0 and rows[k].rejected for k in (900, 901, 902))
    assert rows[903].lang_pred == "aa" and all(0 <= r.score <= 1 for r in rows.values())
    left = language.drop_rejected(docs(spark, test), model)
    assert {900, 901, 902}.isdisjoint(r.doc_id for r in left.collect()) and left.columns == SCHEMA.replace(",", "").split()[::2]


def test_every_label_is_learned(spark, monkeypatch):
    """One whose rows are all copies of a text, and one with a few short texts among very many long ones."""
    monkeypatch.setattr(language, "DICTIONARY_BYTES", 900)
    rng = random.Random(2)
    rows = [*corpus(rng, 40), *[(1, "ñandú ñu", "xx")] * 5000, *[(k, "zz " * 400 + str(k), "yy") for k in range(4000)], (1, "yo soy", "yy"), (2, "yo era", "yy")]
    model = language.train(docs(spark, rows), F.lit(True))
    assert set(model.dictionaries) == {"aa", "bb", "xx", "yy"} and model.dictionaries["xx"] == "ñandú ñu".encode()
    assert set(model.dictionaries["yy"].split(b"\n")) == {b"yo soy", b"yo era"}


def test_languages_by_brute_force(spark, monkeypatch):
    """Dictionaries by the docstring, and compressed sizes, in plain Python."""
    monkeypatch.setattr(language, "DICTIONARY_BYTES", 900)
    monkeypatch.setattr(language, "DOCS_PER_LANGUAGE", 5)
    rng = random.Random(11)
    train = [*corpus(rng, 60), (5, "the ing er and", "aa"), (5, "quite another text", "aa"), (7, "que os " * 400, "cc"), (8, "que ll " * 300, "cc"), *[(9, "theow again", "aa")] * 30]
    keys = {r.text: r.h for r in docs(spark, train).withColumn("h", F.xxhash64("text")).collect()}
    want = {}
    for lang in ("aa", "bb", "cc"):
        mine = {t for _, t, x in train if x == lang}
        near = sorted((t for t in mine if len(t.encode()) <= 900), key=keys.get)[:5]
        parts, left = [], 900
        for x in near or sorted(mine, key=lambda t: (len(t.encode()), keys[t]))[:1]:
            data = language.normalise(x)
            if len(data) < left or not parts:
                parts.append(data)
                left -= len(data) + 1
        want[lang] = b"\n".join(parts)
    model = language.train(docs(spark, train), F.lit(True))
    assert model.dictionaries == want and list(want) == ["aa", "bb", "cc"]
    test = [(k, t, None) for k, (_, t, _) in enumerate(corpus(rng, 30))] + [(40, "que the " * 900 + sentences(rng, A, 2000), None)]
    for r in language.classify(docs(spark, test), model).collect():
        text = next(t for k, t, _ in test if k == r.doc_id)
        data, sizes = language.normalise(text), []
        for lang, content in want.items():
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=3)
            coder = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=False)
            sizes.append((sum(len(coder.compress(data[at : at + language.CHUNK])) for at in range(0, len(data), language.CHUNK)), len(sizes), lang))
        low, second = sorted(sizes)[:2]
        assert (r.lang_pred, r.score) == (low[2], pytest.approx(1 - low[0] / second[0]))
    monkeypatch.setattr(language, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2 languages"):
        language.train(docs(spark, train), F.lit(True))


def test_language_without_labels(spark):
    model = language.train(docs(spark, [(1, "text", None)]), F.lit(True))
    assert [r.lang_pred for r in language.classify(docs(spark, [(1, "text", None)]), model).collect()] == ["und"]


def slow_tiles(a, b, width):
    """Greedy string tiling, step by step."""
    in_a, in_b, total = [False] * len(a), [False] * len(b), 0
    while True:
        best = (0, 0, 0)
        for x in range(len(a)):
            for y in range(len(b)):
                n = 0
                while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n] and not in_a[x + n] and not in_b[y + n]:
                    n += 1
                best = max(best, (n, -y, -x))
        n, y, x = best[0], -best[1], -best[2]
        if n < width:
            return total
        for k in range(n):
            in_a[x + k] = in_b[y + k] = True
        total += n


def test_tiles_cover_as_much_as_the_slow_way():
    rng = random.Random(4)
    for k in range(66):
        a, b = ([rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(5, 40 if k < 60 else 150))] for _ in range(2))
        got = decontamination.tiles(a, b)
        used_a, used_b = Counter(), Counter()
        for x, y, n in got:
            assert a[x : x + n] == b[y : y + n] and n >= 5
            used_a.update(range(x, x + n))
            used_b.update(range(y, y + n))
        assert max([0, *used_a.values(), *used_b.values()]) <= 1
        assert sum(n for _, _, n in got) == slow_tiles(a, b, 5)


def test_tiles_of_one_repeated_word():
    tracemalloc.start()
    assert decontamination.tiles([b"x"] * 200_000, [b"x"] * 1000) == [(0, 0, 1000)]
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
    assert decontamination.tiles([b"a"], [b"a"]) == [(0, 0, 1)] and decontamination.tiles([], [b"a"]) == decontamination.tiles([b"a"], []) == []


def test_words_are_parted_by_any_punctuation():
    assert decontamination.words_of("\u201cHello\u201d\u00a0wor\u00adld\u2014Caf\u00e9_1 \u4f60\u597d\u3002x") == ["hello".encode(), b"wor", b"ld", "café".encode(), b"1", "你好".encode(), b"x"]


def test_hashes_of_long_texts(monkeypatch):
    rng = random.Random(5)
    words = [str(rng.randrange(50)).encode() * rng.randint(1, 9) for _ in range(3000)]
    whole = decontamination.run_hashes(words)
    monkeypatch.setattr(decontamination, "CUT", 500)
    cut = decontamination.run_hashes(words)
    assert (whole == cut).all() and len(whole) == 2996
    runs = defaultdict(set)
    for k, h in enumerate(whole.tolist()):
        runs[tuple(words[k : k + 5])].add(h)
    assert all(len(x) == 1 for x in runs.values()) and len(set(whole.tolist())) == len(runs)
    assert len(decontamination.run_hashes([b"x" * 5000] * 6)) == 2


def test_contamination(spark):
    rng = random.Random(6)
    item = [f"w{rng.randrange(10**6)}" for _ in range(30)]
    noise = [f"n{k}" for k in range(400)]
    bench = spark.createDataFrame([(1, " ".join(item), 0), (2, None, 0), (3, "too few words", 0), (4, "Alone!", 0), (5, "?", 0), (1, " ".join(item), 0), (None, "null id but words enough here", 0)], "item_id long, text string, doc_id int")
    texts = [
        (10, " ".join(noise[:50] + item + noise[50:]), None), (11, " ".join(noise[:9] + item[15:] + noise[9:20] + item[:15]), None), (12, ", ".join(item).upper() + "!", None), (13, " ".join(item[:14] + noise), None),
        (14, " ".join(noise), None), (15, None, None), (16, "", None), (17, "it has too \u201cfew\u201d words", None), (19, "few too words", None), (20, "not alone", None), (18, "a null id, but words enough here; null id but words enough here", None), (None, " ".join(item), None),
    ]
    rows = decontamination.contamination(docs(spark, texts), bench).collect()
    assert sorted((r.doc_id or -1, r.item_id, r.coverage, r.n_tiles) for r in rows if r.item_id) == [(-1, 1, 1.0, 1), (10, 1, 1.0, 1), (11, 1, 1.0, 2), (12, 1, 1.0, 1), (17, 3, 1.0, 1), (20, 4, 1.0, 1)]
    assert [r.doc_id for r in rows if r.item_id is None] == [18]
    left = decontamination.drop_contaminated(docs(spark, texts), bench)
    assert sorted((r.doc_id or -1) for r in left.collect()) == [13, 14, 15, 16, 19]
    assert decontamination.contamination(docs(spark, texts), bench.filter("false")).count() == 0


def slow_kneser_ney(train, text):
    """log10 probability of each word, from plain dictionaries."""
    tri = Counter()
    for t in train:
        w = ["<s>", "<s>", *t.split()]
        tri.update(zip(w, w[1:], w[2:], strict=False))
    bi = Counter((v, w) for _, v, w in tri)
    uni = Counter(w for _, w in bi)

    def discounts(c):
        n = [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
        if not all(n):
            return [0.5, 0.75, 0.9]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]

    less = lambda c, d: c - d[min(c, 3) - 1]
    d1, d2, d3 = map(discounts, (uni, bi, tri))
    mass = lambda cells, d: sum(d[min(c, 3) - 1] for c in cells) / sum(cells)
    after2, after3 = defaultdict(list), defaultdict(list)
    for (v, _), c in bi.items():
        after2[v].append(c)
    for (u, v, _), c in tri.items():
        after3[u, v].append(c)
    spare = sum(d1[min(c, 3) - 1] for c in uni.values()) / sum(uni.values()) / (len(uni) + 1)

    def p(u, v, w):
        p1 = (less(uni[w], d1) / sum(uni.values()) if w in uni else 0) + spare
        p2 = ((less(bi[v, w], d2) / sum(after2[v]) if (v, w) in bi else 0) + mass(after2[v], d2) * p1) if v in after2 else p1
        return ((less(tri[u, v, w], d3) / sum(after3[u, v]) if (u, v, w) in tri else 0) + mass(after3[u, v], d3) * p2) if (u, v) in after3 else p2

    w = ["<s>", "<s>", *text.split()]
    return [math.log10(p(*x)) for x in zip(w, w[1:], w[2:], strict=False)], p, set(uni)


def test_kneser_ney(spark):
    rng = random.Random(7)
    train = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(5, 60))) for _ in range(30)]
    model = quality.train(spark.createDataFrame([(t,) for t in train], "t string"))
    texts = [(1, "a b c d e f g"), (2, "a zz b b b"), (3, "q"), (4, ""), (5, None), (6, "A  B\nC")]
    rows = {r.doc_id: r for r in quality.perplexities(docs(spark, [(k, t, None) for k, t in texts]), model).collect()}
    for k, t in texts:
        if not (t or "").split():
            assert rows[k].perplexity is None
            continue
        lp, p, vocabulary = slow_kneser_ney(train, t.lower())
        assert rows[k].perplexity == pytest.approx(10 ** (-sum(lp) / len(lp)), rel=1e-4)
    assert sum(p("a", "b", w) for w in vocabulary) + p("a", "b", "unknown") == pytest.approx(1)


def test_quality_stage(spark):
    rng = random.Random(8)
    good = [(k, sentences(rng, A, 40), "aa") for k in range(60)]
    bad = [(k, " ".join(str(rng.randrange(10**9)) for _ in range(40)), "aa") for k in range(100, 120)]
    odd = [(200, None, "aa"), (201, "", None), (None, "theing", None), (5, good[5][1], "aa")]
    rows = quality.classify(docs(spark, good + bad + odd), docs(spark, [*good[:50], (999, None, None)])).collect()
    assert len(rows) == len(good + bad + odd)
    kept = {r.doc_id for r in rows if r.kept}
    assert len(kept & {k for k, _, _ in good}) >= 55 and not kept & set(range(100, 120)) and not kept & {200, 201}
    assert quality.classify(docs(spark, bad), docs(spark, [])).count() == 20


def test_limits_by_brute_force(spark, monkeypatch):
    """Quantiles of held-out trusted documents by language, and what they keep."""
    monkeypatch.setattr(quality, "MIN_TRUSTED", 10)
    rng = random.Random(12)
    rows = [(k, sentences(rng, A, rng.randint(1, 60)), ["aa", "bb", None, "rare"][min(3, k % 4 if k % 40 else 3)]) for k in range(400)]
    found = quality.classify(docs(spark, rows), docs(spark, rows[:300]), quantile=0.9).collect()
    held = {r.doc_id for r in docs(spark, rows[:300]).filter(f"pmod(xxhash64(doc_id), {quality.HELD_OUT}) = 0").collect()}
    by = defaultdict(list)
    for r in found:
        if r.doc_id in held:
            by[r.lang or ""].append(r.perplexity)

    def at(values):
        return sorted(values)[max(0, math.ceil(0.9 * len(values)) - 1)]

    general = at([x for some in by.values() for x in some])
    for r in found:
        own = by[r.lang or ""]
        assert r.limit == pytest.approx(at(own) if len(own) >= 10 else general)
        assert r.kept == (r.perplexity <= r.limit)


def test_the_model_is_of_all_trusted_documents(spark, monkeypatch):
    """However small the bounds of a sample; most n-grams are met in the join, copies of a text too."""
    monkeypatch.setattr(quality, "TRAIN_DOCS", 1)
    monkeypatch.setattr(quality, "TRAIN_WORDS", 5000)
    monkeypatch.setattr(quality, "HEAD", 10, raising=False)
    rng = random.Random(14)
    rows = [(k, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(5, 40))), "aa") for k in range(60)]
    rows += [(70, rows[3][1], None), (71, "a zz b b b", None), (None, "a b", "aa")]
    trusted = docs(spark, rows[:40])
    held = {r.doc_id for r in trusted.filter(f"pmod(xxhash64(doc_id), {quality.HELD_OUT}) = 0").collect()}
    train = [t for k, t, _ in rows[:40] if k not in held]
    found = {r.doc_id: r.perplexity for r in quality.classify(docs(spark, [*rows, *rows[5:8]]), trusted).collect()}
    for k, t, _ in rows:
        lp, _, _ = slow_kneser_ney(train, t)
        assert found[k] == pytest.approx(10 ** (-sum(lp) / len(lp)), rel=1e-9)


def test_a_very_long_trusted_text_does_not_end_the_sample(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_WORDS", 100)
    docs = spark.createDataFrame([(i, "long " * 101 if i % 2 else f"some words {i}") for i in range(20)], "doc_id long, text string")
    assert {r.doc_id for r in quality.sample_of(docs).collect()} == set(range(0, 20, 2))
    with pytest.raises(ValueError, match="more than 100 words"):
        quality.sample_of(docs.filter("doc_id % 2 = 1"))
