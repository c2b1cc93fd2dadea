"""Tokens equal the library's, pieces tile documents and sequences, windows hold the sources' shares."""

import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketlens.llm import common, language, packing, tokens
from marketlens.llm.queries import VOCABULARY

SCHEMA = "doc_id long, text string, source string, q string, uid int, place string"


def docs(spark, rows):
    return spark.createDataFrame([(k, t, s, "q", 1, "p") for k, t, s in rows], SCHEMA).repartition(3)


ODD = ["naïve ŒUVRE İstanbul ΣΑΣ <|endoftext|>x a\x1cb ½² don't WE'LL  x ét", "", " \n", "日本語テキスト 1234 ４", "<|EndOfText|> <|startoftext|>", "a,b,,c. d.; (e) f!! g?! he's", "é\u0301 a\u030a A\u030a", "\u2003x\xa0y", "tab\tnew\nline", "WORD. Word, word; ÀÉß.", "ǅ ŉ ﬁ"]


def test_tokens_equal_the_library(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 64)
    rng, t, full = random.Random(0), tokens.WordTokenizer(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    alphabet = "abcdefgh  ,.'!éñß12 \nABÉ<|>"
    for text in [*ODD, *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for _ in range(60)), "same words " * 500]:
        assert t.encode(text).tolist() == full.encode(text, add_special_tokens=False).ids, text


def slow_schedule(totals, units, window):
    """Rounds of deficit round-robin, one by one: what each round serves of each queue."""
    left, credit, rounds = list(totals), None, []
    while any(left):
        on = [j for j, x in enumerate(left) if x]
        if credit is None or credit[0] != on:
            credit, begun, base = (on,), len(rounds), [t - x for t, x in zip(totals, left, strict=True)]
            credit = (on, begun, base)
        whole = sum(units[j] for j in on)
        m = len(rounds) + 1 - credit[1]
        served = [0] * len(totals)
        for j in on:
            upto = min(totals[j], credit[2][j] + (m * window * units[j] + packing.credits_of(len(totals), whole)[j]) // whole)
            served[j] = upto - (totals[j] - left[j])
            left[j] = totals[j] - upto
        rounds.append(served)
    return rounds


@pytest.mark.parametrize("totals", [[1000, 10, 333], [5], [1, 1, 1], [700, 700], [10_000, 1, 77, 4000], [0, 3, 0, 900]])
def test_schedule(totals):
    shares = [t / sum(totals) for t in totals]
    for weights in (shares, [1.0] * len(totals)):
        plan = packing.Schedule(totals, weights, 64)
        units = packing.units_of(totals, weights)
        places, line = [[] for _ in totals], 0
        for served in slow_schedule(totals, units, 64):
            for j, n in enumerate(served):
                places[j] += range(line, line + n)
                line += n
        rng = random.Random(len(totals))
        for j, t in enumerate(totals):
            cuts = sorted({0, t, *(rng.randrange(t + 1) for _ in range(6))})
            runs = np.array(list(zip(cuts, cuts[1:], strict=False)) or [(0, 0)])
            run, at, size, seq, offset = plan.pieces(np.full(len(runs), j), runs[:, 0], runs[:, 1] - runs[:, 0], 16)
            assert (size > 0).all() and (offset + size <= 16).all()
            got = [(runs[k, 0] + x + i, q * 16 + o + i) for k, x, m, q, o in zip(run, at, size, seq, offset, strict=True) for i in range(m)]
            assert got == list(enumerate(places[j]))


def test_pack(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "g", "Δ!"]) for _ in range(rng.randint(0, 90))), "big" if k % 3 else f"s{k % 4}") for k in range(120)]
    rows += [(500, None, "big"), (501, "", None), (None, "null id", "big"), (7, "again", "big"), (7, "again", "big"), (502, "long " * 5000, "s1")]
    got = packing.pack(docs(spark, rows), VOCABULARY, length=64, window=256, with_ids=True).collect()
    full = Tokenizer.from_file(VOCABULARY)
    want = Counter((k, tuple([*full.encode(t or "", add_special_tokens=False).ids, 1])) for k, t, _ in rows)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        pieces[r.doc_id].append((r.start, ids.tolist(), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for k, n in Counter(k for k, _ in want).items():
        mine = sorted(pieces[k], key=lambda p: p[0])
        if n == 1 and sum(c for (d, _), c in want.items() if d == k) == 1:
            assert sum((p[1] for p in mine), []) == list(next(ids for d, ids in want if d == k))
            assert {p[2] for p in mine} == {sum(len(p[1]) for p in mine)}
    assert sum(r.length for r in got) == sum(len(ids) * n for (_, ids), n in want.items())
    last = max(sequences)
    for s, parts in sequences.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 64 or s == last and at <= 64
    assert sorted(sequences) == list(range(last + 1))


def test_windows_hold_the_shares(spark):
    rows = [(k, "word " * 50, "a" if k < 100 else "b" if k < 150 else "c") for k in range(200)]
    got = packing.pack(docs(spark, rows), VOCABULARY, length=64, window=640)
    source = {k: s for k, _, s in rows}
    by_window = defaultdict(Counter)
    for r in got.collect():
        by_window[(r.sequence_id * 64 + r.offset) // 640][source[r.doc_id]] += r.length
    full = [c for w, c in by_window.items() if w < max(by_window)]
    assert all(abs(c["a"] / 640 - 0.5) < 0.12 and abs(c["b"] / 640 - 0.25) < 0.12 for c in full)


def test_every_sequence_holds_the_shares_of_many_sources(spark, monkeypatch):
    """1500 sources, one with a share of nine tenths, given others in merged queues; and each in proportion where it has a queue."""
    rows = [(k, "word " * 9, f"s{k}") for k in range(1500)] + [(2000 + k, "word " * 299, "main") for k in range(45)]
    got = packing.pack(docs(spark, rows), VOCABULARY, length=64, shares={"main": 0.9}).collect()
    ours, rest = Counter(), Counter()
    for r in got:
        (ours if r.doc_id >= 2000 else rest)[r.sequence_id] += r.length
    until = 45 * 300 // 58  # main runs out then
    assert all(54 <= ours[s] <= 62 and rest[s] for s in range(until - 5))
    assert sum(ours.values()) == 45 * 300 and sum(rest.values()) == 1500 * 10
    few = [(k, "word " * 29, f"s{k % 8}") for k in range(320)]
    by = defaultdict(Counter)
    for r in packing.pack(docs(spark, few), VOCABULARY, length=64).collect():
        by[r.sequence_id][r.doc_id % 8] += r.length
    assert all(7 <= by[s][j] <= 9 for s in by if s < max(by) for j in range(8))


def test_other_vocabularies_go_through_the_whole_tokenizer():
    t = tokens.WordTokenizer(VOCABULARY)
    assert t.by_words
    settings = json.loads(t.full.to_str())
    assert not tokens.by_words(settings | {"normalizer": {"type": "NFD"}}) and not tokens.by_words(settings | {"pre_tokenizer": None})
    t.by_words = False
    assert [t.encode(x).tolist() for x in ODD] == [t.full.encode(x, add_special_tokens=False).ids for x in ODD]


def test_pack_nothing(spark):
    assert packing.pack(docs(spark, []), VOCABULARY).count() == 0


def test_workers_keep_words_for_tokens_alone():
    batch = pa.RecordBatch.from_arrays([pa.array(["x"])], ["t"])
    tokens.tokenizer(VOCABULARY).encode("some words")
    assert len(list(common.pieces(iter([batch]), give_back=True, keep=True))) == 1
    assert tokens.tokenizer.cache_info().currsize == 1
    assert len(list(common.pieces(iter([batch]), give_back=True))) == 1
    assert tokens.tokenizer.cache_info().currsize == 0


def test_number_of_kept_words_decides_nothing():
    few, many = tokens.WordTokenizer(VOCABULARY, 16), tokens.WordTokenizer(VOCABULARY)
    text = " ".join(f"word{k % 37} {k}." for k in range(400))
    assert few.encode(text).tolist() == many.encode(text).tolist()
    assert len(few.now.place) <= 16 and len(few.past.place) <= 16


def test_no_plain_rows_are_handed_to_executors(spark, monkeypatch):
    """They would need Python workers of a second kind."""
    rows, handed, make = docs(spark, [(1, "one two", "a"), (2, "three", None)]), [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: handed.append(type(data)) or make(self, data, *a, **b))
    assert {r.doc_id for r in packing.pack(rows, VOCABULARY).collect()} == {1, 2}
    labelled = rows.withColumn("lang", F.col("place"))
    assert list(language.train(labelled, F.lit(True)).dictionaries) == ["p"]
    assert handed and set(handed) == {pa.Table}
