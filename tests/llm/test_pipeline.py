"""The registered corpus queries over the smallest tables, and the pipeline against its stages by brute force."""

import re
import zlib

import pytest
from conftest import DATA
from oracle_tools import assert_same, connect
from tokenizers import Tokenizer

import corpus_pipeline
from marketlens.llm import decontamination, queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert_same(queries.queries()[name](spark, DATA), connect(DATA), queries.oracle_sql()[name])


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_language_accuracy(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op4_language(spark, DATA).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id: r.held_out for r in rows} == {k: zlib.crc32(str(k).encode()) % 4 == 2 for k in docs}
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) / len(held) > 0.9


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [(r.item_id, decontamination.words_of(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    first = {r.doc_id: r.text for r in corpus_pipeline.identify_language(spark, docs, DATA).collect()}
    assert len(first) > 0.97 * docs.count()
    alone = {}
    for k in sorted(first):
        alone.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", first[k]), k)
    left = sorted(alone.values())
    words = {k: first[k].lower().split() for k in left}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for k, w in words.items()}
    root = {k: k for k in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in left:
        for b in left:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    left = [k for k in left if find(k) == k]

    def leaks(text):
        words = decontamination.words_of(text)
        return any(sum(n for _, _, n in decontamination.tiles(words, w)) >= 0.5 * len(w) for _, w in bench if w)

    left = [k for k in left if not leaks(first[k])]
    full = Tokenizer.from_file(queries.VOCABULARY)
    want = {k: len(full.encode(first[k], add_special_tokens=False).ids) + 1 for k in left}
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == want
    assert sum(r.length for r in got) == sum(want.values())
    assert all(set(docs.columns) == set(f(spark, docs, DATA).columns) for _, f in corpus_pipeline.STAGES[:-1])
