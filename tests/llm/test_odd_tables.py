"""Empty tables, and tables with further columns whose names are those that operators use inside."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from marketlens.llm import decontamination, language, pitman_yor, quality, queries, simhash, url_filter

NAMES = ["id", "h", "node", "w", "n", "t", "fp", "root", "score", "total", "word", "tokens", "queue", "part", "_row", "_gone", "_salt", "key", "size"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXT = " ".join(f"palabra{k % 23} de{k} la casa" for k in range(40))
LONG = " ".join(f"la casa{k} de palabra{k % 23}" for k in range(20_000))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def few(spark):
    rows = [(1, TEXT, "es", "a"), (2, TEXT, "es", "a"), (3, "the quick brown fox jumps over the lazy dog again and again", "en", "b"), (4, None, None, None), (None, TEXT, "es", "a"), (5, "", "en", "b")]
    return spark.createDataFrame([(*r, 1, *range(len(NAMES))) for r in rows], DOCS + "".join(f", `{n}` int" for n in NAMES))


def test_empty_documents(spark, none):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert decontamination.contamination(none, bench).count() == 0 and decontamination.contamination(none, bench.limit(0)).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert language.classify(none, language.train(none, F.lit(True))).count() == 0
    assert quality.classify(none, none.select("doc_id")).count() == 0
    assert pitman_yor.score(none, pitman_yor.train(none)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judge(pages, queries.URL_RULES).count() == 0


def test_clashing_names(spark, few):
    bench = spark.createDataFrame([(1, TEXT, 5)], "item_id long, text string, doc_id int")
    assert {r.doc_id for r in decontamination.contamination(few, bench).select("doc_id").collect()} >= {1, 2}
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(few).collect() if r.doc_id in (1, 2)} == {(1, 1), (2, 1)}
    model = language.train(few, F.lit(True))
    assert {r.doc_id: r.lang_pred for r in language.classify(few, model).collect() if r.doc_id in (1, 4)} == {1: "es", 4: "und"}
    assert quality.classify(few, few.filter("doc_id < 4").select("doc_id")).count() == 6
    assert pitman_yor.score(few, pitman_yor.train(few)).count() == 6


@pytest.mark.parametrize("kind", ["empty", "clashing"])
def test_pipeline_on_odd_tables(spark, tmp_path, none, few, kind):
    docs = none if kind == "empty" else few.unionByName(spark.createDataFrame([(9, LONG, "es", "a", 1, *range(len(NAMES)))], few.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = {r.doc_id for r in pieces}
    if kind == "empty":
        assert left == set()
    else:
        assert {1, 3, 9} <= left and not {2, 4, 5} & left, left
