"""Pages, lookups by id and text search over laid out tables: the same rows as plain queries, and how little is opened for them."""

import random

import pytest
from pyspark.sql import functions as F

from marketlens.sources.layout import PLACE, IdTable, SortedTable, TrigramIndex


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = [(f"i{k:05}", rng.randint(0, 500), rng.choice(["Corolla XEi", "Gol Trend", "corolla cross", "Fiesta", "208", None, "Ö"])) for k in range(4000)] + [("same", 7, "Gol Trend")] * 300
    return spark.createDataFrame(data, "id string, precio int, modelo string").repartition(5).cache()


@pytest.fixture(scope="module")
def table(rows):
    return SortedTable.build(rows, [F.col("precio").asc(), F.col("id").asc()], 40)


def scanned(df):
    """Folders that the scan of a plan opened, and rows that it gave."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    metrics = plan.collectLeaves().head().metrics()
    return metrics.apply("numPartitions").value(), metrics.apply("numOutputRows").value()


def test_pages_by_place(rows, table):
    every = sorted((r.precio, r.id) for r in rows.collect())
    assert len(table) == len(every) and len(table.parts) > 20
    for offset, size in ((0, 10), (9, 1), (2000, 25), (4290, 10), (4299, 50), (9000, 5)):
        assert [(r.precio, r.id) for r in table.page_at(offset, size).collect()] == every[offset : offset + size]


def test_a_late_page_opens_no_more_than_the_first(table):
    opened = []
    for page in (0, 400):
        table.opened.clear()
        table.page_at(10 * page, 10).collect()
        opened.append(len(table.opened))
        table.opened.clear()
        table.page_after(10 * page - 1, 10).collect()
        opened.append(len(table.opened))
    assert max(opened) <= 2, opened
    assert scanned(table._read([p for p, first, n in table.parts if first <= 4000 < first + n]))[0] == 1


def test_pages_that_go_on(rows, table):
    """A filtered walk over all pages gives every row once, in order."""
    every = sorted((r.precio, r.id) for r in rows.filter("modelo = 'Fiesta' and precio < 60").collect())
    place, found = -1, []
    while True:
        page = table.page_after(place, 17, (F.col("modelo") == "Fiesta") & (F.col("precio") < 60)).collect()
        if not page:
            break
        found += [(r.precio, r.id) for r in page]
        place = page[-1][PLACE]
    assert found == every


def test_text_search(rows, table):
    index = TrigramIndex.build(rows, "modelo", 8)
    for text, want in (("COROLLA", {"Corolla XEi", "corolla cross"}), ("rol", {"Corolla XEi", "corolla cross"}), ("l t", {"Gol Trend"}), ("20", {"208"}), ("ö", {"Ö"}), ("none of it", set()), ("", {"Corolla XEi", "Gol Trend", "corolla cross", "Fiesta", "208", "Ö"})):
        assert {r.modelo for r in index.holding(text).collect()} == want
    page = table.page_after(-1, 12, None, index.holding("corolla")).collect()
    every = sorted((r.precio, r.id) for r in rows.filter("lower(modelo) like '%corolla%'").collect())
    assert [(r.precio, r.id) for r in page] == every[:12]


def test_lookup_opens_the_folders_of_its_ids(spark, rows):
    table = IdTable.build(rows, "id", 16, spread=2)
    found = table.get("i00042")
    assert [(r.id, r.precio) for r in found.collect()] == [(r.id, r.precio) for r in rows.filter("id = 'i00042'").collect()]
    assert scanned(found)[0] == 1
    assert scanned(table.get("i00042x")) == (1, 0)  # the Bloom filters know that it is in no file, though ids before and after it are
    assert table.get("same").count() == 300
    ids = spark.createDataFrame([("i00001",), ("i00001",), ("nobody",)], "id string")
    looked_up = table.lookup(ids).collect()
    assert sorted((r.id, r.precio is None) for r in looked_up) == [("i00001", False), ("nobody", True)]


def test_empty_tables(spark, rows):
    none = rows.limit(0)
    table = SortedTable.build(none, [F.col("id").asc()], 4)
    assert len(table) == 0
    assert TrigramIndex.build(none, "modelo", 2)
