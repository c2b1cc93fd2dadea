"""Edge cases of the parsers."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketlens.functions import parse


def of(spark, f, values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.x for r in rows.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_count_cell(spark):
    assert of(spark, parse.count_cell, ["1.200", "1,200", "-", "", "-5", None, " 7 "]) == [1200, 1200, None, None, -5, None, 7]


def test_digits_only(spark):
    assert of(spark, parse.digits_only, ["15.000", "12.5", "-5", None, "n/a", "99999999999999"]) == [15000, 125, 5, 0, 0, 0]


def test_locale_decimal(spark):
    assert of(spark, parse.locale_decimal, ["1.234,56", "abc", None, "0,5"]) == [Decimal("1234.5600"), None, None, Decimal("0.5000")]


def test_period_label(spark):
    good = ["Ene-2024", "01/2024", "2024-01", "Enero-2024", "ene-2024"]
    bad = ["01-2024", "Set-2024", "2024-01-15", "ene 2024", "13/2024", "Ene-24", "", None, "2024-13"]
    assert of(spark, parse.period_label, good) == [date(2024, 1, 1)] * len(good)
    assert of(spark, parse.period_label, bad) == [None] * len(bad)


def test_period_in_text(spark):
    cases = {
        "Estadísticas Enero 2024": "2024-01", "produccion_2024_01.pdf": "2024-01", "reporte-03-2024.xlsx": "2024-03", "03-2024-15": "2024-15", "mayo": None, "": None,
        "DICIEMBRE de 2023": "2023-12", "2024-99": "2024-99", "enero y marzo 2020": "2020-01",
    }
    assert of(spark, parse.period_in_text, list(cases)) == list(cases.values())
    assert of(spark, parse.period_in_text, [None]) == [None]


def test_period_start(spark):
    assert of(spark, parse.period_start, ["2024-02", "2024-99", None]) == [date(2024, 2, 1), None, None]


def test_absolute_url(spark):
    f = lambda c: parse.absolute_url(c, "http://base", "http://base/list")
    assert of(spark, f, ["http://a/x.pdf", "/x.pdf", "x.pdf", None]) == ["http://a/x.pdf", "http://base/x.pdf", "http://base/list/x.pdf", None]


def test_guarded_int(spark):
    assert of(spark, parse.guarded_int, ["2020", "45000 km", "", None, "1e3"]) == [2020, None, None, None, None]


def test_attribute_last_wins(spark):
    row = spark.sql("SELECT array(named_struct('id','BRAND','value_name','a'), named_struct('id','BRAND','value_name','b')) AS a")
    got = row.select(parse.attribute(F.col("a"), "BRAND").alias("x"), parse.attribute(F.col("a"), "MODEL").alias("y")).first()
    assert (got.x, got.y) == ("b", None)


def test_instalment(spark):
    rows = spark.createDataFrame([(3600.0, 0.0), (1000.0, 12.0)], "p double, r double")
    got = [r.c for r in rows.select(parse.instalment(F.col("p"), F.col("r")).alias("c")).collect()]
    assert got[0] == pytest.approx(100.0) and got[1] == pytest.approx(1000 * 0.01 / (1 - 1.01**-36))
