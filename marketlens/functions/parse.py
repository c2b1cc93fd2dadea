"""Parsers and formatters of raw cells, as Column -> Column. Whatever doesn't parse is null; nothing throws under ANSI."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.schemas import MONTHS, SHORT_MONTHS


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def count_cell(text: Column) -> Column:
    """`1.200` or `1,200` -> 1200; no number: null."""
    return F.regexp_replace(F.trim(text), "[.,]", "").try_cast("int")


def digits_only(text: Column) -> Column:
    """All digits of the text as one number; none: 0."""
    return F.coalesce(F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit("")).try_cast("int"), F.lit(0))


def locale_decimal(text: Column) -> Column:
    """`1.234,56` -> 1234.5600."""
    return F.replace(F.replace(F.trim(text), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(18,4)")


def guarded_int(text: Column) -> Column:
    """Only digits -> int; anything else: null."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))


def _first_of(year: Column, month: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lit("01")), "yyyy-MM-dd")


def period_label(text: Column) -> Column:
    """`Ene-2024` (three letters count), `01/2024` or `2024-01` -> the month's first day."""
    name = F.left(F.lower(_found(text, "^([^-]*)-([0-9]{4})$", 1)), F.lit(3))
    number = F.array_position(F.array(*map(F.lit, SHORT_MONTHS)), name)
    by_name = F.when(number > 0, _first_of(_found(text, "^([^-]*)-([0-9]{4})$", 2), number.cast("string")))
    by_slash = _first_of(_found(text, "^([0-9]{1,2})/([0-9]{4})$", 2), _found(text, "^([0-9]{1,2})/([0-9]{4})$", 1))
    by_iso = _first_of(_found(text, "^([0-9]{4})-([0-9]{1,2})$", 1), _found(text, "^([0-9]{4})-([0-9]{1,2})$", 2))
    return F.when(_found(text, "^([^-]*)-([0-9]{4})$", 1).isNotNull() & (number > 0), by_name).when(text.contains("/"), by_slash).otherwise(by_iso)


def period_in_text(text: Column) -> Column:
    """`YYYY-MM` out of free text: year and month, month and year, or a Spanish month name with the first four digits."""
    year_first, month_first = _found(text, "[0-9]{4}[-_][0-9]{2}", 0), _found(text, "[0-9]{2}[-_][0-9]{4}", 0)
    named = F.array_position(F.transform(F.array(*map(F.lit, MONTHS)), lambda m: F.contains(F.lower(text), m)), True)
    return F.coalesce(
        F.translate(year_first, "_", "-"),
        F.concat(F.right(month_first, F.lit(4)), F.lit("-"), F.left(month_first, F.lit(2))),
        F.when(named > 0, F.concat(_found(text, "[0-9]{4}", 0), F.lit("-"), F.lpad(named.cast("string"), 2, "0"))),
    )


def period_start(period: Column) -> Column:
    """`YYYY-MM` -> the month's first day; no such month: null."""
    return F.try_to_date(F.concat(period, F.lit("-01")), "yyyy-MM-dd")


def period_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_of(day: Column) -> Column:
    return F.trunc(day, "MM")


def absolute_url(href: Column, base: str, listing: str) -> Column:
    """http... as it is, /x below the base, anything else below the listing's address."""
    return F.when(href.startswith("http"), href).when(href.startswith("/"), F.concat(F.lit(base), href)).otherwise(F.concat(F.lit(listing + "/"), href))


def report_format(href: Column) -> Column:
    return F.when(F.lower(href).contains(".pdf"), "pdf").otherwise("excel")


def is_report(href: Column) -> Column:
    return F.lower(href).rlike(r"\.pdf|\.xlsx|\.xls")


def attribute(attributes: Column, name: str) -> Column:
    """value_name of the last attribute of that id."""
    return F.try_element_at(F.filter(attributes, lambda a: a["id"] == name), F.lit(-1))["value_name"]


def instalment(principal: Column, yearly_rate: Column, months: int = 36) -> Column:
    """Constant instalment of a loan; yearly_rate in percent, a month being 30 of 360 days."""
    i = yearly_rate / 1200.0
    return F.when(i == 0, principal / months).otherwise(principal * i / (1 - F.pow(1 + i, F.lit(-months))))


def change_percent(now: Column, before: Column) -> Column:
    return 100.0 * (now - before) / F.nullif(before, F.lit(0))
