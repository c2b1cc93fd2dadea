"""Readers of landed raw data: pages, report grids and sheets, JSON series, quotes and listings, and CSV loans.

Each takes a DataFrame of raw rows and returns records; a row that doesn't parse never stops the others. Readers named _rows keep it,
marked with the reason (see operators.rejects), the others leave it out.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens import schemas
from marketlens.functions import parse
from marketlens.operators.rejects import RAW, REASON, good, marked


class _Table:
    """Rows of cells as they come: whether a header, text, columns and rows that it spans."""

    def __init__(self, classes: list[str], title: str):
        self.classes, self.title, self.rows, self.cell = classes, title, [], None

    def end_cell(self) -> None:
        if self.cell:
            header, text, wide, high = self.cell
            self.rows[-1].append((header, "".join(text).strip(), wide, high))
        self.cell = None

    def grid(self) -> list[list[tuple[bool, str]]]:
        """The rows with every spanned place filled."""
        out, above = [], {}  # column -> rows still to fill and the cell
        for row in self.rows:
            line, cells = [], iter(row)
            while True:
                if (left := above.pop(len(line), None)) is not None:
                    rows, cell = left
                    if rows > 1:
                        above[len(line)] = rows - 1, cell
                    line.append(cell)
                elif (cell := next(cells, None)) is not None:
                    header, text, wide, high = cell
                    for _ in range(wide):
                        if high > 1:
                            above[len(line)] = high - 1, (header, text)
                        line.append((header, text))
                else:
                    break
            out.append(line)
        return out

    def headers(self, grid: list[list[tuple[bool, str]]]) -> list[str]:
        """Of each column, its header cells from the lowest header row up: `Ene` under `2024` is `Ene-2024`."""
        top = [line for line in grid if line and all(header for header, _ in line)]
        width = max(map(len, top), default=0)
        columns = [[line[k][1] for line in reversed(top) if k < len(line) and line[k][1]] for k in range(width)]
        return ["-".join(dict.fromkeys(column)) for column in columns]


class _Tables(HTMLParser):
    """The tables of a class, nested ones too, with the last heading before or the caption inside."""

    def __init__(self, wanted: str):
        super().__init__(convert_charrefs=True)
        self.wanted, self.tables, self.open, self.heading, self.title = wanted, [], [], "", None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        have = dict(attrs)
        if tag == "table":
            classes = (have.get("class") or "").split()
            self.open.append(_Table(classes, " ".join([self.heading, *classes, have.get("id") or ""])))
            if self.wanted in classes:
                self.tables.append(self.open[-1])
        elif tag in ("caption", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.title = []
        elif self.open and tag == "tr":
            self.open[-1].end_cell()
            self.open[-1].rows.append([])
        elif self.open and tag in ("th", "td"):
            table = self.open[-1]
            table.end_cell()
            if not table.rows:
                table.rows.append([])
            wide, high = (min(int(n), 1000) if (n := have.get(k) or "").isdecimal() and int(n) else 1 for k in ("colspan", "rowspan"))
            table.cell = tag == "th", [], wide, high

    def handle_data(self, data: str) -> None:
        if self.title is not None:
            self.title.append(data)
        elif self.open and self.open[-1].cell:
            self.open[-1].cell[1].append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("caption", "h1", "h2", "h3", "h4", "h5", "h6") and self.title is not None:
            text, self.title = "".join(self.title), None
            if tag == "caption" and self.open:
                table = self.open[-1]
                table.title = " ".join([text, *table.classes])
            else:
                self.heading = text
        elif self.open and tag in ("th", "td", "tr"):
            self.open[-1].end_cell()
        elif self.open and tag == "table":
            self.open.pop().end_cell()


def html_tables(pages: DataFrame, wanted: str = "estadisticas") -> DataFrame:
    """pages(url, html) -> url, table_no, title (heading or caption, classes and id), headers, row_no (the header row is 0), cells.

    Cells that span columns or rows stand in every place; a table within a cell is a table of its own."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for url, page in zip(frame["url"], frame["html"], strict=True):
                reader = _Tables(wanted)
                reader.feed(page or "")
                for k, table in enumerate(reader.tables):
                    table.end_cell()
                    grid = table.grid()
                    headers = table.headers(grid)
                    rows = ((n, [text for _, text in line]) for n, line in enumerate(grid) if n and not all(header for header, _ in line))
                    out += [(url, k, table.title, headers, n, cells) for n, cells in rows]
            yield pd.DataFrame(out, columns=["url", "table_no", "title", "headers", "row_no", "cells"])

    return pages.select("url", "html").mapInPandas(read, "url string, table_no int, title string, headers array<string>, row_no int, cells array<string>")


def registrations_rows(pages: DataFrame, kind: str | None = "0km", source: str = "FACCARA") -> DataFrame:
    """Wide tables, a brand a row and a month a column, -> a marked record a cell; cells that are empty or a dash are no records.

    Without a kind, tables whose title speaks of used vehicles have those, the others new ones."""
    wide = html_tables(pages).filter(F.size("cells") >= 2)
    kind_of = F.lit(kind) if kind else F.when(F.lower("title").contains("usad"), "usado").otherwise("0km")
    cells = wide.select(kind_of.alias("tipo_vehiculo"), F.element_at("cells", 1).alias("marca"), "headers", F.posexplode(F.slice("cells", 2, 2**30)).alias("i", "cell"))
    head = F.try_element_at("headers", F.col("i") + 2)
    read = cells.select(parse.period_label(head).alias("fecha"), "tipo_vehiculo", "marca", parse.count_cell(F.col("cell")).alias("cantidad"), head.alias("head"), F.trim("cell").alias("cell"))
    read = read.filter("cell not in ('', '-')")
    reasons = {"sin encabezado": F.col("head").isNull(), "periodo": F.col("fecha").isNull(), "cantidad": F.col("cantidad").isNull()}
    found = marked(read, reasons, F.to_json(F.struct("marca", "head", "cell")))
    return found.select(
        "fecha", F.year("fecha").alias("anio"), F.month("fecha").alias("mes"), "tipo_vehiculo", "marca", "cantidad", F.lit(source).alias("fuente"),
        parse.period_of(F.col("fecha")).alias("periodo_reportado"), REASON, RAW,
    )


def registrations_from_pages(pages: DataFrame, kind: str | None = "0km", source: str = "FACCARA") -> DataFrame:
    """The good records of registrations_rows()."""
    return good(registrations_rows(pages, kind, source))


def page_links(pages: DataFrame, base: str, listing: str) -> DataFrame:
    """pages(page_id, url, html) -> page_id, pos, href, texto, and the absolute address."""
    anchor = r'(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"[^>]*>(.*?)</a>'
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(anchor), F.lit(0))).alias("pos", "a"))
    links = found.select("page_id", "pos", F.regexp_extract("a", anchor, 1).alias("href"), F.trim(F.regexp_replace(F.regexp_extract("a", anchor, 2), "<[^>]*>", "")).alias("texto"))
    return links.withColumn("direccion", parse.absolute_url(F.col("href"), base, listing))


def report_index(links: DataFrame, base: str, listing: str) -> DataFrame:
    """links(href, texto) -> url, periodo, formato, texto of those that are reports with a period, newest first."""
    reports = links.filter(parse.is_report(F.col("href"))).withColumn("periodo", parse.period_in_text(F.concat("texto", F.lit(" "), "href")))
    found = reports.filter("periodo is not null")
    shown = found.select(parse.absolute_url(F.col("href"), base, listing).alias("url"), "periodo", parse.report_format(F.col("href")).alias("formato"), "texto")
    return shown.orderBy(F.desc("periodo"), "url", "texto")


def _production(rows: DataFrame, terminal: Column, made: Column, exported: Column, reasons: dict[str, Column], raw: Column) -> DataFrame:
    day = parse.period_start(F.col("periodo"))
    found = rows.select(day.alias("fecha"), terminal.alias("terminal"), made.alias("unidades_producidas"), exported.alias("unidades_exportadas"), F.col("periodo").alias("periodo_reportado"), raw.alias("_raw"), *(c.alias(f"_{k}") for k, c in reasons.items()))
    named = {k: F.col(f"_{k}") for k in reasons} | {"periodo": F.col("fecha").isNull()}
    return marked(found, named, F.col("_raw")).select("fecha", F.year("fecha").alias("anio"), F.month("fecha").alias("mes"), "terminal", "unidades_producidas", "unidades_exportadas", F.lit("ADEFA").alias("fuente"), "periodo_reportado", REASON, RAW)


def grid_rows(grid: DataFrame) -> DataFrame:
    """grid(periodo, row_no, cells): terminal, produced, exported, marked; row 0 is the header. Numbers are all their digits."""
    short = {"fila corta": F.size("cells") < 2}
    cell = lambda k: F.try_element_at("cells", F.lit(k))
    return _production(grid.filter(F.col("row_no") > 0), cell(1), parse.digits_only(cell(2)), parse.digits_only(cell(3)), short, F.to_json(F.struct("periodo", "cells")))


def production_from_grid(grid: DataFrame) -> DataFrame:
    """The good records of grid_rows()."""
    return good(grid_rows(grid))


def sheet_rows(sheet: DataFrame) -> DataFrame:
    """Rows of a sheet with Terminal or Marca, Producción and Exportación, and the report's periodo, marked; a missing measure is 0."""
    there = set(sheet.columns)
    name = [F.nullif(F.col(c), F.lit("")) for c in ("Terminal", "Marca") if c in there] or [F.lit(None).cast("string")]
    made, exported = (F.coalesce(F.col(c).try_cast("int"), F.lit(0)) if c in there else F.lit(0) for c in ("Producción", "Exportación"))
    return _production(sheet, F.coalesce(*name), made, exported, {}, F.to_json(F.struct(*sheet.columns)))


def production_from_sheet(sheet: DataFrame) -> DataFrame:
    """The good records of sheet_rows()."""
    return good(sheet_rows(sheet))


def sheets_csv(spark: SparkSession, path: str) -> DataFrame:
    """Sheets as CSV files in folders by report, periodo=2024-01 and so on; no rows where there are none."""
    try:
        return spark.read.csv(path, header=True, schema="Terminal string, Marca string, `Producción` string, `Exportación` string, periodo string", enforceSchema=False)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "Terminal string, Marca string, `Producción` string, `Exportación` string, periodo string")


def principal_variables(pages: DataFrame) -> DataFrame:
    """pages(json) of {results: [{descripcion, valor, fecha}]}: each variable's last value."""
    points = pages.select(F.explode(F.from_json("json", schemas.VARIABLES_PAGE)["results"]).alias("r"))
    found = points.select(F.col("r.descripcion").alias("descripcion"), F.try_to_date("r.fecha", "yyyy-MM-dd").alias("fecha"), F.col("r.valor").try_cast("decimal(18,4)").alias("valor"))
    found = found.filter("descripcion is not null and fecha is not null and valor is not null")
    return found.groupBy("descripcion").agg(F.max("fecha").alias("fecha"), F.max_by("valor", "fecha").alias("valor"))


def macro_rows(pages: DataFrame, series: DataFrame) -> DataFrame:
    """pages(serie_id, json) of {results: [{fecha, valor}]} and series(serie_id, indicador) -> marked macro records."""
    read = pages.select("serie_id", "json", F.from_json("json", schemas.SERIES_PAGE)["results"].alias("_results"))
    broken = F.col("_results").isNull()
    slim = read.select("serie_id", F.when(broken, F.coalesce("json", F.lit(""))).alias("json"), broken.alias("_broken"), "_results")  # no point carries its page
    points = slim.select("serie_id", "json", "_broken", F.explode_outer("_results").alias("r")).filter("_broken or r is not null")
    known = points.join(F.broadcast(series), "serie_id", "left")  # a row a series
    day, value = F.try_to_date("r.fecha", "yyyy-MM-dd"), F.col("r.valor").try_cast("decimal(18,4)")
    read = known.select(day.alias("fecha"), "indicador", value.alias("valor"), F.lit("BCRA").alias("fuente"), F.col("r.descripcion").alias("descripcion"), "serie_id", "json", "r", "_broken")
    reasons = {"json": F.col("_broken"), "serie": F.col("indicador").isNull(), "fecha": F.col("fecha").isNull(), "valor": F.col("valor").isNull()}
    found = marked(read, reasons, F.when(F.col("_broken"), F.col("json")).otherwise(F.to_json(F.struct("serie_id", "r.*"))))
    return found.drop("serie_id", "json", "r", "_broken")


def macro_from_json(pages: DataFrame, series: DataFrame) -> DataFrame:
    """The good records of macro_rows()."""
    return good(macro_rows(pages, series))


def series_map(spark: SparkSession, known: dict[str, int] | None = None) -> DataFrame:
    return spark.createDataFrame([(number, name) for name, number in (known or schemas.SERIES).items()], "serie_id int, indicador string")


def quotes_from_json(pages: DataFrame, day: str | None = None) -> DataFrame:
    """pages(json) of {results: [{fecha, moneda, cotizacion}]}: those of a day, or each currency's last."""
    points = pages.select(F.explode(F.from_json("json", schemas.QUOTES_PAGE)["results"]).alias("r"))
    found = points.select(F.try_to_date("r.fecha", "yyyy-MM-dd").alias("fecha"), F.col("r.moneda").alias("moneda"), F.col("r.cotizacion").try_cast("decimal(18,4)").alias("cotizacion"))
    found = found.filter("fecha is not null and cotizacion is not null")
    if day:
        return found.filter(F.col("fecha") == F.lit(day).cast("date"))
    return found.groupBy("moneda").agg(F.max("fecha").alias("fecha"), F.max_by("cotizacion", "fecha").alias("cotizacion")).select("fecha", "moneda", "cotizacion")


def loans_csv(spark: SparkSession, path: str) -> DataFrame:
    """The raw rows of a Latin-1, semicolon-separated file with columns Fecha and Monto."""
    return spark.read.csv(path, sep=";", encoding="ISO-8859-1", header=True, schema="Fecha string, Monto string")


def loan_rows(raw: DataFrame) -> DataFrame:
    """raw(Fecha, Monto), with decimal comma and thousands dots, -> marked macro records of the loans."""
    day = F.coalesce(F.try_to_date("Fecha", "yyyy-MM-dd"), F.try_to_date("Fecha", "dd/MM/yyyy"))
    read = raw.select(day.alias("fecha"), F.lit("creditos_prendarios").alias("indicador"), parse.locale_decimal(F.col("Monto")).alias("valor"), F.lit("millones ARS").alias("unidad"), F.lit("BCRA").alias("fuente"), F.to_json(F.struct("Fecha", "Monto")).alias("_raw"))
    return marked(read, {"fecha": F.col("fecha").isNull(), "valor": F.col("valor").isNull()}, F.col("_raw")).drop("_raw")


def pledge_loans(raw: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """The good records of loan_rows(), within a window."""
    found = good(loan_rows(raw))
    for bound, keep in ((first, lambda d: F.col("fecha") >= d), (last, lambda d: F.col("fecha") <= d)):
        found = found.filter(keep(F.lit(bound).cast("date"))) if bound else found
    return found


def listing_items(pages: DataFrame) -> DataFrame:
    """pages(json, ...) of {paging, results} -> the other columns, offset, pos and item; of a page that can't be read, one row with its json."""
    others = [c for c in pages.columns if c != "json"]
    page = pages.select(*others, F.from_json("json", schemas.LISTING_PAGE).alias("p"), "json")
    text = F.when(F.col("p.results").isNull(), F.coalesce("json", F.lit("")))
    slim = page.select(*others, F.col("p.paging.offset").alias("offset"), F.col("p.results").alias("_results"), text.alias("json"))  # no item carries its page
    items = slim.select(*others, "offset", F.posexplode_outer("_results").alias("pos", "item"), "json")
    return items.filter("item is not null or json is not null")


def listing_rows(items: DataFrame, snapshot: str | Column, strict_mileage: bool = False) -> DataFrame:
    """items(item) -> marked listing records of a day, given or a column; items without id or price are rejected.

    Mileage is all its digits; strictly, it is a number without dots or nothing."""
    a = F.col("item.attributes")
    mileage = parse.attribute(a, "KILOMETERS")
    digits = F.nullif(F.regexp_replace(mileage, "[^0-9]", ""), F.lit("")).try_cast("int")
    day = F.lit(snapshot) if isinstance(snapshot, str) else snapshot
    read = items.select(
        F.col("item.id").alias("meli_id"), day.cast("date").alias("fecha_snapshot"), parse.attribute(a, "BRAND").alias("marca"), parse.attribute(a, "MODEL").alias("modelo"),
        parse.guarded_int(parse.attribute(a, "VEHICLE_YEAR")).alias("anio"), (parse.guarded_int(mileage) if strict_mileage else digits).alias("kilometros"), parse.attribute(a, "FUEL_TYPE").alias("combustible"),
        F.col("item.price").alias("precio"), F.coalesce("item.currency_id", F.lit("ARS")).alias("moneda"), F.col("item.location.state.name").alias("provincia"), F.col("item.location.city.name").alias("ciudad"),
        F.col("item.status").alias("estado"), F.col("item.condition").alias("condicion"), F.col("item.title").alias("titulo"), F.col("item.permalink").alias("url"), (F.col("item.condition") == "new").alias("es_nuevo"), (F.coalesce("json", F.to_json("item")) if "json" in items.columns else F.to_json("item")).alias("_raw"), F.col("item").isNull().alias("_broken"),
    )
    return marked(read, {"json": F.col("_broken"), "id": F.col("meli_id").isNull(), "precio": F.col("precio").isNull()}, F.col("_raw")).drop("_raw", "_broken")


def flatten_listings(items: DataFrame, snapshot: str | Column, strict_mileage: bool = False) -> DataFrame:
    """The good records of listing_rows()."""
    return good(listing_rows(items, snapshot, strict_mileage))
