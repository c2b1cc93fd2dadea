"""The registered market queries once more, as DuckDB SQL over the given tables."""

from __future__ import annotations

import textwrap

from marketlens.schemas import MONTHS, SHORT_MONTHS

_LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"
_VIEWS = {
    "registrations": f"""SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS fecha, CAST(year(o_orderdate) AS INT) AS anio, CAST(month(o_orderdate) AS INT) AS mes,
        CASE WHEN l_returnflag = 'N' THEN '0km' ELSE 'usado' END AS tipo_vehiculo, CASE WHEN p_partkey % 50 <> 0 THEN p_brand END AS marca, p_name AS modelo, p_type AS segmento,
        CAST(l_quantity AS INT) AS cantidad, CASE WHEN l_linestatus = 'F' THEN 'ACARA' ELSE 'FACCARA' END AS fuente FROM {_LINES}""",
    "production": """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS fecha, p_brand AS terminal, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS unidades_producidas,
        CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS INT) ELSE 0 END) AS BIGINT) AS unidades_exportadas FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "macro": """SELECT CAST(l_shipdate AS DATE) AS fecha, CASE l_returnflag WHEN 'N' THEN 'tasa_badlar' WHEN 'R' THEN 'tasa_pf_30_dias' ELSE 'tasa_pf_90_dias' END AS indicador,
        CAST(round(avg(l_discount) * 1000, 4) AS DECIMAL(18, 4)) AS valor FROM lineitem GROUP BY 1, 2""",
    "listings": f"""SELECT concat('MLA', CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS meli_id, CAST(l_shipdate AS DATE) AS fecha_snapshot,
        CASE WHEN p_partkey % 50 <> 0 THEN p_brand END AS marca, p_name AS modelo, CAST(year(o_orderdate) AS INT) AS anio, CAST(l_extendedprice AS DECIMAL(18, 2)) AS precio,
        CASE WHEN l_linestatus = 'F' THEN 'USD' ELSE 'ARS' END AS moneda, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'paused' ELSE 'closed' END AS estado,
        CASE WHEN l_returnflag = 'N' THEN 'new' ELSE 'used' END AS condicion, n_name AS provincia FROM {_LINES} JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "interest": """SELECT CAST(ts AS DATE) AS fecha, concat('Brand#', CAST(user_id % 25 + 1 AS VARCHAR)) AS marca, count(*) AS busquedas FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2""",
    "wages": "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS fecha, round(avg(c_acctbal), 2) AS salario FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "interest_monthly": "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS fecha, count(DISTINCT o_custkey) AS busquedas FROM orders GROUP BY 1",
    "dated": "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS dia, o_totalprice FROM orders",
}


def _with(views: str, body: str) -> str:
    return "WITH " + ",\n".join(f"{v} AS ({_VIEWS[v]})" for v in views.split()) + "\n" + textwrap.dedent(body).strip()


def _names(months: list[str]) -> str:
    return "[" + ", ".join(f"'{m}'" for m in months) + "]"


_REPORT = f"""CASE o_orderkey % 3 WHEN 0 THEN 'produccion_' || strftime(dia, '%Y_%m') || '.pdf' WHEN 1 THEN 'reporte-' || strftime(dia, '%m-%Y') || '.xlsx'
    ELSE 'Estadísticas ' || {_names(MONTHS)}[month(dia)] || ' ' || year(dia) END"""
_MONTHLY = "SELECT date_trunc('month', fecha) AS mes, marca, CAST(sum(cantidad) AS BIGINT) AS total FROM registrations WHERE marca IS NOT NULL GROUP BY 1, 2"
_THOUSANDS = "format('{:,}', CAST(floor(o_totalprice) AS BIGINT))"


def _merge(table: str, keys: str, day: str, order: str, raised: str, columns: str, compare: str, taken: list[str], view: str | None = None) -> str:
    """The CTEs stored, raw, batch and merged."""
    key = keys.split(", ")
    same = " AND ".join(f"t.{k} IS NOT DISTINCT FROM b.{k}" for k in key)
    differs = " OR ".join(f"t.{c} IS DISTINCT FROM b.{c}" for c in compare.split(", "))
    last = f"ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY {', '.join(f'{c} DESC NULLS LAST' for c in order.split(', '))})"
    cell = lambda c: f"CASE WHEN action = 'insert'{' OR action = ' + repr('update') if c in taken else ''} THEN b_{c} ELSE t_{c} END AS {c}"
    every = columns.split(", ")
    return f"""
    source AS ({view or f'SELECT * FROM {table}'}),
    stored AS (SELECT * FROM source WHERE {day} < DATE '2000-01-01' QUALIFY {last} = 1),
    raw AS (SELECT * REPLACE ({raised}) FROM source WHERE {day} >= DATE '1999-07-01'),
    batch AS (SELECT * FROM raw QUALIFY {last} = 1),
    both_sides AS (SELECT {', '.join(f't.{c} AS t_{c}, b.{c} AS b_{c}' for c in every)},
        CASE WHEN t.here IS NULL THEN 'insert' WHEN b.here IS NULL THEN 'kept' WHEN {differs} THEN 'update' ELSE 'unchanged' END AS action
        FROM (SELECT *, 1 AS here FROM stored) t FULL OUTER JOIN (SELECT *, 1 AS here FROM batch) b ON {same}),
    merged AS (SELECT {', '.join(cell(c) for c in every)}, action FROM both_sides)"""


_REGISTRATIONS_MERGE = _merge(
    "registrations", "fecha, marca, tipo_vehiculo, fuente", "fecha", "modelo, segmento, cantidad", "CASE WHEN cantidad % 7 = 0 THEN cantidad + 1 ELSE cantidad END AS cantidad",
    "fecha, marca, tipo_vehiculo, fuente, cantidad", "cantidad", ["cantidad"],
)
_ROTATION = """
    made AS (SELECT fecha AS mes, terminal AS marca, CAST(sum(unidades_producidas - unidades_exportadas) AS BIGINT) AS internas FROM production GROUP BY 1, 2),
    sold AS (SELECT fecha AS mes, marca, CAST(sum(cantidad) AS BIGINT) AS vendidas FROM registrations WHERE tipo_vehiculo = '0km' AND marca IS NOT NULL GROUP BY 1, 2),
    pairs AS (SELECT mes, marca, coalesce(internas, 0) AS internas, coalesce(vendidas, 0) AS vendidas FROM made FULL OUTER JOIN sold USING (mes, marca)),
    stocked AS (SELECT *, CAST(sum(internas - vendidas) OVER (PARTITION BY marca ORDER BY mes ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stock FROM pairs),
    rotation AS (SELECT mes, marca, internas, vendidas, stock, round(stock * day(last_day(mes)) / CAST(nullif(vendidas, 0) AS DOUBLE), 4) AS dias_stock FROM stocked)"""
_RATIO = """
    made AS (SELECT fecha AS mes, CAST(sum(unidades_producidas - unidades_exportadas) AS BIGINT) AS internas FROM production GROUP BY 1),
    sold AS (SELECT fecha AS mes, CAST(sum(cantidad) AS BIGINT) AS vendidas FROM registrations WHERE tipo_vehiculo = '0km' GROUP BY 1),
    ratio AS (SELECT mes, internas, vendidas, round(CAST(internas AS DOUBLE) / nullif(vendidas, 0), 4) AS razon FROM made FULL OUTER JOIN sold USING (mes))"""

_TENSION = """
            m AS (SELECT fecha AS mes, CAST(sum(cantidad) AS DOUBLE) AS total FROM registrations WHERE tipo_vehiculo = '0km' GROUP BY 1),
            u AS (SELECT a.mes, round(100.0 * (a.total - b.total) / nullif(b.total, 0), 4) AS registros FROM m a LEFT JOIN m b ON b.mes = a.mes - to_months(12)),
            r AS (SELECT CAST(date_trunc('month', fecha) AS DATE) AS mes, CAST(sum(valor) AS DOUBLE) / count(*) AS tasa FROM macro WHERE indicador = 'tasa_badlar' GROUP BY 1),
            c AS (SELECT a.mes, a.tasa - b.tasa AS tasa FROM r a LEFT JOIN r b ON b.mes = a.mes - to_months(1)),
            s AS (SELECT u.mes, registros, c.tasa, CAST(busquedas AS DOUBLE) AS interes FROM u LEFT JOIN c USING (mes) LEFT JOIN interest_monthly i ON i.fecha = u.mes),
            z AS (SELECT mes, (registros - avg(registros) OVER ()) / nullif(stddev_samp(registros) OVER (), 0) AS registros, (tasa - avg(tasa) OVER ()) / nullif(stddev_samp(tasa) OVER (), 0) AS tasa,
                (interes - avg(interes) OVER ()) / nullif(stddev_samp(interes) OVER (), 0) AS interes FROM s)
            SELECT mes, round(registros, 4) AS registros, round(tasa, 4) AS tasa, round(interes, 4) AS interes,
                round((coalesce(registros * 0.5, 0) + coalesce(tasa * -0.3, 0) + coalesce(interes * 0.2, 0)) / nullif(CASE WHEN registros IS NOT NULL THEN CAST(0.5 AS DOUBLE) ELSE 0 END
                    + CASE WHEN tasa IS NOT NULL THEN CAST(0.3 AS DOUBLE) ELSE 0 END + CASE WHEN interes IS NOT NULL THEN CAST(0.2 AS DOUBLE) ELSE 0 END, 0), 4) AS valor,
                round((CAST(registros IS NOT NULL AS INT) + CAST(tasa IS NOT NULL AS INT) + CAST(interes IS NOT NULL AS INT)) / 3, 4) AS confianza FROM z"""
_ACCESS = """
            p AS (SELECT CAST(date_trunc('month', fecha_snapshot) AS DATE) AS mes, CAST(sum(precio) AS DOUBLE) / count(*) AS precio FROM listings WHERE condicion = 'new' GROUP BY 1),
            r AS (SELECT CAST(date_trunc('month', fecha) AS DATE) AS mes, CAST(arg_max(valor, fecha) AS DOUBLE) AS tasa FROM macro WHERE indicador = 'tasa_pf_30_dias' GROUP BY 1),
            m AS (SELECT mes, precio, salario, last_value(tasa IGNORE NULLS) OVER (ORDER BY mes ROWS UNBOUNDED PRECEDING) AS tasa FROM p LEFT JOIN wages w ON w.fecha = mes LEFT JOIN r USING (mes)),
            c AS (SELECT *, CASE WHEN tasa = 0 THEN precio / 36 ELSE precio * (tasa / 1200.0) / (1 - pow(1 + tasa / 1200.0, -36)) END AS cuota FROM m)
            SELECT mes, round(precio, 4) AS precio, round(salario, 4) AS salario, round(tasa, 4) AS tasa, round(cuota, 4) AS cuota, round(100 * salario / cuota, 4) AS indice FROM c"""
_JOB = """
    made AS (SELECT fecha AS mes, terminal AS marca, CAST(sum(unidades_producidas - unidades_exportadas) AS BIGINT) AS internas FROM production GROUP BY 1, 2),
    sold AS (SELECT fecha AS mes, marca, CAST(sum(cantidad) AS BIGINT) AS vendidas FROM registrations WHERE tipo_vehiculo = '0km' AND marca IS NOT NULL GROUP BY 1, 2),
    pairs AS (SELECT mes, marca, coalesce(internas, 0) AS internas, coalesce(vendidas, 0) AS vendidas FROM made FULL OUTER JOIN sold USING (mes, marca)),
    stocked AS (SELECT *, sum(internas - vendidas) OVER (PARTITION BY marca ORDER BY mes ROWS UNBOUNDED PRECEDING) AS stock FROM pairs),
    months AS (SELECT mes, sum(internas) FILTER (here) AS internas, sum(vendidas) FILTER (sold) AS vendidas FROM (
        SELECT mes, internas, 0 AS vendidas, true AS here, false AS sold FROM made UNION ALL SELECT mes, 0, vendidas, false, true FROM sold) GROUP BY 1),
    every AS (SELECT mes, 'rotacion_stock' AS indicador, marca, round(CAST(stock AS DOUBLE) * day(last_day(mes)) / nullif(vendidas, 0), 4) AS valor FROM stocked
        UNION ALL SELECT mes, 'produccion_demanda', NULL, round(CAST(internas AS DOUBLE) / nullif(vendidas, 0), 4) FROM months)
    SELECT indicador, marca, count(*) AS meses, arg_max(valor, mes) AS ultimo FROM every WHERE valor IS NOT NULL GROUP BY 1, 2"""



def _taken(pages: str, day: str) -> str:
    """A snapshot's listings: of each search brand the first hundred items, a row an id."""
    return f"""SELECT *, DATE '{day}' AS dia FROM (SELECT * FROM placed WHERE {pages} QUALIFY row_number() OVER (PARTITION BY busca ORDER BY page, pos) <= 100)
        QUALIFY row_number() OVER (PARTITION BY meli_id ORDER BY precio DESC) = 1"""


#: Search pages of sixteen orders, their items in order, each page for the brand of its first item.
_PLACED = """
    paged AS (SELECT *, CAST(split_part(substr(meli_id, 4), '-', 1) AS BIGINT) // 16 AS page FROM listings),
    posed AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY meli_id, modelo, precio, moneda, estado, condicion) AS pos FROM paged),
    placed AS (SELECT *, coalesce(first_value(marca) OVER (PARTITION BY page ORDER BY pos), '-') AS busca FROM posed)"""
_DAILY = f"""{_PLACED},
    early AS ({_taken("page % 2 = 0", "2001-08-15")}), late AS ({_taken("true", "2001-09-01")}),
    held AS (SELECT * FROM early UNION ALL SELECT * FROM late),
    held_sales AS (SELECT * FROM registrations WHERE marca IS NOT NULL),
    held_rates AS (SELECT * FROM macro WHERE fecha BETWEEN DATE '2001-07-15' AND DATE '2001-09-01'),
    held_wages AS (SELECT CAST(fecha + to_months(2) AS DATE) AS fecha, salario FROM wages),
    moved AS (WITH registrations AS (SELECT * FROM held_sales), {_ROTATION} SELECT * FROM rotation),
    ratios AS (WITH registrations AS (SELECT * FROM held_sales), {_RATIO} SELECT * FROM ratio),
    tensions AS (WITH registrations AS (SELECT * FROM held_sales), macro AS (SELECT * FROM held_rates), {_TENSION}),
    accesses AS (WITH listings AS (SELECT dia AS fecha_snapshot, condicion, precio FROM held), wages AS (SELECT * FROM held_wages), macro AS (SELECT * FROM held_rates), {_ACCESS}),
    shown AS (SELECT '2001-08' AS periodo, marca, count(*) AS activas FROM early WHERE estado = 'active' AND marca IS NOT NULL GROUP BY 2
        UNION ALL SELECT '2001-09', marca, count(*) FROM held WHERE estado = 'active' AND marca IS NOT NULL GROUP BY 2),
    every AS (
        SELECT 'rotacion_stock' AS indicador, mes, marca, dias_stock AS valor FROM moved
        UNION ALL SELECT 'produccion_demanda', mes, NULL, razon FROM ratios
        UNION ALL SELECT 'tension_demanda', mes, NULL, valor FROM tensions
        UNION ALL SELECT 'accesibilidad', mes, NULL, indice FROM accesses)"""
_ATTENTION = """
    SELECT 'atencion' AS indicador, periodo, marca, round(CAST(50.0 AS DOUBLE) * activas / max(activas) OVER (PARTITION BY periodo), 4) AS valor FROM shown
    UNION ALL SELECT 'atencion', unnest(['2001-08', '2001-09']), NULL, 50.0"""


def sql() -> dict[str, str]:
    return {
        "top_brands": _with("registrations", """
            SELECT marca, sum(cantidad) AS total FROM registrations WHERE fecha BETWEEN DATE '2001-06-15' AND DATE '2001-07-15' AND tipo_vehiculo = '0km'
            GROUP BY marca ORDER BY total DESC, marca NULLS LAST LIMIT 10"""),
        "top_brands_dashboard": _with("registrations", """
            SELECT marca, sum(cantidad) AS total FROM registrations WHERE fecha BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AND tipo_vehiculo = '0km' AND marca IS NOT NULL
            GROUP BY marca ORDER BY total DESC, marca LIMIT 10"""),
        "registrations_list": _with("registrations", """
            SELECT fecha, marca, modelo, tipo_vehiculo, cantidad, fuente FROM registrations
            WHERE fecha BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND marca ILIKE '%brand#1%' AND tipo_vehiculo = '0km'
            ORDER BY fecha DESC, marca, modelo, tipo_vehiculo, fuente, cantidad LIMIT 100"""),
        "registrations_list_all": _with("registrations", """
            SELECT fecha, marca, modelo, tipo_vehiculo, cantidad, fuente FROM registrations ORDER BY fecha DESC, marca NULLS LAST, modelo, tipo_vehiculo, fuente, cantidad LIMIT 200"""),
        "registrations_exported": _with("registrations", """
            SELECT fecha, marca, tipo_vehiculo, CAST(sum(cantidad) AS BIGINT) AS total FROM registrations WHERE fecha BETWEEN DATE '1999-03-01' AND DATE '1999-04-30' GROUP BY 1, 2, 3"""),
        "production_list": _with("production", """
            SELECT fecha, terminal, unidades_producidas, unidades_exportadas FROM production WHERE fecha >= DATE '1996-01-01' AND terminal ILIKE '%#2%'
            ORDER BY fecha DESC, terminal LIMIT 100"""),
        "macro_list": _with("macro", """
            SELECT fecha, indicador, CAST(valor AS DOUBLE) AS valor, '%' AS unidad FROM macro WHERE fecha <= DATE '2000-06-30' AND indicador = 'tasa_badlar'
            ORDER BY fecha DESC, indicador LIMIT 100"""),
        "listings_list": _with("listings", """
            SELECT meli_id, fecha_snapshot, marca, modelo, anio, CAST(precio AS DOUBLE) AS precio, moneda, condicion, 'https://base.example/' || meli_id AS url FROM listings
            WHERE marca ILIKE '%brand%' AND condicion = 'new' ORDER BY fecha_snapshot DESC, meli_id, precio LIMIT 100"""),
        "indicators_list": _with("registrations production", "") + "," + _RATIO + """
            SELECT mes AS fecha, 'produccion_demanda' AS indicador, CAST(NULL AS VARCHAR) AS marca, CAST(CAST(razon AS DECIMAL(18, 4)) AS DOUBLE) AS valor, vendidas
            FROM ratio WHERE razon IS NOT NULL AND mes BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' ORDER BY mes DESC LIMIT 100""",
        "brand_options": _with("registrations", "SELECT DISTINCT marca FROM registrations WHERE marca IS NOT NULL ORDER BY marca"),
        "series_default": _with("macro", "SELECT DISTINCT indicador FROM macro ORDER BY indicador LIMIT 3"),
        "listing_search": _with("listings", """
            SELECT meli_id, fecha_snapshot, marca, anio, CAST(precio AS DOUBLE) AS precio, provincia FROM listings
            WHERE marca ILIKE '%brand#3%' AND anio BETWEEN 1996 AND 2000 AND condicion = 'used' AND precio <= 40000
            ORDER BY listings.precio, meli_id, fecha_snapshot LIMIT 50 OFFSET 20"""),
        "load_range_registrations": _with("registrations", "SELECT * FROM registrations WHERE fecha BETWEEN DATE '1998-01-01' AND DATE '1998-06-30'"),
        "load_range_production": _with("production", "SELECT * FROM production WHERE fecha BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'"),
        "load_range_macro": _with("macro", """
            SELECT fecha, indicador, CAST(valor AS DOUBLE) AS valor FROM macro
            WHERE fecha BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AND indicador IN ('tasa_badlar', 'tasa_pf_90_dias')"""),
        "load_snapshot": _with("listings", "SELECT * REPLACE (CAST(precio AS DOUBLE) AS precio) FROM listings WHERE fecha_snapshot = DATE '1999-03-15'"),
        "registrations_trend": _with("registrations", "SELECT fecha, sum(cantidad) AS total FROM registrations WHERE tipo_vehiculo = '0km' GROUP BY 1"),
        "registrations_by_type": _with("registrations", "SELECT fecha, tipo_vehiculo, sum(cantidad) AS total FROM registrations GROUP BY 1, 2"),
        "listing_kpis": _with("listings", "SELECT count(*) AS publicaciones, CAST(sum(precio) AS DOUBLE) / count(precio) AS precio_promedio, count(DISTINCT marca) AS marcas FROM listings"),
        "listing_top_brands": _with("listings", "SELECT marca, count(*) AS cantidad FROM listings WHERE marca IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
        "trending_models": _with("listings", "SELECT marca, modelo, count(*) AS cantidad FROM listings WHERE marca IS NOT NULL AND modelo IS NOT NULL GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20"),
        "price_histogram": _with("listings", "") + """, edges AS (SELECT CAST(min(precio) AS DOUBLE) AS lo, CAST(max(precio) AS DOUBLE) AS hi FROM listings),
            binned AS (SELECT CAST(least(floor((CAST(precio AS DOUBLE) - lo) / ((hi - lo) / 50)), 49) AS INT) AS bin, lo, (hi - lo) / 50 AS width FROM listings, edges)
            SELECT bin, count(*) AS cantidad, round(min(lo + bin * width), 4) AS desde FROM binned GROUP BY bin""",
        "table_stats": _with("registrations production macro listings", """
            SELECT 'registrations' AS tabla, count(*) AS filas FROM registrations UNION ALL SELECT 'production', count(*) FROM production
            UNION ALL SELECT 'macro', count(*) FROM macro UNION ALL SELECT 'listings', count(*) FROM listings"""),
        "listings_by_condition": _with("listings", """
            SELECT marca, count(*) FILTER (condicion = 'new') AS nuevos, count(*) FILTER (condicion = 'used') AS usados, count(*) AS total FROM listings GROUP BY 1"""),
        "price_ranking": _with("listings", """
            SELECT marca, moneda, count(*) AS publicaciones, CAST(sum(precio) AS DOUBLE) / count(precio) AS precio_promedio,
            round(quantile_cont(CAST(precio AS DOUBLE), 0.5), 4) AS precio_mediano, CAST(max(precio) AS DOUBLE) AS precio_maximo FROM listings WHERE marca IS NOT NULL GROUP BY 1, 2"""),
        "price_trend": _with("listings", """
            SELECT fecha_snapshot, moneda, count(*) AS publicaciones, CAST(sum(precio) AS DOUBLE) / count(precio) AS precio_promedio FROM listings GROUP BY 1, 2"""),
        "price_ranking_sketches": _with("listings", """
            SELECT marca, moneda, count(*) AS publicaciones, round(CAST(sum(precio) AS DOUBLE) / count(precio), 4) AS precio_promedio, CAST(max(precio) AS DOUBLE) AS precio_maximo, true AS dentro
            FROM listings WHERE marca IS NOT NULL AND fecha_snapshot BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY 1, 2"""),
        "listing_kpis_sketches": _with("listings", """
            SELECT count(*) AS publicaciones, round(CAST(sum(precio) AS DOUBLE) / count(precio), 4) AS precio_promedio, count(DISTINCT marca) AS marcas, true AS dentro FROM listings"""),
        "macro_monthly": _with("macro", """
            SELECT CAST(date_trunc('month', fecha) AS DATE) AS mes, indicador, CAST(sum(valor) AS DOUBLE) / count(valor) AS promedio, CAST(arg_max(valor, fecha) AS DOUBLE) AS ultimo
            FROM macro GROUP BY 1, 2"""),
        "macro_latest": _with("macro", "SELECT indicador, max(fecha) AS fecha, CAST(arg_max(valor, fecha) AS DOUBLE) AS valor FROM macro GROUP BY 1"),
        "weekly_rollup": _with("macro", """
            SELECT CAST(date_trunc('week', fecha) AS DATE) AS semana, indicador, count(*) AS dias, CAST(sum(valor) AS DOUBLE) / count(valor) AS promedio FROM macro GROUP BY 1, 2"""),
        "kpi_vs_previous": _with("registrations", "") + """, k AS (SELECT sum(cantidad) FILTER (fecha BETWEEN DATE '2000-01-01' AND DATE '2000-12-31') AS actual,
                sum(cantidad) FILTER (fecha BETWEEN DATE '1998-12-31' AND DATE '1999-12-31') AS anterior FROM registrations)
            SELECT actual, anterior, round(100.0 * (CAST(actual AS DOUBLE) - anterior) / anterior, 4) AS variacion FROM k""",
        "yoy_growth": _with("registrations", "") + f""", m AS ({_MONTHLY})
            SELECT CAST(a.mes AS DATE) AS mes, a.marca, a.total, b.total AS anterior, round(100.0 * (CAST(a.total AS DOUBLE) - b.total) / nullif(b.total, 0), 4) AS interanual
            FROM m a LEFT JOIN m b ON a.marca = b.marca AND b.mes = a.mes - to_months(12)""",
        "mom_growth": _with("registrations", "") + """, m AS (SELECT fecha AS mes, CAST(sum(cantidad) AS BIGINT) AS total FROM registrations GROUP BY 1)
            SELECT a.mes, a.total, b.total AS anterior, round(100.0 * (CAST(a.total AS DOUBLE) - b.total) / nullif(b.total, 0), 4) AS intermensual
            FROM m a LEFT JOIN m b ON b.mes = a.mes - to_months(1)""",
        "ytd_growth": _with("registrations", "") + """, m AS (SELECT fecha AS mes, tipo_vehiculo, sum(cantidad) AS total FROM registrations GROUP BY 1, 2),
            y AS (SELECT mes, tipo_vehiculo, CAST(sum(total) OVER (PARTITION BY year(mes), tipo_vehiculo ORDER BY mes ROWS UNBOUNDED PRECEDING) AS BIGINT) AS acumulado FROM m)
            SELECT a.mes, a.tipo_vehiculo, a.acumulado, b.acumulado AS anterior, round(100.0 * (CAST(a.acumulado AS DOUBLE) - b.acumulado) / nullif(b.acumulado, 0), 4) AS variacion
            FROM y a LEFT JOIN y b ON a.tipo_vehiculo = b.tipo_vehiculo AND b.mes = a.mes - to_months(12)""",
        "cap_per_brand": _with("listings", """
            SELECT marca, row_number() OVER (PARTITION BY marca ORDER BY fecha_snapshot, meli_id, precio) AS posicion, meli_id, fecha_snapshot
            FROM listings WHERE marca IS NOT NULL QUALIFY posicion <= 50"""),
        "market_share": _with("registrations", "") + f""", m AS ({_MONTHLY})
            SELECT CAST(mes AS DATE) AS mes, marca, total, round(100.0 * CAST(total AS DOUBLE) / sum(total) OVER (PARTITION BY mes), 4) AS participacion,
            dense_rank() OVER (PARTITION BY mes ORDER BY total DESC) AS puesto FROM m""",
        "rolling_trend": _with("registrations", "") + """, m AS (SELECT fecha AS mes, marca, CAST(sum(cantidad) AS BIGINT) AS total FROM registrations GROUP BY 1, 2)
            SELECT mes, marca, total, round(avg(total) OVER (PARTITION BY marca ORDER BY mes ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS media_movil FROM m""",
        "price_changes": _with("listings", "") + """, n AS (SELECT concat_ws('|', marca, modelo, moneda) AS meli_id, fecha_snapshot, precio FROM listings),
            d AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY meli_id, fecha_snapshot ORDER BY precio DESC) = 1),
            w AS (SELECT *, lag(precio) OVER (PARTITION BY meli_id ORDER BY fecha_snapshot) AS antes FROM d)
            SELECT meli_id, fecha_snapshot, CAST(precio AS DOUBLE) AS precio, CAST(antes AS DOUBLE) AS precio_anterior,
            round(100.0 * (CAST(precio AS DOUBLE) - CAST(antes AS DOUBLE)) / CAST(antes AS DOUBLE), 4) AS variacion FROM w WHERE precio <> antes""",
        "parse_counts": _with("dated", "") + f""", l AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '-' WHEN 1 THEN replace({_THOUSANDS}, ',', '.') ELSE {_THOUSANDS} END AS t FROM dated)
            SELECT o_orderkey, TRY_CAST(regexp_replace(t, '[.,]', '', 'g') AS INT) AS cantidad FROM l""",
        "digits_only": _with("dated", "") + f""", l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'n/a' ELSE {_THOUSANDS} || ' km' END AS t FROM dated)
            SELECT o_orderkey, coalesce(TRY_CAST(nullif(regexp_replace(t, '[^0-9]', '', 'g'), '') AS INT), 0) AS unidades FROM l""",
        "parse_period_label": _with("dated", "") + f""", l AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN {_names([m.capitalize() for m in SHORT_MONTHS])}[month(dia)] || '-' || year(dia)
                WHEN 1 THEN strftime(dia, '%m/%Y') WHEN 2 THEN strftime(dia, '%Y-%m') WHEN 3 THEN {_names([m.capitalize() for m in MONTHS])}[month(dia)] || '-' || year(dia)
                WHEN 4 THEN strftime(dia, '%m-%Y') ELSE '13/' || year(dia) END AS t FROM dated),
            p AS (SELECT *, list_position({_names(SHORT_MONTHS)}, lower(left(t, 3))) AS m FROM l)
            SELECT o_orderkey, CASE WHEN m > 0 AND regexp_matches(t, '^[^-]*-[0-9]{{4}}$') THEN TRY_CAST(right(t, 4) || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-01' AS DATE)
                WHEN regexp_matches(t, '^[0-9]{{1,2}}/[0-9]{{4}}$') THEN TRY_CAST(right(t, 4) || '-' || lpad(split_part(t, '/', 1), 2, '0') || '-01' AS DATE)
                WHEN regexp_matches(t, '^[0-9]{{4}}-[0-9]{{1,2}}$') THEN TRY_CAST(t || '-01' AS DATE) END AS fecha FROM p""",
        "extract_period": _with("dated", "") + f""", l AS (SELECT o_orderkey, {_REPORT} AS t FROM dated)
            SELECT o_orderkey, coalesce(translate(nullif(regexp_extract(t, '[0-9]{{4}}[-_][0-9]{{2}}'), ''), '_', '-'),
                right(nullif(regexp_extract(t, '[0-9]{{2}}[-_][0-9]{{4}}'), ''), 4) || '-' || left(nullif(regexp_extract(t, '[0-9]{{2}}[-_][0-9]{{4}}'), ''), 2),
                nullif(regexp_extract(t, '[0-9]{{4}}'), '') || '-' || lpad(CAST(list_position(list_transform({_names(MONTHS)}, lambda m: contains(lower(t), m)), true) AS VARCHAR), 2, '0')) AS periodo FROM l""",
        "parse_decimal_locale": _with("dated", "") + f""", l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'abc' ELSE replace({_THOUSANDS}, ',', '.') || ',' ||
                lpad(CAST(CAST(floor(round(o_totalprice * 100)) AS BIGINT) % 100 AS VARCHAR), 2, '0') END AS t FROM dated)
            SELECT o_orderkey, CAST(TRY_CAST(replace(replace(t, '.', ''), ',', '.') AS DECIMAL(18, 4)) AS DOUBLE) AS monto FROM l""",
        "attribute_lookup": "SELECT p_partkey, p_brand AS marca, p_name AS modelo, CAST(NULL AS VARCHAR) AS combustible FROM part",
        "loan_instalment": """SELECT o_orderkey, round(CASE WHEN o_orderkey % 90 = 0 THEN o_totalprice / 36
            ELSE o_totalprice * ((o_orderkey % 90) / 1200.0) / (1 - pow(1 + (o_orderkey % 90) / 1200.0, -36)) END, 4) AS cuota FROM orders""",
        "page_links": r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*"[^"]*"[^>]*>.*?</a>')) AS a, unnest(range(len(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*"[^"]*"[^>]*>.*?</a>')))) AS pos FROM pages),
            l AS (SELECT page_id, CAST(pos AS INT) AS pos, regexp_extract(a, '(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"', 1) AS href,
                trim(regexp_replace(regexp_extract(a, '(?is)<a\s[^>]*?href\s*=\s*"[^"]*"[^>]*>(.*?)</a>', 1), '<[^>]*>', '', 'g')) AS texto FROM a)
            SELECT *, CASE WHEN starts_with(href, 'http') THEN href WHEN starts_with(href, '/') THEN 'https://base.example' || href ELSE 'https://base.example/estadisticas/' || href END AS direccion FROM l""",
        "report_index": _with("dated", "") + f""", n AS (SELECT o_orderkey, {_REPORT} AS t FROM dated),
            l AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN '/archivos/' || t ELSE 'http://otro.example/' || t END AS href, 'Informe ' || o_orderkey AS texto FROM n),
            p AS (SELECT *, texto || ' ' || href AS x FROM l WHERE regexp_matches(lower(href), '\\.pdf|\\.xlsx|\\.xls'))
            SELECT CASE WHEN starts_with(href, 'http') THEN href ELSE 'https://base.example' || href END AS url,
                coalesce(translate(nullif(regexp_extract(x, '[0-9]{{4}}[-_][0-9]{{2}}'), ''), '_', '-'),
                    right(nullif(regexp_extract(x, '[0-9]{{2}}[-_][0-9]{{4}}'), ''), 4) || '-' || left(nullif(regexp_extract(x, '[0-9]{{2}}[-_][0-9]{{4}}'), ''), 2)) AS periodo,
                CASE WHEN contains(lower(href), '.pdf') THEN 'pdf' ELSE 'excel' END AS formato, texto FROM p ORDER BY 2 DESC, 1, 4""".replace("\\\\.", "\\."),
        "registrations_unpivot": _with("registrations", """
            SELECT fecha, anio, mes, '0km' AS tipo_vehiculo, marca, CAST(sum(cantidad) AS INT) AS cantidad, 'FACCARA' AS fuente, strftime(fecha, '%Y-%m') AS periodo_reportado
            FROM registrations WHERE tipo_vehiculo = '0km' AND marca IS NOT NULL GROUP BY 1, 2, 3, 5"""),
        "registrations_union": _with("registrations", "SELECT fecha, tipo_vehiculo, marca, sum(cantidad) AS total FROM registrations GROUP BY 1, 2, 3"),
        "source_fallback": _with("registrations", "SELECT fecha, fuente, sum(cantidad) AS total FROM registrations WHERE fuente = 'ACARA' GROUP BY 1, 2"),
        "production_from_grid": _with("production", """
            SELECT fecha, CAST(year(fecha) AS INT) AS anio, CAST(month(fecha) AS INT) AS mes, terminal, CAST(unidades_producidas AS INT) AS unidades_producidas,
            CAST(unidades_exportadas AS INT) AS unidades_exportadas, 'ADEFA' AS fuente, strftime(fecha, '%Y-%m') AS periodo_reportado FROM production"""),
        "production_from_sheet": _with("production", """
            SELECT fecha, CAST(year(fecha) AS INT) AS anio, CAST(month(fecha) AS INT) AS mes, terminal, CAST(unidades_producidas AS INT) AS unidades_producidas,
            CASE WHEN month(fecha) % 2 = 1 THEN CAST(unidades_exportadas AS INT) ELSE 0 END AS unidades_exportadas, 'ADEFA' AS fuente, strftime(fecha, '%Y-%m') AS periodo_reportado FROM production"""),
        "macro_series_ingest": _with("macro", "SELECT fecha, indicador, CAST(valor AS DOUBLE) AS valor, 'BCRA' AS fuente FROM macro"),
        "quotes_at": _with("macro", "SELECT max(fecha) AS fecha, indicador AS moneda, CAST(arg_max(valor, fecha) AS DOUBLE) AS cotizacion FROM macro GROUP BY 2"),
        "pledge_loans_csv": _with("macro", """
            SELECT fecha, 'creditos_prendarios' AS indicador, CAST(round(valor, 2) AS DOUBLE) AS valor, 'millones ARS' AS unidad, 'BCRA' AS fuente FROM macro
            WHERE macro.indicador = 'tasa_badlar' AND fecha BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'"""),
        "listing_flatten": _with("listings", """
            SELECT meli_id, DATE '2001-09-01' AS fecha_snapshot, marca, modelo, anio, anio * 1000 AS kilometros, CAST(NULL AS VARCHAR) AS combustible, CAST(precio AS DOUBLE) AS precio, moneda,
            provincia, CAST(NULL AS VARCHAR) AS ciudad, estado, condicion, modelo AS titulo, condicion = 'new' AS es_nuevo FROM listings"""),
        "item_detail_lookup": _with("listings", """
            SELECT meli_id, marca, modelo, CAST(precio AS DOUBLE) AS precio
            FROM (SELECT DISTINCT concat('MLA', CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS meli_id FROM lineitem WHERE l_orderkey % 100 = 0) LEFT JOIN listings USING (meli_id)"""),
        "item_by_id": _with("listings", """
            , ids AS (SELECT DISTINCT concat('MLA', CAST(l_orderkey AS VARCHAR), '-', CAST(unnest([l_linenumber, 99]) AS VARCHAR)) AS meli_id FROM lineitem WHERE l_orderkey % 1000 = 7)
            SELECT meli_id, marca, modelo, CAST(precio AS DOUBLE) AS precio FROM ids LEFT JOIN listings USING (meli_id)"""),
        "listing_pages": _with("listings", """
            , n AS (SELECT *, row_number() OVER (ORDER BY precio, meli_id, fecha_snapshot) - 1 AS k FROM listings WHERE condicion = 'used' AND lower(modelo) LIKE '%d gi%')
            SELECT meli_id, fecha_snapshot, modelo, condicion, CAST(precio AS DOUBLE) AS precio, 1 + k // 40 AS pagina FROM n WHERE k < 120"""),
        "listing_page_1000": _with("listings", """
            , n AS (SELECT *, row_number() OVER (ORDER BY precio, meli_id, fecha_snapshot) - 1 AS k, 9990 % count(*) OVER () AS a FROM listings)
            SELECT meli_id, fecha_snapshot, CAST(precio AS DOUBLE) AS precio FROM n WHERE k BETWEEN a AND a + 9"""),
        "upsert_registrations": _with("registrations", "") + "," + _REGISTRATIONS_MERGE + " SELECT * FROM merged",
        "upsert_production": _with("production", "") + "," + _merge(
            "production", "fecha, terminal, fuente", "fecha", "unidades_producidas, unidades_exportadas",
            "CASE WHEN unidades_exportadas % 7 = 0 THEN unidades_exportadas + 1 ELSE unidades_exportadas END AS unidades_exportadas",
            "fecha, terminal, fuente, unidades_producidas, unidades_exportadas", "unidades_producidas, unidades_exportadas", ["unidades_producidas", "unidades_exportadas"],
            "SELECT *, 'ADEFA' AS fuente FROM production") + " SELECT * FROM merged",
        "upsert_macro": _with("macro", "") + "," + _merge(
            "macro", "fecha, indicador", "fecha", "valor", "CAST(CASE WHEN day(fecha) % 7 = 0 THEN valor + 1 ELSE valor END AS DECIMAL(18, 4)) AS valor", "fecha, indicador, valor", "valor", ["valor"],
            ) + " SELECT * REPLACE (CAST(valor AS DOUBLE) AS valor) FROM merged",
        "upsert_listings": _with("listings", "") + "," + _merge(
            "listings", "meli_id, fecha_snapshot", "fecha_snapshot", "precio, modelo, provincia, moneda, estado",
            "CAST(CASE WHEN floor(precio) % 7 = 0 THEN precio + 1 ELSE precio END AS DECIMAL(18, 2)) AS precio, 'closed' AS estado", "meli_id, fecha_snapshot, precio, estado", "precio", ["precio", "estado"],
            ) + " SELECT * REPLACE (CAST(precio AS DOUBLE) AS precio) FROM merged",
        "dedupe_last_record": _with("registrations", """
            SELECT fecha, marca, tipo_vehiculo, fuente, modelo, cantidad FROM registrations
            QUALIFY row_number() OVER (PARTITION BY fecha, marca, tipo_vehiculo, fuente ORDER BY modelo DESC, segmento DESC, cantidad DESC) = 1"""),
        "ingest_summary": _with("registrations", "") + "," + _REGISTRATIONS_MERGE + """
            SELECT (SELECT count(*) FROM raw) AS leidos, (SELECT min(fecha) FROM raw) AS desde, (SELECT max(fecha) FROM raw) AS hasta,
            (SELECT count(*) FROM batch WHERE marca IS NOT NULL) AS unicos, (SELECT count(*) FROM raw WHERE marca IS NULL) AS rechazados,
            count(*) FILTER (action = 'insert' AND marca IS NOT NULL) AS insertados, count(*) FILTER (action = 'update' AND marca IS NOT NULL) AS actualizados,
            count(*) FILTER (action = 'unchanged' AND marca IS NOT NULL) AS sin_cambios, count(*) FILTER (action = 'kept' OR marca IS NULL AND action <> 'insert') AS conservados,
            (SELECT count(*) FROM raw WHERE marca IS NOT NULL) - (SELECT count(*) FROM batch WHERE marca IS NOT NULL) AS duplicados, 'success' AS estado FROM merged""",
        "ingest_rejects": _with("registrations production macro listings", """
            , lines AS (SELECT right(meli_id, 1) AS line FROM listings)
            SELECT 'registrations' AS tabla, 'cantidad' AS motivo, count(DISTINCT (anio, marca)) AS rechazados FROM registrations WHERE tipo_vehiculo = '0km' AND mes = 12 AND marca IS NOT NULL
            UNION ALL SELECT 'production', CASE month(fecha) WHEN 11 THEN 'fila corta' ELSE 'periodo' END, count(*) FROM production WHERE month(fecha) >= 11 GROUP BY 2
            UNION ALL SELECT 'macro', 'serie', count(*) FROM macro WHERE indicador = 'tasa_pf_90_dias'
            UNION ALL SELECT 'macro', 'json', count(DISTINCT year(fecha)) FROM macro WHERE indicador = 'tasa_badlar' AND month(fecha) = 2
            UNION ALL SELECT 'macro', 'fecha', count(*) FROM macro WHERE day(fecha) = 14 AND (indicador = 'tasa_pf_30_dias' OR indicador = 'tasa_badlar' AND month(fecha) <> 2)
            UNION ALL SELECT 'macro', 'valor', count(*) FILTER (day(fecha) = 13 AND (indicador = 'tasa_pf_30_dias' OR indicador = 'tasa_badlar' AND month(fecha) <> 2))
                + count(*) FILTER (indicador = 'tasa_badlar' AND day(fecha) % 9 = 0) FROM macro
            UNION ALL SELECT 'listings', CASE line WHEN '6' THEN 'precio' ELSE 'id' END, count(*) FROM lines WHERE line IN ('6', '7') GROUP BY 2"""),
        "listing_stream": _with("listings", """
            SELECT meli_id, DATE '2001-09-01' AS fecha_snapshot, marca, modelo, anio, CAST(precio AS DOUBLE) AS precio, estado, condicion = 'new' AS es_nuevo FROM listings
            QUALIFY row_number() OVER (PARTITION BY meli_id ORDER BY listings.precio DESC) = 1"""),
        "price_change_stream": _with("listings", """
            , d AS (SELECT concat_ws('|', marca, moneda, provincia) AS meli_id, CAST(date_trunc('quarter', fecha_snapshot) AS DATE) AS fecha_snapshot, max(precio) AS precio FROM listings GROUP BY 1, 2),
            w AS (SELECT *, lag(precio) OVER (PARTITION BY meli_id ORDER BY fecha_snapshot) AS antes FROM d)
            SELECT meli_id, fecha_snapshot, CAST(precio AS DOUBLE) AS precio, CAST(antes AS DOUBLE) AS precio_anterior,
            round(100.0 * (CAST(precio AS DOUBLE) - CAST(antes AS DOUBLE)) / CAST(antes AS DOUBLE), 4) AS variacion FROM w WHERE precio <> antes"""),
        "principal_variables": _with("macro", "SELECT indicador AS descripcion, max(fecha) AS fecha, CAST(arg_max(valor, fecha) AS DOUBLE) AS valor FROM macro GROUP BY 1"),
        "first_rows": _with("registrations", """
            SELECT fecha, marca, modelo, tipo_vehiculo, cantidad, fuente FROM registrations WHERE fecha BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AND tipo_vehiculo = 'usado'
            ORDER BY fecha DESC, marca NULLS LAST, modelo, fuente, cantidad LIMIT 100"""),
        "job_full": _with("registrations production", "") + "," + _JOB,
        "job_tables": _with("registrations production macro listings wages interest_monthly", "") + f""", {_PLACED}, late AS ({_taken("true", "2001-09-01")}),
            held_sales AS (SELECT * FROM registrations WHERE marca IS NOT NULL), held_rates AS (SELECT * FROM macro WHERE fecha BETWEEN DATE '2001-08-01' AND DATE '2001-09-01'),
            tensions AS (WITH registrations AS (SELECT * FROM held_sales), macro AS (SELECT * FROM held_rates), {_TENSION})
            SELECT 'registrations' AS tabla, count(*) AS filas FROM (SELECT DISTINCT fecha, marca, tipo_vehiculo FROM held_sales)
            UNION ALL SELECT 'production', count(*) FROM production
            UNION ALL SELECT 'macro', count(*) + count(*) FILTER (indicador = 'tasa_badlar') FROM held_rates
            UNION ALL SELECT 'listings', count(*) FROM late
            UNION ALL SELECT 'indicators/' || indicador, count(*) FROM (WITH {_JOB.replace("SELECT indicador, marca, count(*) AS meses, arg_max(valor, mes) AS ultimo FROM every WHERE valor IS NOT NULL GROUP BY 1, 2", "SELECT * FROM every WHERE valor IS NOT NULL")}) GROUP BY 1
            UNION ALL SELECT 'indicators/tension_demanda', count(*) FROM tensions WHERE valor IS NOT NULL
            UNION ALL SELECT 'indicators/accesibilidad', 1 FROM late WHERE condicion = 'new' HAVING count(*) > 0
            UNION ALL SELECT 'indicators/atencion', 1 + count(DISTINCT marca) FROM late WHERE estado = 'active' AND marca IS NOT NULL""",
        "job_daily": _with("registrations production macro listings wages interest_monthly", "") + f""", {_DAILY}
            SELECT indicador, strftime(mes, '%Y-%m') AS periodo, marca, round(valor, 4) AS valor FROM every WHERE valor IS NOT NULL UNION ALL {_ATTENTION}""",
        "job_monthly": _with("registrations production", """
            SELECT 'production' AS tabla, terminal AS grupo, count(*) AS filas, CAST(sum(unidades_producidas) + CASE WHEN CAST(right(terminal, 1) AS INT) % 2 = 0 THEN 0 ELSE count(*) END AS BIGINT) AS unidades FROM production GROUP BY 2
            UNION ALL SELECT 'registrations', 'ACARA ' || tipo_vehiculo, count(DISTINCT (fecha, marca)), CAST(sum(cantidad) AS BIGINT) FROM registrations WHERE marca IS NOT NULL GROUP BY 2"""),
        "demand_tension": _with("registrations macro interest_monthly", "") + "," + _TENSION,
        "stock_rotation": _with("registrations production", "") + "," + _ROTATION + " SELECT * FROM rotation",
        "overstock_flags": _with("registrations production", "") + "," + _ROTATION + """, l AS (SELECT *, round(avg(dias_stock) OVER (PARTITION BY marca) + stddev_samp(dias_stock) OVER (PARTITION BY marca), 4) AS limite FROM rotation)
            SELECT mes, marca, stock, dias_stock, limite FROM l WHERE dias_stock > 90 OR dias_stock > limite""",
        "affordability": _with("listings wages macro", "") + "," + _ACCESS,
        "rate_asof": _with("listings macro", """
            , published AS (SELECT * FROM macro WHERE day(fecha) % 5 = 0 AND month(fecha) <> 2),
            listed AS (SELECT meli_id, fecha_snapshot, CASE WHEN moneda = 'USD' THEN 'tasa_pf_30_dias' WHEN condicion = 'new' THEN 'tasa_badlar' ELSE 'tasa_pf_90_dias' END AS indicador FROM listings)
            SELECT meli_id, fecha_snapshot, listed.indicador, published.fecha AS fecha_tasa, CAST(valor AS DOUBLE) AS valor
            FROM listed ASOF LEFT JOIN published ON listed.indicador = published.indicador AND listed.fecha_snapshot >= published.fecha"""),
        "attention_ranking": _with("interest listings", "") + """,
            s AS (SELECT marca, CAST(sum(busquedas) AS BIGINT) AS busquedas FROM interest GROUP BY 1), a AS (SELECT marca, count(*) AS activas FROM listings WHERE estado = 'active' AND marca IS NOT NULL GROUP BY 1),
            b AS (SELECT marca, coalesce(busquedas, 0) AS busquedas, coalesce(activas, 0) AS activas FROM s FULL OUTER JOIN a USING (marca)),
            p AS (SELECT *, round(CAST(50.0 AS DOUBLE) * busquedas / max(busquedas) OVER () + CAST(50.0 AS DOUBLE) * activas / max(activas) OVER (), 4) AS puntaje FROM b)
            SELECT *, dense_rank() OVER (ORDER BY puntaje DESC) AS puesto FROM p""",
        "interest_index": _with("interest", """
            SELECT fecha, marca, busquedas, round(CAST(100.0 AS DOUBLE) * busquedas / max(busquedas) OVER (PARTITION BY marca), 4) AS indice FROM interest"""),
        "interest_by_region": """WITH r AS (SELECT 'Region#' || (user_id % 5) AS region, count(*) AS busquedas FROM events WHERE event_type IN ('view', 'click') GROUP BY 1)
            SELECT *, round(CAST(100.0 AS DOUBLE) * busquedas / max(busquedas) OVER (), 4) AS indice FROM r""",
        "production_vs_demand": _with("registrations production", "") + "," + _RATIO + " SELECT * FROM ratio",
        "forecast": _with("registrations", "") + f""", m AS ({_MONTHLY}),
            p AS (SELECT marca, CAST(mes AS DATE) AS mes, month(mes) AS m, CAST(year(mes) * 12 + month(mes) AS DOUBLE) AS x, CAST(total AS DOUBLE) AS y FROM m),
            f AS (SELECT marca, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, max(mes) AS ultimo FROM p GROUP BY 1 HAVING count(*) >= 24),
            l AS (SELECT p.*, y - a - b * x AS r FROM p JOIN f USING (marca)), s AS (SELECT marca, m, avg(r) AS efecto FROM l GROUP BY 1, 2),
            n AS (SELECT marca, stddev_samp(r - efecto) AS sigma FROM l JOIN s USING (marca, m) GROUP BY 1),
            h AS (SELECT f.*, CAST(ultimo + to_months(CAST(k AS INT)) AS DATE) AS mes FROM f, range(1, 13) t(k)),
            v AS (SELECT h.marca, h.mes, a + b * (year(h.mes) * 12 + month(h.mes)) + coalesce(efecto, 0) AS v, sigma FROM h LEFT JOIN s ON s.marca = h.marca AND s.m = month(h.mes) JOIN n ON n.marca = h.marca)
            SELECT marca, mes, round(v, 3) AS pronostico, round(v - 1.96 * sigma, 3) AS minimo, round(v + 1.96 * sigma, 3) AS maximo FROM v""",
        "anomalies": _with("registrations", "") + f""", m AS ({_MONTHLY}),
            z AS (SELECT CAST(mes AS DATE) AS mes, marca, total, CASE WHEN count(total) OVER w = 12 THEN round((total - avg(total) OVER w) / nullif(stddev_samp(total) OVER w, 0), 4) END AS z
                FROM m WINDOW w AS (PARTITION BY marca ORDER BY mes ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) SELECT * FROM z WHERE abs(z) > 2""",
        "lagged_correlation": _with("registrations macro", "") + """, u AS (SELECT fecha AS mes, CAST(sum(cantidad) AS DOUBLE) AS y FROM registrations GROUP BY 1),
            r AS (SELECT CAST(date_trunc('month', fecha) AS DATE) AS desde, indicador, CAST(sum(valor) AS DOUBLE) / count(*) AS x FROM macro GROUP BY 1, 2),
            k AS (SELECT *, CAST(k AS INT) AS rezago, CAST(desde + to_months(CAST(k AS INT)) AS DATE) AS mes FROM r, range(0, 7) t(k))
            SELECT indicador, rezago, count(*) AS meses, round(corr(x, y), 4) AS correlacion FROM k JOIN u USING (mes) GROUP BY 1, 2""",
        "segment_clusters": _with("registrations listings", "") + f""", m AS ({_MONTHLY}),
            e AS (SELECT date_trunc('month', max(fecha)) AS ultimo FROM registrations WHERE marca IS NOT NULL),
            a AS (SELECT *, date_diff('month', mes, ultimo) AS hace FROM m, e),
            t AS (SELECT marca, CAST(sum(total) AS DOUBLE) AS volumen, sum(total) FILTER (hace < 12) AS ahora, sum(total) FILTER (hace >= 12 AND hace < 24) AS antes FROM a GROUP BY 1),
            p AS (SELECT marca, avg(CAST(precio AS DOUBLE)) AS precio FROM listings WHERE marca IS NOT NULL GROUP BY 1)
            SELECT marca, volumen, round(coalesce(CAST(100.0 AS DOUBLE) * (coalesce(ahora, 0) - antes) / nullif(antes, 0), 0), 4) AS crecimiento, round(precio, 4) AS precio,
                round(CAST(100.0 AS DOUBLE) * volumen / sum(volumen) OVER (), 4) AS participacion, true AS propio FROM t LEFT JOIN p USING (marca)""",
        "seasonality": _with("registrations", "") + """, m AS (SELECT fecha AS mes, CAST(sum(cantidad) AS BIGINT) AS total FROM registrations GROUP BY 1),
            s AS (SELECT CAST(month(mes) AS INT) AS mes_del_anio, avg(total) AS media FROM m GROUP BY 1)
            SELECT mes_del_anio, round(media, 4) AS media, round(media / (SELECT avg(total) FROM m), 4) AS indice FROM s""",
    }
