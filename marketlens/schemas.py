"""Schemas (as DDL) of the stored tables and of landed raw data, their merge keys, and fixed values of the domain."""

from __future__ import annotations

STAMPS = ", created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"

REGISTRATIONS = (
    "fecha DATE, anio INT, mes INT, tipo_vehiculo STRING, marca STRING, modelo STRING, segmento STRING, cantidad INT, fuente STRING, periodo_reportado STRING" + STAMPS
)
PRODUCTION = (
    "fecha DATE, anio INT, mes INT, terminal STRING, modelo STRING, segmento STRING, unidades_producidas INT, unidades_exportadas INT, fuente STRING, periodo_reportado STRING" + STAMPS
)
MACRO = "fecha DATE, indicador STRING, valor DECIMAL(18,4), unidad STRING, fuente STRING, descripcion STRING" + STAMPS
LISTINGS = (
    "meli_id STRING, fecha_snapshot DATE, marca STRING, modelo STRING, anio INT, kilometros INT, combustible STRING, precio DECIMAL(18,2), moneda STRING, provincia STRING, ciudad STRING, "
    "estado STRING, condicion STRING, visitas INT, ventas INT, titulo STRING, descripcion STRING, url STRING, es_nuevo BOOLEAN" + STAMPS
)
INDICATORS = "fecha DATE, periodo STRING, indicador STRING, marca STRING, segmento STRING, valor DECIMAL(18,4), detalles STRING, descripcion STRING, unidad STRING" + STAMPS

PRICE_STEPS = "meli_id STRING, fecha_snapshot DATE, precio DECIMAL(18,2), precio_anterior DECIMAL(18,2)" + STAMPS
REJECTS = "fecha DATE, tabla STRING, motivo STRING, fila STRING, veces BIGINT" + STAMPS

INTEREST, WAGES = "fecha DATE, marca STRING, busquedas BIGINT", "fecha DATE, salario DOUBLE"

VARIABLES_PAGE = "results ARRAY<STRUCT<descripcion: STRING, valor: STRING, fecha: STRING>>"
SERIES_PAGE = "results ARRAY<STRUCT<fecha: STRING, valor: STRING, descripcion: STRING>>"
QUOTES_PAGE = "results ARRAY<STRUCT<fecha: STRING, moneda: STRING, cotizacion: STRING>>"
LISTING_ITEM = (
    "STRUCT<id: STRING, title: STRING, price: DECIMAL(18,2), currency_id: STRING, status: STRING, condition: STRING, permalink: STRING, "
    "attributes: ARRAY<STRUCT<id: STRING, value_name: STRING>>, location: STRUCT<state: STRUCT<name: STRING>, city: STRUCT<name: STRING>>>"
)
LISTING_PAGE = f"paging STRUCT<total: BIGINT, limit: INT, offset: INT>, results ARRAY<{LISTING_ITEM}>"

KEYS = {
    "registrations": ["fecha", "marca", "tipo_vehiculo", "fuente"],
    "production": ["fecha", "terminal", "fuente"],
    "macro": ["fecha", "indicador"],
    "listings": ["meli_id", "fecha_snapshot"],
    "indicators": ["indicador", "periodo", "marca", "segmento"],
    "price_steps": ["meli_id", "fecha_snapshot"],
    "rejects": ["fecha", "tabla", "motivo", "fila"],
}
#: What stands for a missing value when a row is stored.
DEFAULTS = {
    "registrations": {"fuente": "ACARA"}, "production": {"unidades_producidas": 0, "unidades_exportadas": 0, "fuente": "ADEFA"}, "macro": {"fuente": "BCRA"},
    "listings": {"moneda": "ARS", "visitas": 0, "ventas": 0}, "indicators": {}, "price_steps": {}, "rejects": {},
}

#: The column whose month a table is stored by.
DAYS = {"registrations": "fecha", "production": "fecha", "macro": "fecha", "listings": "fecha_snapshot", "indicators": "fecha", "price_steps": "fecha_snapshot", "rejects": "fecha"}

# Series numbers of the source, brands of the default snapshot, Spanish month names.
SERIES = {"tasa_badlar": 7, "tasa_pf_30_dias": 8, "tasa_pf_90_dias": 9, "tipo_cambio_bna": 1, "reservas": 2, "creditos_totales": 16}
BRANDS = ["Toyota", "Ford", "Volkswagen", "Chevrolet", "Fiat", "Renault", "Peugeot", "Nissan", "Honda", "Jeep", "RAM", "Citroen", "Mercedes-Benz", "BMW", "Audi"]
MONTHS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]
SHORT_MONTHS = ["ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic"]
