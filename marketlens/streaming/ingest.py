"""Merges into the store, and incremental ingest of landed listing pages: with and without state, in whatever order files come."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructField, StructType

from marketlens import schemas
from marketlens.functions.parse import change_percent
from marketlens.operators.merge import merge_last
from marketlens.operators.rejects import RAW, REASON, marked, split, unmarked
from marketlens.sources.landing import flatten_listings, listing_rows
from marketlens.sources.shared import discard, let_go
from marketlens.sources.store import Store


#: Of rows with equal keys in a batch those with the greatest value of this column win, if the batch has it.
PRECEDENCE = "precedencia"


@dataclass(frozen=True)
class Merged:
    """The rows of the months that were touched, each with its action (if asked for), the months, and how many rows were read and rejected."""

    rows: DataFrame | None
    months: list[str]
    read: int
    rejected: int


def conform(df: DataFrame, name: str, as_of: datetime) -> DataFrame:
    """The stored table's columns, in its types; what is missing is the default or null, the time stamps are as_of."""
    table, defaults = StructType.fromDDL(getattr(schemas, name.upper())), schemas.DEFAULTS[name]

    def column(field: StructField) -> Column:
        if field.name in ("created_at", "updated_at"):
            return F.lit(as_of).cast("timestamp_ntz").alias(field.name)
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        return F.coalesce(value.cast(field.dataType), F.lit(defaults.get(field.name)).cast(field.dataType)).alias(field.name)

    return df.select(*map(column, table), *(c for c in (REASON, RAW, PRECEDENCE) if c in df.columns))


def merge_into(store: Store, table: str, batch: DataFrame, compare: list[str], set_columns: list[str], as_of: datetime, order: list[str], rows: bool = True) -> Merged:
    """Merges a batch into the months of a stored table that it has rows of. rows: whether the merged rows are wanted.

    The batch is read once: rows that its reader marked, and rows without a day, go to the store's rejects with their reason.
    """
    keys, day = schemas.KEYS[table], schemas.DAYS[table]
    dated = conform(unmarked(batch), table, as_of)
    without_day = F.col(day).isNull() & F.col(REASON).isNull()
    read = F.to_json(F.struct(*(c for c in dated.columns if c not in (REASON, RAW, "created_at", "updated_at"))))
    parts = split(dated.withColumns({REASON: F.when(without_day, "sin fecha").otherwise(F.col(REASON)), RAW: F.when(without_day, read).otherwise(F.col(RAW))}), f"{table}-batch")
    months = [r[0] for r in parts.good.select(F.date_format(day, "yyyy-MM")).distinct().collect()]  # as many as months
    first = [PRECEDENCE] if PRECEDENCE in parts.good.columns else []
    merged = merge_last(store.read(table, getattr(schemas, table.upper()), months), parts.good, keys, [*first, *order], compare, set_columns, as_of)
    written = store.write(table, merged, day, len(months), aside=rows)
    if parts.rejected:
        refused = parts.bad.groupBy(F.col(REASON).alias("motivo"), F.col(RAW).alias("fila")).agg(F.count("*").alias("veces"))
        refused = refused.withColumns({"tabla": F.lit(table), "fecha": F.trunc(F.lit(as_of).cast("date"), "MM")})
        merge_into(store, "rejects", refused, ["veces"], ["veces"], as_of, ["veces"], rows=False)
    discard(store.spark, parts.folder)
    return Merged(written, months, parts.read, parts.rejected)


def ingest_listings(spark: SparkSession, landing: str, store: Store, checkpoint: str, as_of: datetime, snapshot: str | None = None) -> None:
    """Runs over the files that have come since the last run and ends; a replay changes nothing, as merges go by key.

    The snapshot's day is that of each file's folder (snapshot=2024-01-31), unless one is given for all."""
    items = _landed_items(spark, landing, snapshot is None)
    day = snapshot or F.col("snapshot")

    def merge(batch: DataFrame, _: int) -> None:
        let_go(spark)
        merge_into(store, "listings", listing_rows(batch, day), ["precio"], ["precio", "estado"], as_of, ["precio"], rows=False)

    items.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _landed_items(spark: SparkSession, landing: str, by_folder: bool) -> DataFrame:
    schema = schemas.LISTING_PAGE + (", snapshot DATE" if by_folder else "")
    return spark.readStream.schema(schema).json(landing).select(*(["snapshot"] if by_folder else []), F.explode("results").alias("item"))


#: What price_steps() emits, and what it keeps of a listing: the days (since 1970) and prices that later files can still come between.
STEPS = "meli_id STRING, fecha_snapshot DATE, precio DECIMAL(18,2), precio_anterior DECIMAL(18,2), tarde BOOLEAN"
KEPT = "dias ARRAY<INT>, precios ARRAY<STRING>"


def _neighbours(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The days of one listing that are new or have another price, and the days right after them, each with the price before.

    Rows before the watermark come too late: they are emitted as such and change nothing."""
    known = dict(zip(*state.get, strict=True)) if state.exists else {}
    settled = state.getCurrentWatermarkMs() // 86_400_000
    changed, late = set(), []
    for frame in frames:
        for day, price in zip(frame["dia"], frame["precio"], strict=True):
            if day < settled:
                late.append((day, price))
            elif day not in known or Decimal(known[day]) < price:  # of several prices of a day the highest counts
                known[day] = str(price)
                changed.add(day)
    days = sorted(known)
    rows = [(days[k], Decimal(known[days[k]]), Decimal(known[days[k - 1]]) if k else None, False) for k in range(len(days)) if days[k] in changed or k and days[k - 1] in changed]
    rows += [(day, price, None, True) for day, price in late]
    past = [d for d in days if d < settled][-1:]
    kept = past + [d for d in days if d >= settled]
    state.update((kept, [known[d] for d in kept]))
    epoch = date(1970, 1, 1)
    yield pd.DataFrame([(key[0], epoch + timedelta(days=int(d)), p, was, tarde) for d, p, was, tarde in rows], columns=["meli_id", "fecha_snapshot", "precio", "precio_anterior", "tarde"])


def ingest_price_steps(spark: SparkSession, landing: str, store: Store, checkpoint: str, as_of: datetime, delay: str = "90 days", files: int = 1000) -> None:
    """Keeps, by listing and snapshot, the price and that of the snapshot before, whatever order the files come in.

    Event time is the day of a file's folder. A listing's days since the watermark (the latest day seen less `delay`), and the one
    before, are in the state store, so a file that comes late is put between its neighbours, and a repeated one changes nothing.
    What comes later than that is in the store's rejects. A restart from the checkpoint goes on where the last run ended.
    """
    pages = spark.readStream.schema(schemas.LISTING_PAGE + ", snapshot DATE").option("maxFilesPerTrigger", files).json(landing)
    rows = flatten_listings(pages.select("snapshot", F.explode("results").alias("item")), F.col("snapshot"))
    timed = rows.select("meli_id", F.unix_date("fecha_snapshot").alias("dia"), "precio", F.col("fecha_snapshot").cast("timestamp").alias("momento")).withWatermark("momento", delay)
    steps = timed.groupBy("meli_id").applyInPandasWithState(_neighbours, STEPS, KEPT, "update", "NoTimeout")

    def merge(batch: DataFrame, _: int) -> None:
        late = marked(batch, {"tarde": F.col("tarde")}, F.to_json(F.struct("meli_id", "fecha_snapshot", "precio"))).drop("tarde")
        merge_into(store, "price_steps", late, ["precio", "precio_anterior"], ["precio", "precio_anterior"], as_of, ["precio"], rows=False)

    steps.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def price_changes(store: Store) -> DataFrame:
    """The stored steps at which a listing's price differs from that of the snapshot before."""
    steps = store.read("price_steps", schemas.PRICE_STEPS).filter(F.col("precio") != F.col("precio_anterior"))
    now, was = F.col("precio").cast("double"), F.col("precio_anterior").cast("double")
    return steps.select("meli_id", "fecha_snapshot", now.alias("precio"), was.alias("precio_anterior"), F.round(change_percent(now, was), 4).alias("variacion"))
