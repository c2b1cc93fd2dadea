"""Tables as Parquet folders by month, one writer a table at a time.

A merge reads and writes only the months of its batch: its rows are first written aside, in a folder of their own or by Spark's
dynamic partition overwrite, which puts them in place, so what is being read is never overwritten and other months are not touched.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.sources.shared import materialise


class Store:
    """Folders root/table/_month=2024-01 and so on."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def read(self, table: str, schema: str | None = None, months: Iterable[str] | None = None) -> DataFrame:
        """The table, or only some months of it; where there is nothing yet, an empty table of the schema given."""
        try:
            rows = self.spark.read.parquet(f"{self.root}/{table}")
        except AnalysisException as problem:
            if schema is None or problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return self.spark.createDataFrame([], schema)
        if months is not None:
            rows = rows.filter(F.col("_month").cast("string").isin(list(months)))
        return rows.drop("_month")

    def has(self, table: str) -> bool:
        """Whether the table has been written to."""
        try:
            self.spark.read.parquet(f"{self.root}/{table}")
        except AnalysisException as problem:
            if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return False
        return True

    def write(self, table: str, df: DataFrame, day: str, months: int | None = None, aside: bool = True) -> DataFrame | None:
        """Puts whole months in place of what the table has of them; the rows as written, with their actions.

        months: how many there are, if known. Without `aside` nothing is returned, and the rows are written once: Spark's overwrite
        puts them in place when all of them have been read and written."""
        rows = df.withColumn("_month", F.date_format(day, "yyyy-MM"))
        rows = rows if months == 1 else rows.hint("rebalance", "_month")  # few files a month, large months split
        rows = materialise(rows, table) if aside else rows
        rows.drop("action").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_month").parquet(f"{self.root}/{table}")
        return rows.drop("_month") if aside else None


def export_csv(df: DataFrame, folder: str, name: str, stamp: str) -> str:
    """CSV files with headers in a folder named by table and time."""
    path = f"{folder.rstrip('/')}/{name}_{stamp}"
    df.write.csv(path, header=True)
    return path
