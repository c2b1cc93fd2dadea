"""The folder that driver and executors share, where work in progress is written."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on a local master, and an error on any other."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
        return full if "://" in full else full.replace(":/", ":///", 1)
    master = spark.sparkContext.master
    if master.partition("[")[0] != "local":
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} see")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="marketlens-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/marketlens/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder of new_folder() that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def let_go(spark: SparkSession) -> None:
    """Shuffle files of queries that have ended go once the driver collects its garbage, which else may be at any time."""
    gc.collect()
    spark._jvm.System.gc()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage is cut and lost executors cost nothing."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
