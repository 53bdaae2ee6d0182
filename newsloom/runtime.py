"""Shared plumbing: reading tables, picking the delivery that counts, cutting lineage."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a driver-checked side is broadcast; beyond it the join stays a shuffle join.
MAX_BROADCAST_ROWS = 100_000


def micros(c: str) -> Column:
    """Microseconds since 1970 of a timestamp that holds UTC, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({c} as timestamp_ntz))")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none a local one is set on one machine; on a cluster, whose
    executors could not read each other's parts there, it raises."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[\w*, ]+\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir names no folder that the executors of {master} share")
        where = tempfile.mkdtemp(prefix="newsloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers of all executors this package, once per application, so nothing has to be installed there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/newsloom/code-{uuid.uuid4().hex}/newsloom_code.zip")
    out = where.getFileSystem(sc._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addPyFile(where.toString())
    _SHIPPED.add(app)


def _new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/newsloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut_text(lines: DataFrame, name: str) -> str:
    """Write a column of texts as lines into the shared folder; the path."""
    path = _new_path(lines.sparkSession, name)
    lines.write.text(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it back: a cut of the lineage that outlives executors."""
    path = _new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_cuts(spark: SparkSession) -> None:
    """Remove all cuts of this application; frames that read them are of no use afterwards."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/newsloom/{sc.applicationId}")
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def earliest(df: DataFrame, keys: Sequence[str], ties: Sequence[str] = (), at: str = "ingested_at") -> DataFrame:
    """The row with the earliest `at` of each key.

    Nulls in `at` come last; equal times are settled by the columns `ties`, smallest first with nulls last, and rows
    that agree in those too are alike for the caller, so either may stand. A null key is a key of its own.
    """
    order = [F.col(at).asc_nulls_last(), *(F.col(c).asc_nulls_last() for c in ties)]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def small(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows (counted, not estimated), else df as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
