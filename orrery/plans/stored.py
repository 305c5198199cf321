"""Tables written in the middle of a plan, so that loops don't grow their lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of two longs that are broadcast at most.
BROADCAST_ROWS = 1_000_000

#: Rows for each task, where rows are dealt out by their number.
TASK_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, as in tests, one of our own, but only if there are no other machines."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = Path(tempfile.gettempdir(), f"orrery-{os.getpid()}").as_uri()
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_with(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """The written table, and aggregates of it that are made on the way."""
    seen = Observation()
    out = stored(df.observe(seen, *[c.alias(k) for k, c in counts.items()]), name)
    return out, seen.get


def tasks(rows: int) -> int:
    """How many tasks so many rows are dealt out to, so that none gets more of a larger table."""
    return max(1, -(-rows // TASK_ROWS))


def small(df: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a table for broadcast if it has no more rows than a bound."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def numbered(df: DataFrame, name: str, *order: str, start: int = 1) -> DataFrame:
    """Adds a column that counts the rows in an order, without gaps: by ranges, each in a task of its own, shifted by the rows before."""
    part, at, before = "_part", "_at", "_before"
    df, n = stored_with(df, "unnumbered", n=F.count("*"))
    ranged = df.repartitionByRange(tasks(n["n"]), *[F.col(c) for c in order]).sortWithinPartitions(*order)
    in_part = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))  # rows of a partition before this one
    ranged = stored(ranged.withColumn(part, F.spark_partition_id()).withColumn(at, in_part), "numbered")
    sums = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = ranged.groupBy(part).agg(F.count("*").alias("n")).select(part, F.coalesce(F.sum("n").over(sums), F.lit(0)).alias(before))
    rows = ranged.join(F.broadcast(offsets), part)
    return rows.withColumn(name, (F.col(before) + F.col(at) + start).cast("long")).drop(part, at, before)


def among(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in ``keys``, each there once. Spark would make a semi-join for each table of a union, and with few rows in one, a task of it gets all keys."""
    return df.join(keys.select(key), key).select(df.columns)


def apart(df: DataFrame, keys: DataFrame, key: str | list[str]) -> DataFrame:
    """The rows whose key is not in ``keys``, each there once; no anti-join, as in ``among``."""
    found = keys.select(*([key] if isinstance(key, str) else key), F.lit(True).alias("_found"))
    return df.join(found, key, "left").where("_found is null").select(df.columns)
