"""What the operators share: written stages, and the package on the executors."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, as in tests, one of our own, but only if there are no other machines."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = Path(tempfile.gettempdir(), f"orrery-{os.getpid()}").as_uri()
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def unused(name: str, columns: Iterable[str]) -> str:
    """The name, with as many underscores behind it as make it none of the columns (which Spark compares without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def saved(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes a table to the shared folder and reads it: later jobs don't compute it again, and lost executors don't matter."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What Spark hands to Python at a time, in rows and bytes: long texts times Spark's 10,000 rows would take hundreds of MB in each of two processes.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}


def shipped(spark: SparkSession) -> SparkSession:
    """Gives the executors this package, once per context, and bounds the batches of this session."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    context = spark.sparkContext
    if not getattr(context, "_orrery_shipped", False):
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="orrery-"), "orrery.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(str(archive))
        context._orrery_shipped = True
    return spark


@lru_cache(maxsize=1)
def _trim():
    """glibc's malloc_trim; nothing where there is another libc."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


_KEPT: list = []


def per_worker(make):
    """Keeps what a function makes for the next tasks of a worker, until a task of another operator begins there."""
    kept = lru_cache(maxsize=2)(make)
    _KEPT.append(kept)
    return kept


def lean(batches: Iterator[T], *own) -> Iterator[T]:
    """The same batches; what was kept per worker, but by ``own``, goes first.

    When they end, what the worker has freed goes back to the system, as idle workers share its memory with the next stages.
    """
    for kept in _KEPT:
        if kept not in own:
            kept.cache_clear()
    pa.set_memory_pool(pa.system_memory_pool())  # Arrow's own keeps what it frees
    try:
        yield from batches
    finally:
        _trim()(0)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def slices(spark: SparkSession) -> int:
    """Partitions of a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """Marks a table for broadcast if it has no more rows than a stated bound."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def tokenizer_path(name: str) -> str:
    """A file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)
