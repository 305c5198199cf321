"""Exchange files: JSON lines with a header, typed records and a footer, plain or in a ZIP archive.

Export writes one file, which the driver makes partition by partition and then copies to its
place, for exchange with other systems; for large data use Parquet.  Import reads lines with
Spark; an archive, which can't be divided, is read by one task, batch by batch.  Paths are of any
file system that Spark knows.
"""

from __future__ import annotations

import io
import itertools
import json
import os
import tempfile
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.storage import upsert
from ..plans.stored import small

VERSION = 1
ENTRY = "data.jsonl"
#: Lines of an archive that are handed on at a time.
LINES = 5000
#: Record kinds in an order in which each only refers to earlier ones.
KINDS = ("type", "scheme", "structure", "user", "role", "list", "list_item", "object", "value", "permission", "function")


def lines(tables: dict[str, DataFrame]) -> Iterator[str]:
    unknown = [k for k in tables if k not in KINDS]
    if unknown:
        raise ValueError(f"unknown record kinds {unknown}")
    yield json.dumps({"type": "header", "version": VERSION, "kinds": [k for k in KINDS if k in tables]})
    counts = {}
    for kind in KINDS:
        if kind not in tables:
            continue
        n = 0
        for row in tables[kind].select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
            yield json.dumps({"type": kind, "data": json.loads(row.j)}, ensure_ascii=False)
            n += 1
        counts[kind] = n
    yield json.dumps({"type": "footer", "counts": counts})


#: Of each kind, the column that says which scheme a record belongs to.
_SCHEME_OF = {"scheme": "id", "structure": "scheme_id", "object": "scheme_id", "function": "scheme_id"}


def of_schemes(tables: dict[str, DataFrame], schemes: Sequence[int]) -> dict[str, DataFrame]:
    """The records of some schemes: these, their structures, objects and functions, and the values and permissions of those objects; other kinds whole."""
    out = {}
    for kind, df in tables.items():
        column = _SCHEME_OF.get(kind)
        out[kind] = df.where(F.col(column).isin(list(schemes))) if column and column in df.columns else df
    if "object" in out:
        kept = out["object"].select("id")
        for kind, column in (("value", "object_id"), ("permission", "id_ref")):
            if kind in out and column in out[kind].columns:
                mine = out[kind].join(small(kept.withColumnRenamed("id", column)), column, "left_semi").select(tables[kind].columns)
                out[kind] = mine.union(out[kind].where(F.col(column) == 0)) if kind == "permission" else mine
    return out


def export(tables: dict[str, DataFrame], path: str, compress: bool = False, dry_run: bool = False, schemes: Sequence[int] | None = None) -> dict[str, int]:
    """Writes the tables, or their records of some schemes; returns how many records of each kind, which is all that a dry run does."""
    if schemes is not None:
        tables = of_schemes(tables, schemes)
    if dry_run:
        return {k: df.count() for k, df in tables.items()}
    last = "{}"
    with tempfile.TemporaryDirectory(prefix="orrery-") as folder:
        local = os.path.join(folder, "export")
        with open(local, "wb") as f:
            archive = zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) if compress else None
            out = archive.open(ENTRY, "w") if archive else f
            for last in lines(tables):
                out.write(last.encode() + b"\n")
            if archive:
                out.close()
                archive.close()
        _put(next(iter(tables.values())).sparkSession, local, path)
    return json.loads(last)["counts"]


def _put(spark: SparkSession, local: str, path: str) -> None:
    """Copies a file of the driver's to a path of any file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path(f"file://{local}"), target)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of archives."""
    for batch in batches:
        for content in batch.column(0).to_pylist():
            with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(ENTRY) as f:
                whole = io.TextIOWrapper(f, "utf-8")
                while rows := list(itertools.islice(whole, LINES)):
                    yield pa.RecordBatch.from_arrays([pa.array([x.rstrip("\n") for x in rows], pa.string())], ["value"])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """type and data (JSON) of each record, from a plain file or an archive."""
    files = spark.read.format("binaryFile").load(path)
    head = spark.read.text(path).select(F.substring("value", 1, 2)).first()
    text = files.select("content").mapInArrow(_unpacked, "value string") if head and head[0] == "PK" else spark.read.text(path)
    return text.select(F.get_json_object("value", "$.type").alias("type"), F.get_json_object("value", "$.data").alias("data"), "value")


def load(spark: SparkSession, path: str, schemas: dict[str, T.StructType], check: bool = True) -> dict[str, DataFrame]:
    """A table for each kind of record that has a schema; the footer's counts are checked."""
    records = read_lines(spark, path)
    if check:
        footer = records.where("type = 'footer'").select("value").first()
        if footer is None:
            raise ValueError("the file has no footer")
        found = {r.type: r["count"] for r in records.where(~F.col("type").isin("header", "footer")).groupBy("type").count().collect()}
        wanted = {k: n for k, n in json.loads(footer.value)["counts"].items() if n}
        if found != wanted:
            raise ValueError(f"the footer counts {wanted}, the file has {found}")
    return {k: records.where(F.col("type") == k).select(F.from_json("data", s).alias("d")).select("d.*") for k, s in schemas.items()}


def imported(old: dict[str, DataFrame], loaded: dict[str, DataFrame], keys: dict[str, str] | None = None, clean: bool = False) -> dict[str, DataFrame]:
    """The tables with the loaded records: replaced by their keys (id, if not said otherwise), or, clean, instead of all that was there."""
    out = dict(old)
    for kind, df in loaded.items():
        out[kind] = df if clean or kind not in old else upsert(old[kind], df, (keys or {}).get(kind, "id"))
    return out
