"""Reading and writing objects: tables, JSON, and the long form of one row per value."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.paths import BASE, View
from ..plans.schemes import DELETED


def load(spark: SparkSession, path: str, base: dict[str, str] | None = None, props: str | None = None, scheme: str | None = None, format: str = "parquet") -> View:
    """A table of objects; rows of the deleted scheme are left out if there is a scheme column."""
    df = spark.read.format(format).load(path)
    base = dict(base or {k: k for k in BASE.values() if k in df.columns})
    if "scheme_id" in base:
        df = df.where(~F.col(base["scheme_id"]).eqNullSafe(DELETED))
    return View(df, base, props, scheme or path.rstrip("/").rsplit("/", 1)[-1].split(".")[0])


def by_ids(view: View, ids: Sequence) -> DataFrame:
    return view.df.where(F.col(view.id).isin(list(ids)))


def with_reference(df: DataFrame, key: str, target: View, name: str) -> DataFrame:
    """Adds the object that ``key`` refers to, as a struct; null if it isn't there."""
    columns = [c for c in target.df.columns]
    other = target.df.select(F.col(target.id).alias(f"_{name}_id"), F.struct(*columns).alias(name))
    return df.join(other, df[key] == F.col(f"_{name}_id"), "left").drop(f"_{name}_id")


def to_json(view: View, name: str = "json") -> DataFrame:
    """id and the object as JSON: base columns and, under ``properties``, the rest; nulls are left out."""
    base = [c for c in view.df.columns if c in set(view.base.values())]
    props = F.col(view.props) if view.props else F.struct(*[c for c in view.df.columns if c not in base])
    return view.df.select(F.col(view.id), F.to_json(F.struct(*base, props.alias("properties"))).alias(name))


def graph_to_json(rows: DataFrame, id: str, name: str = "json") -> DataFrame:
    """id and the object, with the objects nested in it (as of graph.load_graph), as JSON; nulls are left out."""
    return rows.select(F.col(id), F.to_json(F.struct(*rows.columns)).alias(name))


def from_json(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON objects; unknown fields are skipped, missing ones are null."""
    return df.select(F.from_json(column, schema).alias("_o")).select("_o.*")


_SLOTS = {"_string": "string", "_long": "long", "_double": "double", "_numeric": "decimal(38,18)", "_boolean": "boolean", "_datetime": "timestamp"}


def _slot(kind: T.DataType) -> str | None:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "_long"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "_double"
    if isinstance(kind, T.DecimalType):
        return "_numeric"
    if isinstance(kind, T.BooleanType):
        return "_boolean"
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return "_datetime"
    return "_string" if isinstance(kind, T.StringType) else None


def _indexed(cell: Callable[..., Column], name: str, kind: T.DataType) -> Callable[[Column, Column], Column]:
    return lambda x, i: cell(name, i, x, kind)


def to_values(df: DataFrame, id: str, fields: Sequence[str] | None = None) -> DataFrame:
    """The long form: id, structure, index (of array elements) and one typed column that is set; nulls have no row."""
    fields = list(fields or [c for c in df.columns if c != id])
    entries: list[Column] = []
    empty = {s: F.lit(None).cast(t) for s, t in _SLOTS.items()}

    def cell(name: str, index: Column, value: Column, kind: T.DataType) -> Column:
        slot = _slot(kind)
        if slot is None:
            slot, value = "_string", F.to_json(value)
        cells = {**empty, slot: value.cast(_SLOTS[slot])}
        return F.struct(F.lit(name).alias("structure"), index.cast("int").alias("index"), *[c.alias(s) for s, c in cells.items()], value.isNotNull().alias("_set"))

    for f in fields:
        kind = df.schema[f].dataType
        if isinstance(kind, T.ArrayType):
            entries.append(F.coalesce(F.transform(df[f], _indexed(cell, f, kind.elementType)), F.array()))
        else:
            entries.append(F.array(cell(f, F.lit(None), df[f], kind)))
    rows = df.select(F.col(id), F.explode(F.concat(*entries)).alias("_e")).where("_e._set")
    return rows.select(id, "_e.structure", "_e.index", *[f"_e.{s}" for s in _SLOTS])


def from_values(values: DataFrame, id: str, schema: T.StructType, objects: DataFrame | None = None) -> DataFrame:
    """The long form pivoted to a column per field.  With ``objects``, ids without any value are rows of nulls."""
    columns = []
    for f in schema.fields:
        is_array = isinstance(f.dataType, T.ArrayType)
        kind = f.dataType.elementType if is_array else f.dataType
        value = F.col(_slot(kind)).cast(kind) if _slot(kind) else F.from_json("_string", kind)
        mine = F.col("structure") == f.name
        if is_array:
            ordered = F.array_sort(F.collect_list(F.when(mine, F.struct("index", value.alias("v")))))
            columns.append(F.nullif(F.transform(ordered, lambda x: x["v"]), F.array().cast(f.dataType)).alias(f.name))
        else:
            columns.append(F.max(F.when(mine, value)).alias(f.name))
    out = values.groupBy(id).agg(*columns)
    return objects.select(id).join(out, id, "left") if objects is not None else out
