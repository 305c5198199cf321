"""Objects that refer to other objects: loading them nested, to a depth, and saving them.

A store is a view for each scheme; ``references`` says which fields of a scheme hold ids of
objects of which scheme: one id, an array of ids, or a map of ids.  Loading turns the ids to
the objects, as structs.  At depth 0 an object has its base columns only.  Saving takes the
nested objects out again, a table for each scheme.

Scale: a reference is a join of the ids that occur with the target's table, which is broadcast
if it is small; arrays and maps are exploded, joined and collected by row.  A plan has as many
joins as there are references on the way to the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.storage import upsert
from ..plans.paths import View
from ..plans.schemes import object_hash
from ..plans.stored import numbered, small, stored

Store = dict[str, View]
References = dict[str, dict[str, str]]
DEPTH = 10
_ROW, _AT, _ID = "_graph_row", "_graph_at", "_graph_id"


def load_graph(store: Store, references: References, scheme: str, rows: DataFrame | None = None, depth: int = DEPTH) -> DataFrame:
    """The objects of a scheme (``rows`` of its table, by default all) with the objects they refer to; what isn't there is null."""
    view = store[scheme]
    df = view.df if rows is None else rows
    if depth <= 0:
        return df.select([c for c in df.columns if c in set(view.base.values())])
    for name, target in references.get(scheme, {}).items():
        df = _with_objects(df, name, _nested(store, references, target, _ids(df, name), depth - 1))
    return df


def _ids(df: DataFrame, name: str) -> DataFrame:
    kind = df.schema[name].dataType
    if isinstance(kind, T.ArrayType):
        ids = df.select(F.explode(name).alias(_ID))
    elif isinstance(kind, T.MapType):
        ids = df.select(F.explode(F.map_values(name)).alias(_ID))
    else:
        ids = df.select(F.col(name).alias(_ID))
    return ids.where(F.col(_ID).isNotNull()).distinct()


def _nested(store: Store, references: References, target: str, ids: DataFrame, depth: int) -> DataFrame:
    """The target's objects of these ids: id, and the object as a struct."""
    view = store[target]
    wanted = view.df.join(small(ids), F.col(view.id) == F.col(_ID), "left_semi")
    found = load_graph(store, references, target, wanted, depth)
    return found.select(F.col(view.id).alias(_ID), F.struct(*found.columns).alias("_object"))


def _with_objects(df: DataFrame, name: str, objects: DataFrame) -> DataFrame:
    """The field's ids replaced by the objects."""
    kind, columns = df.schema[name].dataType, df.columns
    if not isinstance(kind, (T.ArrayType, T.MapType)):
        return df.join(objects, F.col(name) == F.col(_ID), "left").withColumn(name, F.col("_object")).select(columns)
    keyed = stored(df.withColumn(_ROW, F.monotonically_increasing_id()), "graph")  # the same rows on both sides of the join
    is_map = isinstance(kind, T.MapType)
    each = keyed.select(_ROW, F.explode(name).alias(_AT, _ID) if is_map else F.posexplode(name).alias(_AT, _ID))
    each = each.join(objects, _ID, "left")
    entries = F.array_sort(F.collect_list(F.struct(_AT, "_object")), lambda a, b: F.when(a[_AT] < b[_AT], -1).when(a[_AT] > b[_AT], 1).otherwise(0))
    whole = each.groupBy(_ROW).agg(entries.alias("_entries"))
    made: Column = F.map_from_entries("_entries") if is_map else F.transform("_entries", lambda x: x["_object"])
    back = keyed.join(whole.select(_ROW, made.alias("_made")), _ROW, "left")
    empty = (F.map_from_arrays(F.array(), F.array()) if is_map else F.array()).cast(back.schema["_made"].dataType)
    return back.withColumn(name, F.coalesce("_made", F.when(F.col(name).isNotNull(), empty))).select(columns)


def save_graph(store: Store, references: References, scheme: str, rows: DataFrame, missing: str = "insert", hash: str = "hash") -> dict[str, DataFrame]:
    """The tables of all schemes that change, with the nested objects saved.

    rows: as load_graph() gives them.  Objects without an id get new ones above the stored; of
    several with one id one is saved.  A column of the name ``hash`` is computed anew from the
    properties.  missing: what happens to an id that isn't stored, "insert", "error", or "skip"
    (it isn't saved, and references to it are null).
    """
    if missing not in ("insert", "error", "skip"):
        raise ValueError(f"unknown strategy {missing}")
    new: dict[str, DataFrame] = {}
    _take_out(store, references, scheme, rows, new, missing, hash)
    return {name: upsert(store[name].df, df, store[name].id) for name, df in new.items()}


def _take_out(store: Store, references: References, scheme: str, rows: DataFrame, new: dict[str, DataFrame], missing: str, hash: str) -> DataFrame:
    """Adds the objects, and those in them, to ``new``; returns _graph_row and the id of each row's object."""
    view = store[scheme]
    if _ROW not in rows.columns:
        rows = rows.withColumn(_ROW, F.monotonically_increasing_id())
    rows = stored(rows, "graph")
    for name, target in references.get(scheme, {}).items():
        kind = rows.schema[name].dataType
        item = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType if isinstance(kind, T.MapType) else kind
        if not isinstance(item, T.StructType):
            continue  # ids already
        if item is kind:
            inner = rows.where(F.col(name).isNotNull()).select(_ROW, f"{name}.*")
            ids = _take_out(store, references, target, inner, new, missing, hash)
            rows = rows.join(ids, _ROW, "left").withColumn(name, F.col(_ID)).drop(_ID)
            continue
        is_map = isinstance(kind, T.MapType)
        each = rows.select(F.col(_ROW).alias("_outer"), F.explode(name).alias(_AT, "_object") if is_map else F.posexplode(name).alias(_AT, "_object"))
        each = stored(each.withColumn(_ROW, F.monotonically_increasing_id()), "graph")
        ids = _take_out(store, references, target, each.where("_object is not null").select(_ROW, "_object.*"), new, missing, hash)
        entries = F.array_sort(F.collect_list(F.struct(_AT, _ID)))
        whole = each.join(ids, _ROW, "left").groupBy(F.col("_outer").alias(_ROW)).agg(entries.alias("_entries"))
        made = F.map_from_entries("_entries") if is_map else F.transform("_entries", lambda x: x[_ID])
        back = rows.join(whole.select(_ROW, made.alias("_made")), _ROW, "left")
        empty = (F.map_from_arrays(F.array(), F.array()) if is_map else F.array()).cast(back.schema["_made"].dataType)
        rows = back.withColumn(name, F.coalesce("_made", F.when(F.col(name).isNotNull(), empty))).drop("_made")
    rows = _with_ids(view, stored(rows, "graph"))
    known = rows.join(view.df.select(F.col(view.id).alias("_known")), F.col(view.id) == F.col("_known"), "left").withColumn("_is", F.col("_known").isNotNull() | F.col("_new"))
    known = stored(known.drop("_known", "_new"), "graph")
    if missing != "insert":
        lost = known.where("not _is")
        if missing == "error" and not lost.isEmpty():
            raise ValueError(f"objects of {scheme} that are not stored: {[r[view.id] for r in lost.select(view.id).limit(5).collect()]}")
        known = known.where("_is")
    kept = known.drop("_is")
    one = kept.groupBy(view.id).agg(F.min_by(F.struct(*[c for c in kept.columns if c not in (view.id, _ROW)]), _ROW).alias("_one")).select(view.id, "_one.*")
    if hash in one.columns:
        properties = T.StructType([f for f in one.schema.fields if f.name not in set(view.base.values()) and f.name != hash])
        one = one.withColumn(hash, object_hash(properties))
    have = view.df.schema
    one = one.select(*[(F.col(f.name) if f.name in one.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in have.fields])
    # What is nested deeper comes first; the same scheme may be met on several ways.
    new[scheme] = upsert(new[scheme], one, view.id) if scheme in new else one
    return kept.select(_ROW, F.col(view.id).alias(_ID))


def _with_ids(view: View, rows: DataFrame) -> DataFrame:
    """Ids above the stored for rows without one; _new says which."""
    fresh = F.col(view.id).isNull()
    have = rows.where(~fresh).withColumn("_new", F.lit(False))
    if rows.where(fresh).isEmpty():
        return have
    top = max(x.first()[0] or 0 for x in (view.df.agg(F.max(view.id)), rows.agg(F.max(view.id))))
    made = numbered(rows.where(fresh), view.id, _ROW, start=int(top) + 1).withColumn("_new", F.lit(True))
    return have.unionByName(made)
