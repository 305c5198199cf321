"""Lists: named dictionaries of items (id, value, alias) that properties refer to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.stored import numbered, small, stored

ITEM = "struct<Id: bigint, Value: string, Alias: string>"


def items(df: DataFrame, value: str, alias: str | None = None, id: str | None = None) -> DataFrame:
    """A list of the distinct values of a column; ids count them from 1 in order of the values unless a column gives them."""
    if id:
        return df.select(F.col(id).cast("long").alias("id"), F.col(value).cast("string").alias("value"), (F.col(alias) if alias else F.lit(None)).cast("string").alias("alias")).distinct()
    values = df.select(F.col(value).cast("string").alias("value")).where("value is not null").distinct()
    return numbered(values, "id", "value").select("id", "value", F.lit(None).cast("string").alias("alias"))


def with_items(df: DataFrame, column: str, items: DataFrame) -> DataFrame:
    """A column of item ids, or an array of them, becomes items (Id, Value, Alias), so ``column.Value`` is a path."""
    item = F.struct(F.col("id").alias("Id"), F.col("value").alias("Value"), F.col("alias").alias("Alias"))
    lookup = items.select(F.col("id").alias("_item_id"), item.alias("_item"))
    if isinstance(df.schema[column].dataType, T.ArrayType):
        keyed = stored(df.withColumn("_row", F.monotonically_increasing_id()), "rows")  # the same rows on both sides of the join
        each = keyed.select("_row", F.posexplode(column).alias("_at", "_item_id")).join(small(lookup), "_item_id", "left")
        whole = each.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", "_item"))).alias("_items"))
        back = keyed.join(whole, "_row", "left")
        filled = F.coalesce(F.transform("_items", lambda x: x["_item"]), F.when(F.col(column).isNotNull(), F.array().cast(f"array<{ITEM}>")))
        return back.withColumn(column, filled).drop("_row", "_items")
    joined = df.join(small(lookup), df[column] == F.col("_item_id"), "left")
    return joined.withColumn(column, F.col("_item")).drop("_item_id", "_item").select(df.columns)


def used(items: DataFrame, uses: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """The items that any of the columns of item ids refers to."""
    out = None
    for df, column in uses:
        ids = df.select(F.col(column).alias("id"))
        out = ids if out is None else out.union(ids)
    return items.join(out.where("id is not null").distinct(), "id", "left_semi")  # a task of the join has a row per item, not per use


def add_items(items: DataFrame, values: DataFrame) -> DataFrame:
    """The items and those of ``values`` (value, and maybe alias) that aren't there by value, with ids above the others."""
    values = values if "alias" in values.columns else values.withColumn("alias", F.lit(None).cast("string"))
    new = values.select("value", "alias").where("value is not null").groupBy("value").agg(F.min("alias").alias("alias")).join(items, "value", "left_anti")
    top = items.agg(F.max("id")).first()[0] or 0
    return items.unionByName(numbered(new, "id", "value", start=int(top) + 1).select("id", "value", "alias"))


def update_items(items: DataFrame, changes: DataFrame) -> DataFrame:
    """The items with the values and aliases of ``changes`` (id, value, alias) where these aren't null; unknown ids are left out."""
    new = changes.select("id", F.col("value").alias("_value"), F.col("alias").alias("_alias"))
    joined = items.join(small(new), "id", "left")
    return joined.select("id", F.coalesce("_value", "value").alias("value"), F.coalesce("_alias", "alias").alias("alias"))


def delete_items(items: DataFrame, ids: DataFrame, uses: Sequence[tuple[DataFrame, str]] = ()) -> DataFrame:
    """The items without those of ``ids`` (a column id); an error if a column of item ids refers to one of them."""
    gone = items.join(small(ids.select("id").distinct()), "id", "left_semi")
    if uses:
        found = [r.id for r in used(gone, uses).limit(5).collect()]
        if found:
            raise ValueError(f"items in use: {found}")
    return items.join(small(gone.select("id")), "id", "left_anti")


def sync_items(items: DataFrame, values: DataFrame) -> DataFrame:
    """The list of exactly these values, as of an enumeration: items that are there keep their ids, the others go."""
    return add_items(items.join(small(values.select("value").distinct()), "value", "left_semi").select("id", "value", "alias"), values)


def by_value(items: DataFrame, value: str) -> DataFrame:
    return items.where(F.col("value") == value)
