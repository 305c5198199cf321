"""Changing stored objects: what a database does in place is a rewrite here, by anti-join and union."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.paths import View
from ..plans.schemes import DELETED
from ..plans.stored import apart, small
from .tree import descendants


def upsert(old: DataFrame, new: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """The new rows, and the old ones whose key isn't among them."""
    keys = [key] if isinstance(key, str) else list(key)
    return apart(old, small(new.select(keys).distinct()), keys).unionByName(new, allowMissingColumns=True)


def changed(old: DataFrame, new: DataFrame, key: str, hash: str = "hash") -> DataFrame:
    """The new rows that differ from the stored ones of their key by hash, or aren't stored."""
    known = old.select(F.col(key), F.col(hash).alias("_stored"))
    return new.join(known, key, "left").where(~F.col(hash).eqNullSafe(F.col("_stored"))).drop("_stored")


def delete_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return apart(df, small(ids.select(key).distinct()), key)


def soft_delete(view: View, ids: DataFrame) -> DataFrame:
    """All objects; those of ``ids`` (a column id) and everything below them get the deleted scheme."""
    scheme = view.base["scheme_id"]
    gone = descendants(view, ids, include_seeds=True).select(F.col("id").alias(view.id), F.lit(True).alias("_gone"))
    marked = view.df.join(small(gone), view.id, "left")
    return marked.withColumn(scheme, F.when(F.col("_gone"), F.lit(DELETED)).otherwise(F.col(scheme)).cast(view.df.schema[scheme].dataType)).select(view.df.columns)


def purge(view: View) -> DataFrame:
    """The objects without those of the deleted scheme."""
    return view.df.where(~F.col(view.base["scheme_id"]).eqNullSafe(DELETED))


def deletion_progress(view: View) -> DataFrame:
    """One row: total, and how many wait to be purged."""
    return view.df.agg(F.count("*").alias("total"), F.count_if(F.col(view.base["scheme_id"]) == DELETED).alias("deleted"))
