"""Lazy queries over object views.

A query is immutable; every step returns a new one.  Nothing runs before a terminal.  As
``count`` and the aggregates ignore order, ``take`` and ``skip``, so do they here; a projected
query filters and sorts after them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.compiler import Compiler
from ..plans.nodes import tree_of
from ..plans.paths import BASE, View
from .group import ArrayGrouped, Grouped
from .window import Windowed


@dataclass(frozen=True)
class Query:
    view: View
    filters: tuple[Any, ...] = ()
    orders: tuple[Any, ...] = ()
    limit: int | None = None
    offset: int = 0
    unique: str | None = None  # "props", "base" or "by"
    unique_by: tuple[Any, ...] = ()
    extra: dict[str, Callable[[Any], Column]] = field(default_factory=dict)

    # Building.

    def compiler(self) -> Compiler:
        return Compiler(self.view, self.extra)

    def where(self, condition: Any) -> Query:
        """A filter, an expression or a column; several are all required."""
        return replace(self, filters=(*self.filters, condition))

    where_base = where

    def where_in(self, path: str, values: Sequence[Any]) -> Query:
        """No values, no rows."""
        return self.where({path: {"$in": list(values)}})

    def order_by(self, key: Any, desc: bool = False) -> Query:
        """Replaces any order before."""
        return replace(self, orders=(_order(key, desc),))

    def then_by(self, key: Any, desc: bool = False) -> Query:
        return replace(self, orders=(*self.orders, _order(key, desc)))

    def order(self, keys: Sequence[Any]) -> Query:
        return replace(self, orders=tuple(keys))

    def take(self, n: int) -> Query:
        if n < 0:
            raise ValueError("take of a negative number")
        return replace(self, limit=n)

    def skip(self, n: int) -> Query:
        if n < 0:
            raise ValueError("skip of a negative number")
        return replace(self, offset=n)

    def distinct(self) -> Query:
        """One object for each combination of properties."""
        return replace(self, unique="props")

    def distinct_base(self) -> Query:
        """One object for each combination of base columns but the id."""
        return replace(self, unique="base")

    def distinct_by(self, *keys: Any) -> Query:
        """The first object, in the query's order, of each key; the result is ordered by the key first."""
        if self.unique:
            raise ValueError("distinct_by excludes distinct")
        return replace(self, unique="by", unique_by=keys)

    # Plans.

    def filtered(self) -> DataFrame:
        df = self.view.df
        if not self.filters:
            return df
        compiler = self.compiler()
        for f in self.filters:
            df = df.where(compiler.filter(f))
        return df

    def df(self) -> DataFrame:
        """Filter, distinct, order, offset and limit."""
        df = self.filtered()
        compiler = Compiler(self.view.with_df(df))
        order = compiler.order(self.orders)
        if self.unique:
            rising = _rising(compiler, self.orders)
            if self.unique == "by":
                keys = [compiler._value_of(_order(k, False)) for k in self.unique_by]
            else:
                names = self._distinct_columns() if self.unique == "props" else [c for c in self._base_columns() if c != self.view.id]
                keys = [df[c] for c in names]
            df = _first_of(df, keys, order, rising, self._tie(df))
            compiler = Compiler(self.view.with_df(df))
            order = compiler.order(self.orders)
        if self.unique == "by":
            keys = [compiler._value_of(_order(k, False)) for k in self.unique_by]
            order = [*[k.asc_nulls_last() for k in keys], *order]
        if order:
            df = df.orderBy(*order)
        if self.offset:
            df = df.offset(self.offset)
        if self.limit is not None:
            df = df.limit(self.limit)
        return df

    def _base_columns(self) -> list[str]:
        known = set(self.view.base.values()) or set(BASE.values())
        return [c for c in self.view.df.columns if c in known]

    def _distinct_columns(self) -> list[str]:
        return [self.view.props] if self.view.props else self.view.property_names()

    def _tie(self, df: DataFrame) -> list[Column]:
        return [df[self.view.id]] if self.view.id in df.columns else []

    def select(self, *items: Any) -> Projected:
        return Projected(self, items)

    def group_by(self, *keys: Any) -> Grouped:
        return Grouped(self.view.with_df(self.filtered()), keys)

    def group_by_array(self, array: str, *keys: Any) -> ArrayGrouped:
        return ArrayGrouped(self.view.with_df(self.filtered()), array, keys)

    def with_window(self, spec: dict | None = None) -> Windowed:
        """Over the filtered rows, after take and skip; the query's order is not part of the window."""
        df = self.filtered()
        if self.offset or self.limit is not None:
            df = replace(self, unique=None).df()
        return Windowed(Compiler(self.view.with_df(df)), spec)

    # Terminals.

    def to_list(self) -> list[Row]:
        return self.df().collect()

    def count(self) -> int:
        return replace(self, orders=(), limit=None, offset=0).df().count()

    def first(self, condition: Any = None) -> Row | None:
        q = self.where(condition) if condition is not None else self
        return q.take(1).df().first()

    def any(self, condition: Any = None) -> bool:
        q = self.where(condition) if condition is not None else self
        return bool(q.filtered().limit(1).count())

    def all(self, condition: Any) -> bool:
        """Whether the condition is true, not just not false, for every row; true without rows."""
        df = self.filtered()
        holds = F.coalesce(Compiler(self.view.with_df(df)).filter(condition), F.lit(False))
        return not df.where(~holds).limit(1).count()

    def sum(self, value: Any) -> Any:
        return self._single("$sum", value) or 0

    def average(self, value: Any) -> Any:
        return self._single("$avg", value) or 0

    def min(self, value: Any) -> Any:
        return self._single("$min", value)

    def max(self, value: Any) -> Any:
        return self._single("$max", value)

    def _single(self, op: str, value: Any) -> Any:
        return self.aggregate({op: _operand(value), "alias": "x"}).first()["x"]

    def statistics(self, value: Any) -> DataFrame:
        """sum, average, min, max and count of one field, in a row."""
        v = _operand(value)
        names = {"sum": "$sum", "average": "$avg", "min": "$min", "max": "$max", "count": "$count"}
        return self.aggregate(*[{op: v, "alias": name} for name, op in names.items()])

    def aggregate(self, *aggregates: dict) -> DataFrame:
        df = self.filtered()
        return df.agg(*Compiler(self.view.with_df(df)).aggregates(aggregates))

    def remaining(self) -> DataFrame:
        """The objects that stay when the matching ones are deleted."""
        compiler = self.compiler()
        df = self.view.df
        matched = F.lit(True)
        for f in self.filters:
            matched = matched & compiler.filter(f)
        return df.where(~F.coalesce(matched, F.lit(False)))

    # Previews.

    def to_filter_json(self) -> str:
        trees = [tree_of(f) for f in self.filters]
        return json.dumps(trees[0] if len(trees) == 1 else {"$and": trees}, default=str)

    def explain(self, mode: str = "formatted") -> str:
        return explained(self.df(), mode)

    def explain_aggregate(self, *aggregates: dict, mode: str = "formatted") -> str:
        return explained(self.aggregate(*aggregates), mode)


def explained(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as text."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def _operand(value: Any) -> Any:
    return {"$field": value} if isinstance(value, str) else tree_of(value)


def _order(key: Any, desc: bool) -> Any:
    if isinstance(key, Column):
        return key.desc_nulls_first() if desc else key.asc_nulls_last()
    if isinstance(key, dict) and ("field" in key or "field_path" in key or "$expr" in key):
        return key
    entry = {"field": key} if isinstance(key, str) else {"$expr": tree_of(key)}
    return {**entry, "dir": "desc" if desc else "asc"}


def _rising(compiler: Compiler, orders: Sequence[Any]) -> list[Column] | None:
    """Columns that rise, with nulls where they belong, as the orders want it; None where that can't be said without a sort."""
    out: list[Column] = []
    for key in orders:
        if isinstance(key, Column):
            return None
        key = {"field": key} if isinstance(key, str) else key
        desc = str(key.get("dir", key.get("direction", "asc"))).lower() == "desc"
        last = str(key.get("nulls", "first" if desc else "last")).lower() == "last"
        c = compiler._value_of(key)
        kind = compiler.view.df.select(c.alias("x")).schema["x"].dataType
        out.append(c.isNull() if last else c.isNotNull())
        if not desc:
            out.append(c)
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            out.append(F.bitwise_not(c))
        elif isinstance(kind, T.TimestampType):
            out.append(F.bitwise_not(F.unix_micros(c)))
        elif isinstance(kind, T.DateType):
            out.append(F.bitwise_not(F.unix_date(c)))
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            out += [~F.isnan(c), -c]  # nothing is greater than NaN
        elif isinstance(kind, T.DecimalType):
            out.append(-c)
        else:
            return None
    return out


def _first_of(df: DataFrame, keys: list[Column], order: list[Column], rising: list[Column] | None, tie: list[Column]) -> DataFrame:
    """The first row of each key: by an aggregation, which is combined before the shuffle, or else by a sort of each key's rows."""
    if not order and not tie:
        return df.dropDuplicates()
    if rising is None:
        window = Window.partitionBy(*keys).orderBy(*order, *tie)
        return df.withColumn("_row", F.row_number().over(window)).where("_row = 1").drop("_row")
    place = F.struct(*[c.alias(f"p{k}") for k, c in enumerate([*rising, *tie])])
    best = df.groupBy(*[c.alias(f"_key_{k}") for k, c in enumerate(keys)]).agg(F.min_by(F.struct(*df.columns), place).alias("_first"))
    return best.select("_first.*")


@dataclass(frozen=True)
class Projected:
    """A projection; its own filters and order come after the source's take and skip."""

    source: Query
    items: tuple[Any, ...]
    filters: tuple[Any, ...] = ()
    orders: tuple[Any, ...] = ()
    unique: bool = False

    def where(self, condition: Any) -> Projected:
        return replace(self, filters=(*self.filters, condition))

    def order_by(self, key: Any, desc: bool = False) -> Projected:
        return replace(self, orders=(_order(key, desc),))

    def distinct(self) -> Projected:
        return replace(self, unique=True)

    def take(self, n: int) -> Projected:
        return replace(self, source=self.source.take(n))

    def skip(self, n: int) -> Projected:
        return replace(self, source=self.source.skip(n))

    def df(self) -> DataFrame:
        df = self.source.df()
        df = df.select(*Compiler(self.source.view.with_df(df)).projection(self.items))
        view = View(df, scheme="projection")
        for f in self.filters:
            df = df.where(Compiler(view.with_df(df)).filter(f))
        if self.unique:
            df = df.distinct()
        if self.orders:
            df = df.orderBy(*Compiler(View(df, scheme="projection")).order(self.orders))
        return df

    def count(self) -> int:
        return self.df().count() if self.filters or self.unique else self.source.count()

    def first(self) -> Row | None:
        return self.df().first()
