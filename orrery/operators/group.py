"""Grouping by properties or base columns, with having, order, paging and windows over groups."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import Compiler
from ..plans.nodes import Node, tree_of
from ..plans.paths import PathError, View, resolve
from .window import NTILE, Windowed

_AGGREGATES = {"$count", "$sum", "$avg", "$min", "$max", "$string_agg", "$bool_and", "$bool_or"}


def _key_name(key: Any, k: int) -> str:
    if isinstance(key, str):
        return key
    key = tree_of(key)
    return key.get("alias") or key.get("field") or key.get("$field") or f"_key_{k}"


@dataclass(frozen=True)
class Grouped:
    """Groups of a view; ``select`` gives keys and aggregates, one row a group."""

    view: View
    keys: tuple[Any, ...]
    conditions: tuple[Any, ...] = ()
    orders: tuple[Any, ...] = ()
    limit: int | None = None
    offset: int = 0

    def having(self, condition: Any) -> Grouped:
        """A condition on aggregates, such as ``{"$gt": [{"$count": "*"}, 5]}``; several are all required."""
        return replace(self, conditions=(*self.conditions, tree_of(condition)))

    def order(self, *keys: Any) -> Grouped:
        """By names of the result."""
        return replace(self, orders=keys)

    def take(self, n: int) -> Grouped:
        return replace(self, limit=n)

    def skip(self, n: int) -> Grouped:
        return replace(self, offset=n)

    def _columns(self, compiler: Compiler) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for k, key in enumerate(self.keys):
            name = _key_name(key, k)
            if name in out:
                raise ValueError(f"two keys named {name}")
            if isinstance(key, str):
                found = resolve(compiler.view, key)
                fields = getattr(found.type, "names", ())
                # A list item is grouped by its id.
                out[name] = found.column.getField("Id") if "Id" in fields and "Value" in fields else found.column
            else:
                key = {"$expr": key.tree} if isinstance(key, Node) else key
                out[name] = compiler._value_of(key) if "$expr" in key or "field" in key else compiler.scalar(key)
        return out

    def _prepared(self) -> tuple[View, Compiler]:
        return self.view, Compiler(self.view)

    def select(self, *aggregates: dict) -> DataFrame:
        view, compiler = self._prepared()
        keys = self._columns(compiler)
        if not keys and self.conditions:
            raise ValueError("having without keys")
        columns = compiler.aggregates(aggregates)
        hidden: list[Column] = []
        conditions = [_lift(c, lambda tree: _hide(tree, compiler, hidden)) for c in self.conditions]
        grouped = view.df.groupBy(*[c.alias(n) for n, c in keys.items()])
        if not columns and not hidden:
            out = grouped.agg(F.count(F.lit(1)).alias("_n")).drop("_n")
        else:
            out = grouped.agg(*columns, *hidden)
        for c in conditions:
            out = out.where(Compiler(View(out, scheme="groups")).boolean(c))
        out = out.drop(*[f"_having_{k}" for k in range(len(hidden))])
        if self.orders:
            out = out.orderBy(*Compiler(View(out, scheme="groups")).order(self.orders))
        if self.offset:
            out = out.offset(self.offset)
        return out if self.limit is None else out.limit(self.limit)

    def count(self) -> int:
        """The number of groups."""
        return replace(self, orders=(), limit=None, offset=0).select().count()

    def with_window(self, spec: dict, *aggregates: dict) -> Windowed:
        """Windows over the grouped rows, by keys or aggregates; without frames."""
        if "frame" in spec:
            raise ValueError("windows over groups take no frame")
        out = self.select(*aggregates)
        return Windowed(Compiler(View(out, scheme="groups")), {**spec, "args": [NTILE]} if spec.get("func") == "ntile" and "args" not in spec else spec)


def _lift(tree: Any, hide: Callable[[dict], dict]) -> Any:
    """The condition with its aggregates replaced."""
    if isinstance(tree, dict):
        name = next((k for k in tree if k.startswith("$")), None)
        if name and name.lower() in _AGGREGATES and not (name.lower() in ("$min", "$max") and isinstance(tree[name], list)):
            return hide(tree)
        return {k: _lift(v, hide) for k, v in tree.items()}
    if isinstance(tree, (list, tuple)):
        return [_lift(x, hide) for x in tree]
    return tree_of(tree) if isinstance(tree, Node) else tree


def _hide(tree: dict, compiler: Compiler, hidden: list[Column]) -> dict:
    name = f"_having_{len(hidden)}"
    hidden.append(compiler.aggregate(tree).alias(name))
    return {"$field": name}


@dataclass(frozen=True)
class ArrayGrouped(Grouped):
    """Groups of the elements of an array of structs; keys and aggregates are the element's fields."""

    array: str = ""

    def __init__(self, view: View, array: str, keys: tuple[Any, ...] = (), **rest: Any) -> None:
        super().__init__(view, keys, **rest)
        object.__setattr__(self, "array", array)

    def _prepared(self) -> tuple[View, Compiler]:
        found = resolve(self.view, self.array)
        if not found.is_array:
            raise PathError(f"{self.array} is no array")
        elements = self.view.df.select(F.explode(found.column).alias("element"))
        view = View(elements, base={}, props="element", scheme=self.array)
        return view, Compiler(view)

    def having(self, condition: Any) -> ArrayGrouped:
        return ArrayGrouped(self.view, self.array, self.keys, conditions=(*self.conditions, tree_of(condition)), orders=self.orders, limit=self.limit, offset=self.offset)

    def order(self, *keys: Any) -> ArrayGrouped:
        return ArrayGrouped(self.view, self.array, self.keys, conditions=self.conditions, orders=keys, limit=self.limit, offset=self.offset)

    def take(self, n: int) -> ArrayGrouped:
        return ArrayGrouped(self.view, self.array, self.keys, conditions=self.conditions, orders=self.orders, limit=n, offset=self.offset)

    def skip(self, n: int) -> ArrayGrouped:
        return ArrayGrouped(self.view, self.array, self.keys, conditions=self.conditions, orders=self.orders, limit=self.limit, offset=n)

    def with_window(self, spec: dict, *aggregates: dict) -> Windowed:
        raise NotImplementedError("windows over groups of array elements")
