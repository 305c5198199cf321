"""Filters and expression trees to Spark columns; one dispatch for each family of operators.

Everything compiles to a ``Column``, so Catalyst sees plain predicates: it pushes them to the
scan, prunes columns and folds constants.  Unknown operators raise ``ValueError``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar, text_search
from .nodes import Node, tree_of
from .paths import PathError, Resolved, View, encode_key, literal, resolve

_COMPARE: dict[str, Callable[[Any, Any], Column]] = {
    "$eq": lambda a, b: a == b,
    "$ne": lambda a, b: a != b,
    "$gt": lambda a, b: a > b,
    "$gte": lambda a, b: a >= b,
    "$lt": lambda a, b: a < b,
    "$lte": lambda a, b: a <= b,
}
_TEXT: dict[str, Callable[[Column, Any], Column]] = {
    "$like": lambda a, b: F.like(a, b),
    "$ilike": lambda a, b: F.ilike(a, b),
    "$startswith": lambda a, b: F.startswith(a, b),
    "$endswith": lambda a, b: F.endswith(a, b),
    "$contains": lambda a, b: F.contains(a, b),
    "$startswithignorecase": lambda a, b: F.startswith(F.lower(a), F.lower(b)),
    "$endswithignorecase": lambda a, b: F.endswith(F.lower(a), F.lower(b)),
    "$containsignorecase": lambda a, b: F.contains(F.lower(a), F.lower(b)),
    "$regex": lambda a, b: F.rlike(a, b),
    "$iregex": lambda a, b: F.rlike(a, F.concat(F.lit("(?i)"), b)),
    "$notregex": lambda a, b: ~F.rlike(a, b),
    "$inotregex": lambda a, b: ~F.rlike(a, F.concat(F.lit("(?i)"), b)),
}
#: Comparisons as floating-point numbers, whatever the field's type.
_DOUBLES = {"$gtdouble": "$gt", "$gtedouble": "$gte", "$ltdouble": "$lt", "$ltedouble": "$lte"}
_SIZES = {"": "$eq", "gt": "$gt", "gte": "$gte", "lt": "$lt", "lte": "$lte"}
_NULLS = {"$null": True, "$isnull": True, "$notnull": False, "$exists": False}
_AGGREGATES = ("$count", "$sum", "$avg", "$min", "$max", "$string_agg", "$bool_and", "$bool_or")


def _one(tree: dict) -> tuple[str, Any]:
    keys = [k for k in tree if k.startswith("$")]
    if len(keys) != 1:
        raise ValueError(f"expected one operator, found {sorted(tree)}")
    return keys[0].lower(), tree[keys[0]]


def _unknown() -> Column:
    return F.lit(None).cast("boolean")


class Compiler:
    """Over one view.  ``extra`` compiles further filter operators (of trees, for example)."""

    def __init__(self, view: View, extra: dict[str, Callable[[Any], Column]] | None = None) -> None:
        self.view, self.extra = view, extra or {}

    # Filters: {field: condition}, connectives, and expressions.

    def filter(self, tree: Any) -> Column:
        """A filter; an empty one is true, several keys are all required."""
        tree = tree_of(tree)
        if isinstance(tree, Column):
            return tree
        if not tree:
            return F.lit(True)
        if not isinstance(tree, dict):
            raise ValueError(f"not a filter: {tree!r}")
        out = None
        for key, value in tree.items():
            c = self._filter_key(key, value)
            out = c if out is None else out & c
        return out

    def _filter_key(self, key: str, value: Any) -> Column:
        low = key.lower()
        if low == "$and":
            return _all(self.filter(x) for x in value)
        if low == "$or":
            return _any(self.filter(x) for x in value)
        if low == "$not":
            return ~self.filter(value)
        if low == "$expr":
            return self.boolean(value)
        if low in self.extra:
            return self.extra[low](value)
        if key.startswith("$"):
            return self.boolean({key: value})
        if low.endswith(".containskey"):
            return self.map_value(key[: -len(".containskey")], value).isNotNull()
        return self.leaf(resolve(self.view, key), value)

    def map_value(self, path: str, key: Any) -> Column:
        found = resolve(self.view, path)
        if not isinstance(found.type, T.MapType):
            raise PathError(f"{path} is no map")
        return F.try_element_at(found.column, F.lit(encode_key(key)).cast(found.type.keyType))

    def leaf(self, found: Resolved, condition: Any) -> Column:
        if not isinstance(condition, dict):
            condition = {"$eq": condition}
        if not condition:
            raise ValueError("empty condition")
        return _all(self._condition(found, op.lower(), value) for op, value in condition.items())

    def _condition(self, found: Resolved, op: str, value: Any) -> Column:
        if op in _NULLS:
            return found.column.isNull() if _NULLS[op] == bool(value) else found.column.isNotNull()
        if found.each:
            # Any element for which the condition on its field holds.
            inner = found.type.elementType
            return F.coalesce(F.exists(found.column, lambda x: self._condition(Resolved(found.each(x), inner), op, value)), F.lit(False))
        if op == "$not":
            return ~self.leaf(found, value)
        column, kind = found.column, found.type
        if isinstance(kind, T.StructType) and "Id" in kind.names and "Value" in kind.names:
            column, kind = column.getField("Id"), kind["Id"].dataType  # a list item stands for its id
        if op.startswith("$array") or isinstance(kind, T.ArrayType) and op in ("$eq", "$ne", "$in", "$nin"):
            return self._array(column, kind, op, value)
        if op in _COMPARE:
            if value is None:
                return {"$eq": column.isNull, "$ne": column.isNotNull}.get(op, _unknown)()
            return _COMPARE[op](column, literal(value, kind))
        if op in ("$in", "$nin"):
            hit = column.isin([literal(v, kind) for v in value]) if value else F.lit(False)
            return hit if op == "$in" else ~hit
        if op == "$between":
            return column.between(literal(value[0], kind), literal(value[1], kind))
        if op in _DOUBLES:
            return _COMPARE[_DOUBLES[op]](column.try_cast("double"), F.lit(float(value)))
        if op in _TEXT:
            return _TEXT[op](column, F.lit(value))
        if op == "$fts":
            query, language = (value["query"], value.get("language")) if isinstance(value, dict) else (value, None)
            return text_search.matches([column], query, language)
        raise ValueError(f"unknown operator {op}")

    def _array(self, column: Column, kind: T.DataType, op: str, value: Any) -> Column:
        if not isinstance(kind, T.ArrayType):
            raise ValueError(f"{op} of something that is no array")
        item = kind.elementType
        lit = lambda v: literal(v, item).cast(item) if not isinstance(item, T.DecimalType) else literal(v, item)
        size = F.coalesce(F.size(column), F.lit(0))
        first, last = F.get(column, F.lit(0)), F.try_element_at(column, F.lit(-1))
        if op in ("$eq", "$arraycontains"):
            return F.array_contains(column, lit(value))
        if op == "$ne":
            return column.isNull() | ~F.array_contains(column, lit(value))
        if op in ("$in", "$nin"):
            hit = F.arrays_overlap(column, F.array(*[lit(v) for v in value])) if value else F.lit(False)
            return hit if op == "$in" else column.isNull() | ~hit
        if op == "$arrayany":
            return (size > 0) if value else (size == 0)
        if op == "$arrayempty":
            return (size == 0) if value else (size > 0)
        if op.startswith("$arraycount") and op[len("$arraycount") :] in _SIZES:
            return _COMPARE[_SIZES[op[len("$arraycount") :]]](size, F.lit(value))
        if op == "$arrayat":
            return F.get(column, F.lit(int(value["index"]))) == lit(value["value"])
        if op == "$arrayfirst":
            return first == lit(value)
        if op == "$arraylast":
            return last == lit(value)
        if op == "$arraystartswith":
            return F.startswith(first, F.lit(value))
        if op == "$arrayendswith":
            return F.endswith(last, F.lit(value))
        if op == "$arraymatches":
            return F.exists(column, lambda x: F.like(x, F.lit(value)))
        if op in ("$arraysum", "$arrayavg", "$arraymin", "$arraymax"):
            return array_aggregate(column, item, op[len("$array") :]) == literal(value)
        raise ValueError(f"unknown operator {op}")

    # Expressions.

    def boolean(self, tree: Any) -> Column:
        """An expression that is true, false or unknown; comparing with null is unknown here."""
        tree = tree_of(tree)
        if isinstance(tree, Column):
            return tree
        if isinstance(tree, bool):
            return F.lit(tree)
        if not isinstance(tree, dict):
            raise ValueError(f"not a condition: {tree!r}")
        op, args = _one(tree)
        if op in ("$and", "$or"):
            if not args:
                raise ValueError(f"empty {op}")
            return (_all if op == "$and" else _any)(self.boolean(x) for x in args)
        if op == "$not":
            return ~self.boolean(args)
        if op in _NULLS:
            c = self.scalar(args)
            return c.isNull() if _NULLS[op] else c.isNotNull()
        if op in _COMPARE:
            a, b = self._pair(args)
            return _COMPARE[op](a, b)
        if op in ("$in", "$nin"):
            c, kind = self.typed(args[0])
            hit = c.isin([literal(tree_of(v), kind) for v in args[1]]) if args[1] else F.lit(False)
            return hit if op == "$in" else ~hit
        if op == "$between":
            c, kind = self.typed(args[0])
            return c.between(self.scalar(args[1], kind), self.scalar(args[2], kind))
        if op in _TEXT:
            return _TEXT[op](self.scalar(args[0]), self.scalar(args[1]))
        if op == "$fts":
            language = None
            if isinstance(args, dict):
                query, fields, language = args["query"], args["fields"], args.get("language")
            else:
                query, *fields = args
            return text_search.matches([self.scalar(f if isinstance(f, (dict, Node)) else {"$field": f}) for f in fields], query, language)
        if op in self.extra:
            return self.extra[op](args)
        return self.scalar(tree)

    def _pair(self, args: Sequence[Any]) -> tuple[Column, Column]:
        a, b = args
        if _is_constant(b):
            left, kind = self.typed(a)
            return left, self.scalar(b, kind)
        if _is_constant(a):
            right, kind = self.typed(b)
            return self.scalar(a, kind), right
        return self.scalar(a), self.scalar(b)

    def typed(self, tree: Any) -> scalar.Typed:
        tree = tree_of(tree)
        if isinstance(tree, dict) and len(tree) == 1 and "$field" in tree:
            found = resolve(self.view, tree["$field"])
            return found.column, found.type
        c = self.scalar(tree)
        return c, self.view.df.select(c.alias("x")).schema["x"].dataType

    def scalar(self, tree: Any, kind: T.DataType | None = None) -> Column:
        """A value; kind: what a constant is compared with."""
        tree = tree_of(tree)
        if isinstance(tree, Column):
            return tree
        if not isinstance(tree, dict):
            return literal(tree, kind)
        op, args = _one(tree)
        if op == "$field":
            found = resolve(self.view, args)
            if found.each:
                return F.transform(found.column, found.each)
            return found.column
        if op == "$const":
            return literal(args, kind)
        if op == "$over":
            return self.over(args)
        if op in ("$min", "$max") and isinstance(args, (list, tuple)):
            pick = F.least if op == "$min" else F.greatest
            return pick(*map(self.scalar, args)) if len(args) > 1 else self.scalar(args[0])
        if op in _AGGREGATES:
            return self.aggregate(tree)
        if op == "$if":
            c = F.when(self.boolean(args[0]), self.scalar(args[1]))
            return c.otherwise(self.scalar(args[2]) if len(args) > 2 and args[2] is not None else F.lit(None))
        if op == "$case":
            return self._case(args)
        items = list(args) if isinstance(args, (list, tuple)) else [args]
        if op == "$div":
            if len(items) != 2:
                raise ValueError("$div takes two arguments")
            return scalar.divide(self.typed(items[0]), self.typed(items[1]))
        if op == "$round":
            return F.round(self.scalar(items[0]), int(tree_of(items[1]))) if len(items) > 1 else F.round(self.scalar(items[0]))
        if op in ("$dateadd", "$datesub"):
            n = self.scalar(items[2])
            return scalar.date_add(items[0], self.scalar(items[1]), n if op == "$dateadd" else -n)
        if op == "$datediff":
            stamp = T.TimestampType()
            return scalar.date_diff(items[0], self.scalar(items[1], stamp), self.scalar(items[2], stamp))
        if op == "$datetrunc":
            return scalar.date_trunc(items[0], self.scalar(items[1], T.TimestampType()))
        if op == "$cast":
            return scalar.cast(self.typed(items[1]), str(items[0]))
        if op == "$regexreplace":
            return scalar.regex_replace(self.scalar(items[0]), *[str(tree_of(x)) for x in items[1:]])
        if op in scalar.PLAIN:
            function, counts = scalar.PLAIN[op]
            items = [] if counts == (0,) else items
            if counts is not None and len(items) not in counts or counts is None and not items:
                raise ValueError(f"{op} takes {counts or 'some'} arguments, not {len(items)}")
            return function(*map(self.scalar, items))
        if op in _COMPARE or op in _TEXT or op in _NULLS or op in ("$and", "$or", "$not", "$in", "$nin", "$between", "$fts"):
            return self.boolean(tree)
        if op in self.extra:
            return self.extra[op](args)
        raise ValueError(f"unknown function {op}")

    def _case(self, branches: Sequence[dict]) -> Column:
        ends = [b for b in branches if "else" in b]
        if len(ends) > 1:
            raise ValueError("two else branches")
        out = None
        for b in branches:
            if "else" not in b:
                condition, value = self.boolean(b["when"]), self.scalar(b["then"])
                out = F.when(condition, value) if out is None else out.when(condition, value)
        other = self.scalar(ends[0]["else"]) if ends else F.lit(None)
        return other if out is None else out.otherwise(other)

    # Aggregates.

    def aggregate(self, tree: Any) -> Column:
        """``{"$sum": expression, "distinct": bool, "filter": condition}``; over an array, of all elements."""
        tree = tree_of(tree)
        op, args = _one(tree)
        distinct, only = bool(tree.get("distinct")), tree.get("filter")
        keep = (lambda c: F.when(self.boolean(only) if _is_expression(only) else self.filter(only), c)) if only is not None else (lambda c: c)
        if op == "$count" and args == "*":
            if distinct:
                raise ValueError("distinct count of *")
            return F.count(keep(F.lit(1)))
        if op == "$string_agg":
            value, separator = args
            c = keep(self.scalar(value).cast("string"))
            return (F.listagg_distinct if distinct else F.listagg)(c, F.lit(tree_of(separator)))
        if op in ("$bool_and", "$bool_or"):
            return (F.bool_and if op == "$bool_and" else F.bool_or)(keep(self.boolean(args) if _is_expression(args) else self.scalar(args)))
        if op not in _AGGREGATES:
            raise ValueError(f"unknown aggregate {op}")
        if isinstance(args, str):
            args = {"$field": args}
        c, kind = self.typed(args)
        if isinstance(kind, T.ArrayType):
            if distinct:
                raise ValueError("distinct aggregate over an array")
            return self._array_aggregate(op, keep(c), kind.elementType)
        c = keep(c)
        if op == "$count":
            return F.count_distinct(c) if distinct else F.count(c)
        if op == "$sum":
            return F.sum_distinct(c) if distinct else F.sum(c)
        if op == "$avg":
            return F.call_function("avg", c) if not distinct else F.sum_distinct(c) / F.count_distinct(c)
        return (F.min if op == "$min" else F.max)(c)

    def _array_aggregate(self, op: str, c: Column, item: T.DataType) -> Column:
        if op == "$count":
            return F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long")
        if op == "$min":
            return F.min(F.array_min(c))
        if op == "$max":
            return F.max(F.array_max(c))
        total = F.sum(array_aggregate(c, item, "sum"))
        if op == "$sum":
            return total
        present = F.size(F.filter(c, lambda x: x.isNotNull()))
        return total / F.nullif(F.sum(present), F.lit(0))

    def aggregates(self, trees: Iterable[dict]) -> list[Column]:
        out, names = [], set()
        for k, tree in enumerate(trees):
            tree = tree_of(tree)
            name = tree.get("alias", f"_agg_{k}")
            if name in names:
                raise ValueError(f"two results named {name}")
            names.add(name)
            out.append(self.aggregate(tree).alias(name))
        return out

    # Order, projection and windows.

    def order(self, keys: Iterable[Any]) -> list[Column]:
        """``{"field" | "field_path" | "$expr": …, "dir": …, "nulls": …}``; by default nulls are last ascending and first descending."""
        out = []
        for key in keys:
            if isinstance(key, Column):
                out.append(key)
                continue
            key = {"field": key} if isinstance(key, str) else {"$expr": key.tree} if isinstance(key, Node) else key
            direction = str(key.get("dir", key.get("direction", "asc"))).lower()
            if direction not in ("asc", "desc"):
                raise ValueError(f"unknown direction {direction}")
            nulls = str(key.get("nulls", "last" if direction == "asc" else "first")).lower()
            out.append(getattr(self._value_of(key), f"{direction}_nulls_{nulls}")())
        return out

    def _value_of(self, key: dict) -> Column:
        if "$expr" in key:
            return self.scalar(key["$expr"])
        path = key.get("field", key.get("field_path"))
        if path is None:
            raise ValueError(f"neither field nor expression in {key}")
        return self.scalar({"$field": path})

    def projection(self, items: Iterable[Any]) -> list[Column]:
        out, names = [], set()
        for k, item in enumerate(items):
            if isinstance(item, Column):
                out.append(item)
                continue
            item = {"field": item, "alias": item} if isinstance(item, str) else {"$expr": item.tree} if isinstance(item, Node) else item
            name = item.get("alias", f"_proj_{k}")
            if name in names:
                raise ValueError(f"two results named {name}")
            names.add(name)
            out.append(self._value_of(item).alias(name))
        return out

    def over(self, tree: dict) -> Column:
        from ..operators.window import compile_window

        return compile_window(self, tree)


def array_aggregate(column: Column, item: T.DataType, op: str) -> Column:
    """sum, avg, min or max of one array's elements, nulls left out; null if there are none."""
    if op == "min":
        return F.array_min(column)
    if op == "max":
        return F.array_max(column)
    present = F.filter(column, lambda x: x.isNotNull())
    wide = "long" if isinstance(item, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else item.simpleString() if isinstance(item, T.DecimalType) else "double"
    total = F.aggregate(present, F.lit(0).cast(wide), lambda a, x: (a + x).cast(wide))
    n = F.size(present)
    return F.when(n > 0, total if op == "sum" else total / n)


def _is_constant(tree: Any) -> bool:
    tree = tree_of(tree)
    return not isinstance(tree, (dict, Column)) or (isinstance(tree, dict) and list(tree) == ["$const"])


def _is_expression(tree: Any) -> bool:
    tree = tree_of(tree)
    return isinstance(tree, Column) or (isinstance(tree, dict) and any(k.startswith("$") for k in tree))


def _all(parts: Iterable[Column]) -> Column:
    out = None
    for p in parts:
        out = p if out is None else out & p
    return F.lit(True) if out is None else out


def _any(parts: Iterable[Column]) -> Column:
    out = None
    for p in parts:
        out = p if out is None else out | p
    return F.lit(False) if out is None else out

