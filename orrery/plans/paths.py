"""Field paths over an object view.

An object has base columns (id, parent, scheme, name and so on) and properties.  ``0$:Name``
or ``_name`` addresses a base column; anything else a property: ``A.B`` a nested one,
``Map[key]`` a map's value, ``Arr[2]`` an element (from 0), ``Arr[].F`` every element's field,
and a last ``.$length`` or ``.$count`` the length of a string or number of elements.
"""

from __future__ import annotations

import base64
import datetime
import decimal
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Base columns of an object, by their names in paths.
BASE = {
    "id": "id", "parentid": "parent_id", "schemeid": "scheme_id", "ownerid": "owner_id", "whochangeid": "who_change_id",
    "datecreate": "date_create", "datemodify": "date_modify", "datebegin": "date_begin", "datecomplete": "date_complete",
    "key": "key", "name": "name", "note": "note", "hash": "hash", "valuelong": "value_long", "valuestring": "value_string",
    "valueguid": "value_guid", "valuebool": "value_bool", "valuedouble": "value_double", "valuenumeric": "value_numeric",
    "valuedatetime": "value_datetime", "valuebytes": "value_bytes",
}


class PathError(ValueError):
    """A path that the schema doesn't have."""


@dataclass(frozen=True)
class View:
    """Objects as a DataFrame.

    base: base column names to columns of ``df``.  props: the struct column of the properties,
    or None if they are columns of their own.  scheme: a name, for messages.
    """

    df: DataFrame
    base: dict[str, str] = field(default_factory=dict)
    props: str | None = None
    scheme: str = "objects"

    @property
    def id(self) -> str:
        return self.base.get("id", "id")

    @property
    def parent(self) -> str:
        return self.base.get("parent_id", "parent_id")

    def with_df(self, df: DataFrame) -> View:
        return View(df, self.base, self.props, self.scheme)

    def property_names(self) -> list[str]:
        if self.props:
            return self.df.schema[self.props].dataType.names
        own = set(self.base.values())
        return [c for c in self.df.columns if c not in own]


@dataclass(frozen=True)
class Resolved:
    """A column of a type; for ``Arr[].F`` the array and what to take of each element."""

    column: Column
    type: T.DataType
    each: Callable[[Column], Column] | None = None

    @property
    def is_array(self) -> bool:
        return isinstance(self.type, T.ArrayType)


_STEP = re.compile(r"([^.\[\]]+)|\[([^\]]*)\]")


def encode_key(key: Any) -> str:
    """A map key as text: composite ones are Base64 of their JSON."""
    if isinstance(key, bool):
        return "true" if key else "false"
    if isinstance(key, (str, int)):
        return str(key)
    if isinstance(key, float):
        return repr(key)
    if isinstance(key, (datetime.datetime, datetime.date)):
        return key.isoformat()
    return base64.b64encode(json.dumps(key, separators=(",", ":")).encode()).decode()


def _child(column: Column, kind: T.DataType, name: str, path: str) -> tuple[Column, T.DataType]:
    if not isinstance(kind, T.StructType):
        raise PathError(f"{path}: {name} of something that has no fields")
    for f in kind.fields:
        if f.name.lower() == name.lower():
            return column.getField(f.name), f.dataType
    raise PathError(f"{path}: field {name} not found")


def resolve(view: View, path: str) -> Resolved:
    size = None
    for suffix in (".$length", ".$count"):
        if path.endswith(suffix):
            path, size = path[: -len(suffix)], suffix
    found = _resolve(view, path)
    if not size:
        return found
    if found.is_array or isinstance(found.type, T.MapType):
        return Resolved(F.coalesce(F.size(found.column), F.lit(0)), T.IntegerType())
    return Resolved(F.coalesce(F.length(found.column), F.lit(0)), T.IntegerType())


def _resolve(view: View, path: str) -> Resolved:
    schema = view.df.schema
    name = None
    if path.startswith("0$:"):
        name = path[3:].lower().replace("_", "")
    elif path.startswith("_") and path.lower().replace("_", "") in BASE:
        name = path.lower().replace("_", "")
    if name is not None:
        column = view.base.get(BASE.get(name, ""), BASE.get(name, ""))
        if column not in schema.names:
            raise PathError(f"{path}: no such base column")
        return Resolved(view.df[column], schema[column].dataType)

    steps = _STEP.findall(path)
    if not steps or "".join(a or f"[{b}]" for a, b in steps) != path.replace(".", ""):
        raise PathError(f"{path}: not a path")
    root = steps[0][0]
    if view.props:
        column, kind = _child(view.df[view.props], schema[view.props].dataType, root, path)
    else:
        # Base columns may also be named as they are, where no property has the name.
        names = {c.lower(): c for c in schema.names} | {c.lower(): c for c in view.property_names()}
        if root.lower() not in names:
            raise PathError(f"{path}: field {root} not found in {view.scheme}")
        column, kind = view.df[names[root.lower()]], schema[names[root.lower()]].dataType

    for k, (child, key) in enumerate(steps[1:], 1):
        if child:
            column, kind = _child(column, kind, child, path)
        elif isinstance(kind, T.MapType):
            column, kind = F.try_element_at(column, F.lit(key).cast(kind.keyType)), kind.valueType
        elif isinstance(kind, T.ArrayType) and key == "":
            rest = [c for c, _ in steps[k + 1 :]]
            if not all(rest):
                raise PathError(f"{path}: only fields may follow []")
            inner = kind.elementType
            for r in rest:
                _, inner = _child(F.lit(None), inner, r, path)

            def each(x: Column, rest: list[str] = rest) -> Column:
                for r in rest:
                    x = x.getField(r)
                return x

            return Resolved(column, T.ArrayType(inner), each if rest else None)
        elif isinstance(kind, T.ArrayType):
            column, kind = F.get(column, F.lit(int(key))), kind.elementType
        else:
            raise PathError(f"{path}: [{key}] of something that is neither map nor array")
    return Resolved(column, kind)


def literal(value: Any, kind: T.DataType | None = None) -> Column:
    """A constant; texts become the dates, times and decimals that they are compared with."""
    if isinstance(value, (list, tuple, dict)):
        raise ValueError(f"not a constant: {value!r}")
    if isinstance(value, str) and isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit(value).cast(kind)
    if isinstance(value, float) and isinstance(kind, T.DecimalType):
        return F.lit(decimal.Decimal(repr(value)))
    return F.lit(value)
