"""Window functions with frames, also those that Spark has no syntax for.

A tree is ``{"func": name, "args": [...], "partition_by": [...], "order_by": [...], "frame":
{...}, "filter": {...}}``.  A frame has ``mode`` (rows, range, groups), ``start``, ``end``
(``{"unbounded": "preceding"}``, ``{"preceding": n}``, ``"current"`` and so on; a missing end is
the current row) and ``exclude`` (no_others, current_row, group, ties).

Emulations: a filter is a ``when`` inside the aggregate; a GROUPS frame is a RANGE frame over
the dense rank of the order; an exclusion divides the frame in two around what goes, or subtracts
that from sums and counts.  Only ``min`` and ``max`` over RANGE frames, or over ROWS frames without
the row's group, take the frame's elements as an array, so these should be narrow.  Ranking without
an order goes by the id.  Partitions are as large as their keys are frequent: Spark sorts a partition
in one task, spilling to disk.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

RANKING = {"row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile"}
AGGREGATES = {"sum", "avg", "min", "max", "count"}
VALUES = {"lag", "lead", "first_value", "last_value", "nth_value"}
NTILE = 4


def bound(x: Any, default: str) -> int:
    """A frame's end as Spark counts it."""
    if x is None:
        x = default
    if x in ("current", "current_row"):
        return Window.currentRow
    if isinstance(x, dict):
        kind, n = next(iter(x.items()))
        kind = kind.lower()
        if kind == "unbounded":
            return Window.unboundedPreceding if str(n).lower() == "preceding" else Window.unboundedFollowing
        if kind in ("preceding", "following"):
            return -int(n) if kind == "preceding" else int(n)
    if x == "unbounded_preceding":
        return Window.unboundedPreceding
    if x == "unbounded_following":
        return Window.unboundedFollowing
    raise ValueError(f"unknown frame end {x!r}")


class Frame:
    """Frames by chaining: ``Frame.rows().preceding(2).and_current_row()``."""

    def __init__(self, mode: str) -> None:
        self.tree: dict[str, Any] = {"mode": mode}

    @classmethod
    def rows(cls, n: int | None = None) -> Frame:
        return cls("rows") if n is None else cls("rows").preceding(n)

    @classmethod
    def range(cls) -> Frame:
        return cls("range")

    @classmethod
    def groups(cls) -> Frame:
        return cls("groups")

    def _set(self, key: str, value: Any) -> Frame:
        self.tree[key] = value
        return self

    def preceding(self, n: int) -> Frame:
        return self._set("start", {"preceding": n})

    def unbounded_preceding(self) -> Frame:
        return self._set("start", {"unbounded": "preceding"})

    def and_current_row(self) -> Frame:
        return self._set("end", "current")

    def and_following(self, n: int) -> Frame:
        return self._set("end", {"following": n})

    def and_unbounded_following(self) -> Frame:
        return self._set("end", {"unbounded": "following"})

    def exclude(self, what: str) -> Frame:
        return self._set("exclude", what)


def spec_of(compiler, tree: dict) -> tuple[WindowSpec, list[Column], list[Column]]:
    """The window without a frame, its partition and its order."""
    parts = [compiler.scalar({"$field": p} if isinstance(p, str) else p) for p in tree.get("partition_by", ())]
    order = compiler.order(tree.get("order_by", ()))
    if not order and (tree["func"] in RANKING or tree["func"] in VALUES):
        names = compiler.view.df.columns
        order = [compiler.view.df[compiler.view.id]] if compiler.view.id in names else [F.lit(1)]
    spec = Window.partitionBy(*parts)
    return (spec.orderBy(*order) if order else spec), parts, order


def compile_window(compiler, tree: dict) -> Column:
    name = tree["func"].lower()
    args = list(tree.get("args", ()))
    spec, _, order = spec_of(compiler, tree)
    frame = tree.get("frame")
    frame = frame.tree if isinstance(frame, Frame) else frame
    if frame and (frame["mode"].lower() == "groups" or frame.get("exclude", "no_others") != "no_others"):
        raise ValueError("GROUPS and EXCLUDE need helper columns; use Windowed")
    if frame:
        spec = framed(spec, frame)
    return function(compiler, name, args, tree.get("filter")).over(spec)


def framed(spec: WindowSpec, frame: dict) -> WindowSpec:
    start, end = bound(frame.get("start"), "unbounded_preceding"), bound(frame.get("end"), "current")
    return spec.rowsBetween(start, end) if frame["mode"].lower() == "rows" else spec.rangeBetween(start, end)


def function(compiler, name: str, args: list, only: Any = None) -> Column:
    """The function to be used over a window."""
    if name in ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist"):
        return getattr(F, name)()
    if name == "ntile":
        return F.ntile(int(args[0]) if args else NTILE)
    if not args:
        raise ValueError(f"{name} takes arguments")
    if name == "count" and args[0] == "*":
        value = F.lit(1)
    else:
        value = compiler.scalar({"$field": args[0]} if isinstance(args[0], str) else args[0])
    if only is not None:
        if name not in AGGREGATES:
            raise ValueError(f"{name} takes no filter")
        value = F.when(compiler.filter(only), value)
    if name in AGGREGATES:
        return getattr(F, name)(value)
    if name in ("lag", "lead"):
        return getattr(F, name)(value, int(args[1]) if len(args) > 1 else 1, args[2] if len(args) > 2 else None)
    if name == "first_value":
        return F.first_value(value)
    if name == "last_value":
        return F.last_value(value)
    if name == "nth_value":
        return F.nth_value(value, int(args[1]))
    raise ValueError(f"unknown window function {name}")


class Windowed:
    """A view with window columns; ``select`` returns plain fields and ``{"alias", "func", …}`` trees."""

    def __init__(self, compiler, spec: dict | None = None) -> None:
        self.compiler, self.spec = compiler, spec or {}

    def select(self, *items: Any) -> DataFrame:
        compiler = self.compiler
        df, out, helpers = compiler.view.df, [], []
        for k, item in enumerate(items):
            if isinstance(item, dict) and "func" in item:
                tree = {**self.spec, **item}
                alias = item.get("alias", f"_win_{k}")
                frame = tree.get("frame")
                frame = frame.tree if isinstance(frame, Frame) else frame
                if frame and (frame["mode"].lower() == "groups" or frame.get("exclude", "no_others") != "no_others"):
                    df, column = _emulated(compiler, df, tree, frame, f"_w{k}")
                    helpers.append(column)
                    out.append(column.alias(alias))
                else:
                    out.append(compile_window(compiler, tree).alias(alias))
            else:
                out += compiler.projection([item])
        return df.select(*out)


def _emulated(compiler, df: DataFrame, tree: dict, frame: dict, prefix: str) -> tuple[DataFrame, Column]:
    """Adds the columns that a GROUPS frame or an exclusion needs; the result over them."""
    spec, parts, order = spec_of(compiler, tree)
    if not order:
        raise ValueError("GROUPS and EXCLUDE need an order")
    name, args = tree["func"].lower(), list(tree.get("args", ()))
    place, group = f"{prefix}_place", f"{prefix}_group"
    stable = spec.orderBy(*order, df[compiler.view.id]) if compiler.view.id in df.columns else spec
    df = df.withColumns({group: F.dense_rank().over(spec), place: F.row_number().over(stable)})
    mode, exclude = frame["mode"].lower(), frame.get("exclude", "no_others").lower()
    window = Window.partitionBy(*parts)
    start, end = bound(frame.get("start"), "unbounded_preceding"), bound(frame.get("end"), "current")
    if mode == "groups":
        window = window.orderBy(F.col(group)).rangeBetween(start, end)
    elif mode == "rows":
        window = window.orderBy(F.col(place)).rowsBetween(start, end)
    else:
        window = framed(spec, frame)
    if exclude == "no_others":
        return df, function(compiler, name, args, tree.get("filter")).over(window)
    if name not in AGGREGATES:
        raise ValueError(f"{name} takes no exclusion here")
    value = F.lit(1) if args[0] == "*" else compiler.scalar({"$field": args[0]} if isinstance(args[0], str) else args[0])
    if tree.get("filter") is not None:
        value = F.when(compiler.filter(tree["filter"]), value)
    if exclude not in ("current_row", "group", "ties"):
        raise ValueError(f"unknown exclusion {exclude}")
    peers = Window.partitionBy(*parts, F.col(group))
    around = start <= 0 <= end
    kept: list[WindowSpec] | None = None  # frames whose rows together are what stays

    def sides(by: str, frame: str) -> list[WindowSpec]:
        spans = [(start, min(end, -1)), (max(start, 1), end)]
        return [getattr(Window.partitionBy(*parts).orderBy(F.col(by)), frame)(a, b) for a, b in spans if a <= b]

    others = [peers.orderBy(F.col(place)).rowsBetween(a, b) for a, b in ((Window.unboundedPreceding, -1), (1, Window.unboundedFollowing))]
    own = peers.orderBy(F.col(place)).rowsBetween(0, 0)
    if mode == "rows" and exclude == "current_row":
        kept = sides(place, "rowsBetween")
    elif mode == "groups":
        kept = sides(group, "rangeBetween") + {"group": [], "ties": [own], "current_row": others}[exclude] * around
    if kept is not None:
        return df, _together(name, value, kept)
    # The rows that go: of the frame, those of the row's group, all or some.
    if mode == "rows":
        gone = [peers.orderBy(F.col(place)).rowsBetween(start, end)]
        back = [own] if exclude == "ties" and around else []
    else:
        gone = {"group": [peers], "ties": others, "current_row": [own]}[exclude] * around
        back = []
    if name in ("sum", "avg", "count"):
        n = _count(value, [window]) - _count(value, gone) + _count(value, back)
        if name == "count":
            return df, n
        total = _sum(value, [window]) - _sum(value, gone) + _sum(value, back)
        return df, F.when(n > 0, total if name == "sum" else total / n)
    members = F.collect_list(F.struct(value.alias("v"), F.col(place).alias("p"), F.col(group).alias("g"))).over(window)
    df = df.withColumn(f"{prefix}_members", members)

    def stays(x: Column) -> Column:
        if exclude == "current_row":
            return x["p"] != F.col(place)
        if exclude == "group":
            return x["g"] != F.col(group)
        return (x["g"] != F.col(group)) | (x["p"] == F.col(place))

    left = F.transform(F.filter(F.col(f"{prefix}_members"), lambda x: stays(x) & x["v"].isNotNull()), lambda x: x["v"])
    return df, F.array_min(left) if name == "min" else F.array_max(left)


def _count(value: Column, frames: list[WindowSpec]) -> Column:
    out = F.lit(0).cast("long")
    for frame in frames:
        out = out + F.count(value).over(frame)
    return out


def _sum(value: Column, frames: list[WindowSpec]) -> Column:
    out = F.lit(0)
    for frame in frames:
        out = out + F.coalesce(F.sum(value).over(frame), F.lit(0))
    return out


def _together(name: str, value: Column, frames: list[WindowSpec]) -> Column:
    """An aggregate of the rows of several frames that share none."""
    if name == "count":
        return _count(value, frames)
    if name in ("min", "max"):
        found = [getattr(F, name)(value).over(frame) for frame in frames]
        pick = F.least if name == "min" else F.greatest
        return F.when(F.lit(False), value) if not found else found[0] if len(found) == 1 else pick(*found)
    n, total = _count(value, frames), _sum(value, frames)
    return F.when(n > 0, total if name == "sum" else total / n)
