"""Scalar functions of expression trees, as columns.

Each takes the compiled arguments, and their types where those decide.  Integers divide to
integers; ``round`` is half away from zero; positions in strings count from 1.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Typed = tuple[Column, T.DataType]

UNITS = {u: u.upper() for u in ("year", "month", "week", "day", "hour", "minute", "second", "millisecond")}
_MICROS = {"millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}
#: Types that a cast may name, and Spark's.
CASTS = {
    "text": "string", "varchar": "string", "smallint": "smallint", "int": "int", "integer": "int", "bigint": "bigint", "real": "float",
    "double precision": "double", "numeric": "decimal(38,18)", "decimal": "decimal(38,18)", "boolean": "boolean", "date": "date",
    "timestamp": "timestamp", "timestamptz": "timestamp", "uuid": "string", "bytea": "binary",
}


def _integral(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def divide(a: Typed, b: Typed) -> Column:
    if _integral(a[1]) and _integral(b[1]):
        return F.call_function("div", a[0], b[0])
    return a[0] / b[0]


def _fold(op: Callable[[Column, Column], Column]) -> Callable[..., Column]:
    def run(*args: Column) -> Column:
        out = args[0]
        for x in args[1:]:
            out = op(out, x)
        return out

    return run


def _unit(name: str) -> str:
    unit = name.lower().removesuffix("s")
    if unit not in UNITS:
        raise ValueError(f"unknown unit {name}")
    return unit


def date_add(unit: str, d: Column, n: Column) -> Column:
    return F.timestamp_add(UNITS[_unit(unit)], n.cast("int"), d)


def date_diff(unit: str, a: Column, b: Column) -> Column:
    """a less b: from milliseconds to weeks rounded to the nearest whole, months and years whole ones that have passed (by calendar fields, day and time of day)."""
    unit = _unit(unit)
    if unit in _MICROS:
        return F.round((F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / _MICROS[unit]).cast("long")
    a, b = a.cast("timestamp"), b.cast("timestamp")
    high, low = F.greatest(a, b), F.least(a, b)
    within = lambda t: F.struct(F.day(t), F.unix_micros(t) - F.unix_micros(F.date_trunc("day", t)))
    months = (F.year(high) - F.year(low)) * 12 + F.month(high) - F.month(low) - (within(high) < within(low)).cast("int")
    whole = months if unit == "month" else F.floor(months / 12)
    return F.when(a.isNotNull() & b.isNotNull(), F.when(a >= b, whole).otherwise(-whole)).cast("long")


def cast(value: Typed, name: str) -> Column:
    """To integers by rounding: of floats to the even of two nearest, of decimals away from zero."""
    name = name.lower()
    if name not in CASTS:
        raise ValueError(f"cannot cast to {name}")
    c, kind = value
    if CASTS[name] in ("smallint", "int", "bigint"):
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            c = F.rint(c)
        elif isinstance(kind, T.DecimalType):
            c = F.round(c)
    return c.cast(CASTS[name])


def date_trunc(unit: str, d: Column) -> Column:
    unit = unit.lower()
    years = {"decade": 10, "century": 100, "millennium": 1000}.get(unit)
    if years is None:
        return F.date_trunc({"microseconds": "microsecond", "milliseconds": "millisecond"}.get(unit, unit), d)
    shift = 0 if unit == "decade" else 1  # centuries begin with year 1
    first = F.floor((F.year(d) - shift) / years) * years + shift
    return F.make_timestamp(first.cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def pad(side: str, s: Column, n: Column, fill: Column) -> Column:
    """Fills up to n characters; never cuts."""
    return F.call_function("lpad" if side == "left" else "rpad", s, F.greatest(F.length(s), n.cast("int")), fill)


def regex_replace(s: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    """The first match, or all with the flag g; i ignores case; \\1 and \\& stand for groups."""
    case = "(?i)" if "i" in flags else ""
    every = "g" in flags

    def group(m: re.Match[str]) -> str:
        x = m.group(0)
        if x == "$":
            return r"\$"
        if x == r"\&":
            return "$0" if every else "$2"
        if x[1:].isdigit():
            return f"${int(x[1:]) if every else int(x[1:]) + 2}"
        return r"\\" + x[1:]

    replacement = re.sub(r"\\[0-9&]|\\.|\$", group, replacement)
    if every:
        return F.regexp_replace(s, case + pattern, replacement)
    # Anchored at the start, so only the first; inner groups move up by two.
    pattern = re.sub(r"(?<!\\)\\([1-9])", lambda m: f"\\{int(m.group(1)) + 2}", pattern)
    return F.regexp_replace(s, f"(?s){case}^(.*?)({pattern})", f"$1{replacement}")


def _call(name: str) -> Callable[..., Column]:
    return lambda *args: F.call_function(name, *args)


#: Functions of columns alone: name to function and the numbers of arguments allowed (None: any from 1).
PLAIN: dict[str, tuple[Callable[..., Column], tuple[int, ...] | None]] = {
    "$add": (_fold(lambda a, b: a + b), None),
    "$mul": (_fold(lambda a, b: a * b), None),
    "$sub": (lambda a, b: a - b, (2,)),
    "$mod": (lambda a, b: a % b, (2,)),
    "$neg": (lambda a: -a, (1,)),
    "$abs": (F.abs, (1,)),
    "$floor": (F.floor, (1,)),
    "$ceil": (F.ceil, (1,)),
    "$sqrt": (F.sqrt, (1,)),
    "$sign": (F.signum, (1,)),
    "$exp": (F.exp, (1,)),
    "$ln": (F.ln, (1,)),
    "$power": (F.pow, (2,)),
    "$log": (_call("log"), (2,)),
    "$log10": (F.log10, (1,)),
    "$sin": (F.sin, (1,)),
    "$cos": (F.cos, (1,)),
    "$tan": (F.tan, (1,)),
    "$asin": (F.asin, (1,)),
    "$acos": (F.acos, (1,)),
    "$atan": (F.atan, (1,)),
    "$coalesce": (F.coalesce, None),
    "$upper": (F.upper, (1,)),
    "$lower": (F.lower, (1,)),
    "$trim": (F.trim, (1,)),
    "$trimstart": (F.ltrim, (1,)),
    "$trimend": (F.rtrim, (1,)),
    "$length": (F.length, (1,)),
    "$concat": (F.concat, None),
    "$substring": (_call("substring"), (2, 3)),
    "$replace": (_call("replace"), (3,)),
    "$indexof": (lambda s, x: F.call_function("position", x, s), (2,)),
    "$padleft": (lambda s, n, c=None: pad("left", s, n, F.lit(" ") if c is None else c), (2, 3)),
    "$padright": (lambda s, n, c=None: pad("right", s, n, F.lit(" ") if c is None else c), (2, 3)),
    "$year": (F.year, (1,)),
    "$month": (F.month, (1,)),
    "$day": (F.day, (1,)),
    "$hour": (F.hour, (1,)),
    "$minute": (F.minute, (1,)),
    "$second": (lambda d: F.extract(F.lit("SECOND"), d), (1,)),
    "$dayofweek": (lambda d: F.dayofweek(d) - 1, (1,)),
    "$dayofyear": (F.dayofyear, (1,)),
    "$now": (lambda: F.current_timestamp(), (0,)),
    "$utcnow": (lambda: F.current_timestamp(), (0,)),
    "$today": (lambda: F.current_date(), (0,)),
}
