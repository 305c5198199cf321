"""Schemes: named record types, their registry, comparison and migration."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Logical types and Spark's.
TYPES = {
    **dict.fromkeys(
        ("String", "Char", "Url", "Email", "Phone", "Json", "Xml", "Base64", "Color", "FilePath", "FileName", "MimeType", "GeoPoint", "Enum", "TimeOnly", "TimeSpan", "Guid"),
        T.StringType(),
    ),
    **dict.fromkeys(("Long", "Int", "Short", "Byte", "EnumInt", "ListItem", "Object"), T.LongType()),
    **dict.fromkeys(("Double", "Float", "Latitude", "Longitude"), T.DoubleType()),
    **dict.fromkeys(("Numeric", "Decimal"), T.DecimalType(38, 18)),
    "Boolean": T.BooleanType(),
    **dict.fromkeys(("DateTime", "DateTimeOffset"), T.TimestampType()),
    "DateOnly": T.DateType(),
    "ByteArray": T.BinaryType(),
}
_NAME = re.compile(r"^[^\W\d]\w*$")
#: The scheme of objects that wait to be purged.
DELETED = -10


@dataclass
class Scheme:
    name: str
    type: T.StructType
    id: int = 0

    def structure_hash(self) -> str:
        return json.dumps(self.type.jsonValue(), sort_keys=True)


@dataclass
class SchemeRegistry:
    """Schemes by name; synchronising replaces a scheme's structure and reports what changed."""

    schemes: dict[str, Scheme] = field(default_factory=dict)

    def sync(self, name: str, kind: T.StructType, delete_extra: bool = True) -> dict[str, list[str]]:
        check_names(kind)
        old = self.schemes.get(name)
        report = compare(old.type, kind) if old else {"added": kind.names, "removed": [], "changed": []}
        if old and not delete_extra:
            kind = T.StructType([*kind.fields, *[f for f in old.type.fields if f.name in report["removed"]]])
            report["removed"] = []
        self.schemes[name] = Scheme(name, kind, old.id if old else len(self.schemes) + 1)
        return report

    def empty(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.createDataFrame([], self.schemes[name].type)

    def table(self, spark: SparkSession) -> DataFrame:
        """id, name and type (JSON) of each scheme, to be stored; load() reads it."""
        rows = [(s.id, s.name, s.type.json()) for s in self.schemes.values()]
        return spark.createDataFrame(rows, "id long, name string, type string")

    @staticmethod
    def load(table: DataFrame) -> SchemeRegistry:
        rows = table.select("id", "name", "type").collect()  # a row for each scheme
        return SchemeRegistry({r.name: Scheme(r.name, T.StructType.fromJson(json.loads(r.type)), r.id) for r in rows})

    def structures(self, spark: SparkSession, name: str) -> DataFrame:
        """The scheme's fields, nested ones too: path, the path above, type, and whether it is an array or a map."""
        rows: list[tuple[str, str | None, str, bool, bool]] = []

        def walk(kind: T.StructType, above: str | None) -> None:
            for f in kind.fields:
                path = f"{above}.{f.name}" if above else f.name
                is_array, is_map = isinstance(f.dataType, T.ArrayType), isinstance(f.dataType, T.MapType)
                item = f.dataType.elementType if is_array else f.dataType.valueType if is_map else f.dataType
                rows.append((path, above, "class" if isinstance(item, T.StructType) else item.simpleString(), is_array, is_map))
                if isinstance(item, T.StructType):
                    walk(item, path)

        walk(self.schemes[name].type, None)
        return spark.createDataFrame(rows, "path string, above string, type string, is_array boolean, is_map boolean")

    def delete(self, name: str, used: DataFrame | None = None) -> None:
        """Forgets a scheme; used: objects with a column scheme_id, of which none may have it."""
        if used is not None and not used.where(F.col("scheme_id") == self.schemes[name].id).isEmpty():
            raise ValueError(f"scheme {name} has objects")
        del self.schemes[name]


def check_names(kind: T.DataType, path: str = "") -> None:
    """Field names are identifiers, at every depth."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            if not _NAME.match(f.name):
                raise ValueError(f"{path}{f.name} is no identifier")
            check_names(f.dataType, f"{path}{f.name}.")
    elif isinstance(kind, T.ArrayType):
        check_names(kind.elementType, path)
    elif isinstance(kind, T.MapType):
        check_names(kind.valueType, path)


def validate(kind: T.StructType, old: T.StructType | None = None) -> list[dict[str, str]]:
    """What is wrong, or will be lost: severity (error, warning, info), field and problem; the names, types, and changes from an old structure."""
    out = [{"severity": "error", "field": f.name, "problem": "no identifier"} for f in kind.fields if not _NAME.match(f.name)]
    lower = [f.name.lower() for f in kind.fields]
    out += [{"severity": "error", "field": f.name, "problem": "two fields of this name"} for f in kind.fields if lower.count(f.name.lower()) > 1]
    out += [{"severity": "error", "field": f.name, "problem": f"no support for {f.dataType.simpleString()}"} for f in kind.fields if not _supported(f.dataType)]
    if old is not None:
        found = compare(old, kind)
        out += [{"severity": "info", "field": n, "problem": "new"} for n in found["added"]]
        out += [{"severity": "warning", "field": n, "problem": "its values go"} for n in found["removed"]]
        out += [{"severity": "warning", "field": n, "problem": f"{old[n].dataType.simpleString()} becomes {kind[n].dataType.simpleString()}"} for n in found["changed"]]
    return out


def _supported(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_supported(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _supported(kind.elementType)
    if isinstance(kind, T.MapType):
        return not isinstance(kind.keyType, (T.ArrayType, T.MapType)) and _supported(kind.valueType)
    return not isinstance(kind, (T.NullType, T.CalendarIntervalType, T.YearMonthIntervalType, T.DayTimeIntervalType, T.UserDefinedType))


def compare(old: T.StructType, new: T.StructType) -> dict[str, list[str]]:
    """Names that are added, removed, or of another type."""
    before, after = {f.name: f.dataType for f in old.fields}, {f.name: f.dataType for f in new.fields}
    return {
        "added": [n for n in after if n not in before],
        "removed": [n for n in before if n not in after],
        "changed": [n for n in after if n in before and before[n] != after[n]],
    }


def evolve(df: DataFrame, kind: T.StructType) -> DataFrame:
    """The rows in another structure: new fields are null, dropped ones go, others are cast (what can't be becomes null)."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind.fields])


def migrate(df: DataFrame, name: str, to: T.DataType) -> DataFrame:
    """One column in another type; a value that can't be converted becomes null."""
    return df.withColumn(name, converted(df.schema[name].dataType, F.col(name), to))


def converted(old: T.DataType, c: Column, to: T.DataType) -> Column:
    if isinstance(old, T.StringType) and isinstance(to, T.BooleanType):
        low = F.lower(F.trim(c))
        return F.when(low.isin("true", "1", "yes", "t"), True).when(low.isin("false", "0", "no", "f"), False)
    if isinstance(old, T.BooleanType) and isinstance(to, T.StringType):
        return F.when(c, "true").when(~c, "false")
    if isinstance(old, (T.DoubleType, T.FloatType, T.DecimalType)) and isinstance(to, (T.LongType, T.IntegerType)):
        return F.round(c).try_cast(to)
    return c.try_cast(to)


def migration_report(df: DataFrame, name: str, to: T.DataType) -> DataFrame:
    """A dry run: total, success (null stays null) and errors."""
    new = converted(df.schema[name].dataType, F.col(name), to)
    failed = F.col(name).isNotNull() & new.isNull()
    return df.agg(F.count("*").alias("total"), F.count_if(~failed).alias("success"), F.count_if(failed).alias("errors"))


def object_hash(kind: T.StructType, column: str | None = None) -> Column:
    """MD5 of the properties' texts in order of their names, joined by ``|``; nested ones by their own hash."""

    def text(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            return F.when(c.isNotNull(), F.md5(F.concat_ws("|", *[F.coalesce(text(c.getField(n), t[n].dataType), F.lit("")) for n in sorted(t.names)])))
        if isinstance(t, T.ArrayType):
            return F.when(c.isNotNull(), F.md5(F.array_join(F.transform(c, lambda x: F.coalesce(text(x, t.elementType), F.lit(""))), "|")))
        if isinstance(t, T.MapType):
            entry = F.transform(F.array_sort(F.map_keys(c)), lambda k: F.concat(k.cast("string"), F.lit("="), F.coalesce(text(F.try_element_at(c, k), t.valueType), F.lit(""))))
            return F.when(c.isNotNull(), F.md5(F.array_join(entry, "|")))
        return c.cast("string")

    pick = (lambda n: F.col(f"{column}.{n}")) if column else F.col
    return F.md5(F.concat_ws("|", *[F.coalesce(text(pick(n), kind[n].dataType), F.lit("")) for n in sorted(kind.names)]))
