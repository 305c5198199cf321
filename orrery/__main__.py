"""Command line: ``python -m orrery init|schema|query|export|import …``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from .operators.query import Query
from .plans.schemes import SchemeRegistry
from .sources import exchange, objects


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="orrery", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("init", help="a folder of empty tables, and the registry of their schemes")
    p.add_argument("folder")
    p.add_argument("schemes", nargs="+", metavar="name=schema", help="JSON, as of the command schema")
    p = commands.add_parser("schema", help="the schema of a table, as JSON")
    p.add_argument("table")
    p = commands.add_parser("query", help="rows of a table that a filter holds for")
    p.add_argument("table")
    p.add_argument("filter", help="JSON")
    p.add_argument("--select", nargs="*", default=[])
    p.add_argument("--take", type=int, default=20)
    p.add_argument("--output", help="a folder for Parquet, instead of the screen")
    p = commands.add_parser("export", help="tables to an exchange file")
    p.add_argument("file")
    p.add_argument("tables", nargs="+", metavar="kind=table")
    p.add_argument("--compress", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--schemes", nargs="*", type=int, help="ids of the schemes to export")
    p = commands.add_parser("import", help="one kind of records from an exchange file to Parquet")
    p.add_argument("file")
    p.add_argument("kind")
    p.add_argument("schema", help="JSON, as of the command schema")
    p.add_argument("output")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "init":
        registry = SchemeRegistry()
        for name, kind in (x.split("=", 1) for x in a.schemes):
            registry.sync(name, T.StructType.fromJson(json.loads(kind)))
            registry.empty(spark, name).write.parquet(f"{a.folder}/{name}")
        registry.table(spark).coalesce(1).write.parquet(f"{a.folder}/_schemes")
    elif a.command == "schema":
        print(spark.read.parquet(a.table).schema.json())
    elif a.command == "query":
        found = Query(objects.load(spark, a.table)).where(json.loads(a.filter))
        if a.output:
            (found.select(*a.select).df() if a.select else found.df()).write.parquet(a.output)
        else:
            found = found.take(a.take)
            for line in (found.select(*a.select).df() if a.select else found.df()).toJSON().toLocalIterator():
                print(line)
    elif a.command == "export":
        tables = {k: spark.read.parquet(t) for k, t in (x.split("=", 1) for x in a.tables)}
        print(json.dumps(exchange.export(tables, a.file, a.compress, a.dry_run, a.schemes)))
    else:
        schema = T.StructType.fromJson(json.loads(a.schema))
        exchange.load(spark, a.file, {a.kind: schema})[a.kind].write.parquet(a.output)


if __name__ == "__main__":
    main()
