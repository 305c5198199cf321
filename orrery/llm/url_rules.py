"""URL rules by a sort-merge range join; DataFrame functions only.

A rule (host, path) fits its host and all subdomains if the URL's path starts with the
rule's.  Its key is the host's labels reversed, a slash and the path, so the URLs at that
host and below that path are the interval of keys that start with the rule's.  A URL has one
key per number of labels that any rule's host has; each falls into intervals that are nested
or apart.  Rules and keys are sorted together and swept: the last rule at or before a key
carries its stack of enclosing rules, and the stack's entries that are prefixes of the key
are the rules that fit.

Scale: rules are cut by their sorted keys into blocks of at most ``block_rules`` and URLs go
to the block of their key, dealt over salts so that a host with a third of all rows is swept
in many tasks.  The only replication is a block's rules, once per salt.

Edge cases: a null URL, or one without ``://``, has empty host and path and fits only rules of
an empty host; with no rule that fits, or no rules at all, the verdict is ``default``.
Repeated rules count once, and of equal host and path "block" wins.  Repeated pages are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import slices

RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    """The host after the first ``://``; A-Z are lower-cased and nothing else."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _reversed(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def judge(
    pages: DataFrame,
    rules: DataFrame | Sequence[tuple[str, str, str]] = RULES,
    url: str = "url",
    default: str = "allow",
    block_rules: int = 50_000,
    salts: int | None = None,
) -> DataFrame:
    """All rows and columns of ``pages`` with host, path, rule (host + path, or null) and verdict.

    rules: (verdict, host, path) rows.  The rule with the most host labels, then the longest path, wins.
    Columns of ``pages`` that have these names are replaced.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    page = F.struct(*[pages[c].alias(f"c{i}") for i, c in enumerate(keep)])
    pages = pages.select(page.alias("page"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))

    lower = F.translate(F.col("host"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rules = rules.select("verdict", lower.alias("host"), "path").na.drop()
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" is after "allow"
    rules = rules.select(
        F.concat(F.array_join(_reversed(F.col("host")), "."), F.lit("/"), F.col("path")).alias("key"),
        F.size(F.split("host", r"\.")).alias("labels"),
        F.concat("host", "path").alias("rule"),
        "verdict",
    )
    depths = [r.labels for r in rules.select("labels").distinct().collect()]  # at most the labels of a host name
    n_rules = rules.count()
    n_blocks = max(1, -(-n_rules // block_rules))
    cuts = _cuts(rules, n_blocks)
    block = F.lit(0)
    if cuts:
        block = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("key")))

    # The stack of a rule: the rules whose keys are prefixes of its own, outermost first.
    by_key = rules.select(F.col("key").alias("outer_key"), F.struct("labels", F.length("key").alias("size"), "key", "rule", "verdict").alias("outer"))
    prefixes = F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))
    stacks = (
        rules.select("key", F.explode(prefixes).alias("outer_key"))
        .join(by_key, "outer_key")
        .groupBy("key")
        .agg(F.array_sort(F.collect_list("outer")).alias("stack"))  # as deep as the key is long at most
    )

    salts = salts or slices(spark)
    stacks = stacks.select("key", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "stack")
    turned = _reversed(F.col("host"))
    # A host of fewer labels has no key for a depth; every page keeps one key at least.
    keys = [F.concat(F.array_join(F.slice(turned, 1, d), "."), F.lit("/"), F.col("path")) for d in sorted(depths)]
    keys = F.array_compact(F.array(*[F.when(F.size(turned) >= d, k) for d, k in zip(sorted(depths), keys, strict=True)], F.lit("")))
    keys = F.when(F.size(keys) > 1, F.filter(keys, lambda k: k != "")).otherwise(keys)
    pages = pages.withColumn("id", F.monotonically_increasing_id()).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    points = pages.select("*", F.explode(keys).alias("key"))
    points = points.withColumn("block", block).withColumn("kind", F.lit(1))
    events = points.unionByName(stacks, allowMissingColumns=True)

    sweep = Window.partitionBy("block", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    fits = F.filter("stack", lambda r: F.col("key").startswith(r["key"]))
    best = swept.withColumn("best", F.try_element_at(fits, F.lit(-1)))
    best = best.select("page", "host", "path", "id", "best")
    if len(depths) > 1:
        best = best.groupBy("id").agg(F.first("page").alias("page"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("best").alias("best"))
    return best.select(
        *[F.col(f"page.c{i}").alias(c) for i, c in enumerate(keep)],
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def _cuts(rules: DataFrame, n_blocks: int) -> list[str]:
    """The first keys of the blocks but the first."""
    if n_blocks == 1:
        return []
    ranked = rules.select("key").distinct().repartitionByRange(n_blocks, "key").groupBy(F.spark_partition_id().alias("block")).agg(F.min("key").alias("key"))
    return sorted(r.key for r in ranked.collect())[1:]
