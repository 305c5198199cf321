"""Queries over the driver's tables, one or more for each operator, with the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import registered
from .operators import permissions, storage, tree
from .operators.query import Query
from .operators.tree import TreeQuery
from .operators.window import Frame
from .plans import schemes
from .plans.compiler import Compiler
from .plans.nodes import call, const, field, when
from .plans.paths import View
from .plans.stored import shared_folder
from .sources import exchange, graph, lists, objects
from .streaming import filters as streams

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    def register(f: Run) -> Run:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# Views of the tables as objects.

_KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey",
    "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id",
    "pages": "page_id", "conversations": "conv_id",
}


def view(spark: SparkSession, d: str, name: str) -> View:
    df = spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")
    return View(df, {"id": _KEYS[name]}, None, name)


def q(spark: SparkSession, d: str, name: str) -> Query:
    return Query(view(spark, d, name))


def orders_with_lines(spark: SparkSession, d: str) -> View:
    """Orders with their lines as an array of structs."""
    line = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    lines = view(spark, d, "lineitem").df.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("Lines"))
    return View(view(spark, d, "orders").df.join(lines, "o_orderkey", "left"), {"id": "o_orderkey"}, None, "orders")


def events_with_map(spark: SparkSession, d: str) -> View:
    df = view(spark, d, "events").df
    return View(df.withColumn("Props", F.from_json("props", "map<string,int>")).select("event_id", "event_type", "value", F.col("Props").alias("Map")), {"id": "event_id"}, None, "events")


def nested_customers(spark: SparkSession, d: str) -> View:
    """Customers with a nested class: nation, and in it region."""
    c, n, r = (view(spark, d, t).df for t in ("customer", "nation", "region"))
    region = F.struct(F.col("r_regionkey").alias("Key"), F.col("r_name").alias("Name"))
    n = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.struct(F.col("n_name").alias("Name"), region.alias("Region")).alias("Nation"))
    return View(c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).drop("n_nationkey"), {"id": "c_custkey"}, None, "customer")


def forest(spark: SparkSession, d: str) -> View:
    """Regions, nations, customers and orders as one tree of objects of four schemes."""

    def level(name: str, scheme: int, key: str, offset: int, parent: str | None, above: int, label: str, value: str | None) -> DataFrame:
        df = view(spark, d, name).df
        return df.select(
            (F.col(key).cast("long") + offset).alias("id"),
            (F.col(parent).cast("long") + above if parent else F.lit(None).cast("long")).alias("parent_id"),
            F.lit(scheme).cast("long").alias("scheme_id"),
            F.col(label).cast("string").alias("name"),
            (F.col(value) if value else F.lit(None)).cast("double").alias("Value"),
        )

    df = (
        level("region", 1, "r_regionkey", 1, None, 0, "r_name", None)
        .union(level("nation", 2, "n_nationkey", 1_000, "n_regionkey", 1, "n_name", None))
        .union(level("customer", 3, "c_custkey", 1_000_000, "c_nationkey", 1_000, "c_name", "c_acctbal"))
        .union(level("orders", 4, "o_orderkey", 1_000_000_000, "o_custkey", 1_000_000, "o_orderstatus", "o_totalprice"))
    )
    return View(df, {"id": "id", "parent_id": "parent_id", "scheme_id": "scheme_id", "name": "name"}, None, "forest")


def of_scheme(whole: View, scheme: int) -> View:
    return whole.with_df(whole.df.where(F.col("scheme_id") == scheme))


def tq(spark: SparkSession, d: str, scheme: int | None = None) -> TreeQuery:
    whole = forest(spark, d)
    return TreeQuery(of_scheme(whole, scheme) if scheme else whole, forest=whole)


_NODES = """nodes AS (
  SELECT 1 + r_regionkey::BIGINT AS id, NULL::BIGINT AS parent_id, 1::BIGINT AS scheme_id, r_name AS name, NULL::DOUBLE AS "Value" FROM region
  UNION ALL SELECT 1000 + n_nationkey::BIGINT, 1 + n_regionkey::BIGINT, 2, n_name, NULL FROM nation
  UNION ALL SELECT 1000000 + c_custkey, 1000 + c_nationkey::BIGINT, 3, c_name, c_acctbal FROM customer
  UNION ALL SELECT 1000000000 + o_orderkey, 1000000 + o_custkey, 4, o_orderstatus, o_totalprice FROM orders
)"""
_PATHS = f"""WITH RECURSIVE {_NODES}, paths AS (
  SELECT id, 0 AS level, id AS root, [id] AS path FROM nodes WHERE parent_id IS NULL
  UNION ALL SELECT n.id, p.level + 1, p.root, list_append(p.path, n.id) FROM nodes n JOIN paths p ON n.parent_id = p.id
)"""


def _scalar_row(spark: SparkSession, **values: object) -> DataFrame:
    """One row of Python results."""
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'long' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))


# Filters, projection, order, paging.


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'
ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def filter_topk(spark, d):
    found = q(spark, d, "orders").where({"o_totalprice": {"$gt": 100000}, "o_orderstatus": "F"})
    return found.order_by("o_totalprice", desc=True).then_by("o_orderkey").take(100).df().select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE (o_totalprice BETWEEN 50000 AND 60000 OR o_orderpriority IN ('1-URGENT','2-HIGH')) AND NOT (o_orderstatus = 'O')")
def pred_connectives(spark, d):
    f = {"$and": [{"$or": [{"o_totalprice": {"$gte": 50000, "$lte": 60000}}, {"o_orderpriority": {"$in": ["1-URGENT", "2-HIGH"]}}]}, {"$not": {"o_orderstatus": "O"}}]}
    return q(spark, d, "orders").where(f).df().select("o_orderkey")


@query("SELECT (SELECT count(*) FROM orders) AS n_all, 0::BIGINT AS n_none, (SELECT count(*) FROM orders) AS n_empty, 0::BIGINT AS n_in_nothing")
def pred_empty_connectives(spark, d):
    o = q(spark, d, "orders")
    return _scalar_row(spark, n_all=o.where({"$and": []}).count(), n_none=o.where({"$or": []}).count(), n_empty=o.where({}).count(), n_in_nothing=o.where_in("o_orderstatus", []).count())


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F','P') AND o_orderpriority <> '5-LOW'")
def pred_nin_ne(spark, d):
    return q(spark, d, "orders").where({"o_orderstatus": {"$nin": ["F", "P"]}, "o_orderpriority": {"$ne": "5-LOW"}}).df().select("o_orderkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%e%' AND p_type ILIKE '%Steel%' OR starts_with(p_brand, 'Brand#1') AND ends_with(p_name, 'e') AND contains(p_name, 'o')")
def pred_text(spark, d):
    f = {"$or": [{"p_name": {"$like": "%a%e%"}, "p_type": {"$ilike": "%Steel%"}}, {"p_brand": {"$startsWith": "Brand#1"}, "p_name": {"$endsWith": "e", "$contains": "o"}}]}
    return q(spark, d, "part").where(f).df().select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_type), 'brass') OR starts_with(lower(p_name), 'a') OR ends_with(lower(p_brand), '3')")
def pred_text_ignore_case(spark, d):
    f = {"$or": [{"p_type": {"$containsIgnoreCase": "BrAsS"}}, {"p_name": {"$startsWithIgnoreCase": "A"}}, {"p_brand": {"$endsWithIgnoreCase": "3"}}]}
    return q(spark, d, "part").where(f).df().select("p_partkey")


@query("SELECT doc_id, n_chars FROM documents WHERE regexp_matches(text, '[0-9]{3}-[0-9]{4}') OR regexp_matches(source, '(?i)^SRC1$') AND NOT regexp_matches(lang, '^(en|de)$')")
def pred_regex(spark, d):
    f = {"$or": [{"text": {"$regex": "[0-9]{3}-[0-9]{4}"}}, {"source": {"$iregex": "^SRC1$"}, "lang": {"$notregex": "^(en|de)$"}}]}
    return q(spark, d, "documents").where(f).df().select("doc_id", "n_chars")


_FTS = r"' ' || regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g') || ' '"


@query(f"SELECT doc_id FROM (SELECT doc_id, {_FTS} AS w FROM documents) WHERE contains(w, ' mit license ') AND NOT contains(w, ' idiot ') OR contains(w, ' apache ') AND contains(w, ' version ')")
def pred_fts(spark, d):
    return q(spark, d, "documents").where({"text": {"$fts": '"mit license" -idiot or apache version'}}).df().select("doc_id")


@query(f"SELECT doc_id FROM (SELECT doc_id, {_FTS.replace('text', 'concat_ws(chr(32), lang, text)')} AS w FROM documents) WHERE contains(w, ' fr ') AND contains(w, ' license ')")
def pred_fts_fields(spark, d):
    return q(spark, d, "documents").where({"$fts": {"query": "fr license", "fields": ["lang", "text"]}}).df().select("doc_id")


@query("""SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_type ILIKE '%STEEL%' OR contains(lower(p_name), 'ing') AND starts_with(p_brand, 'Brand#2') OR ends_with(lower(p_type), 'tin') AND regexp_matches(p_name, '^[a-m]')
OR regexp_matches(p_brand, '(?i)^BRAND#5') AND NOT regexp_matches(p_type, '(?i)copper')""")
def pred_text_expression(spark, d):
    name, kind, brand = ({"$field": c} for c in ("p_name", "p_type", "p_brand"))
    f = {"$or": [
        {"$and": [{"$like": [name, "%a%"]}, {"$ilike": [kind, "%STEEL%"]}]}, {"$and": [{"$containsIgnoreCase": [name, "ING"]}, {"$startsWith": [brand, "Brand#2"]}]},
        {"$and": [{"$endsWithIgnoreCase": [kind, "TIN"]}, {"$regex": [name, "^[a-m]"]}]}, {"$and": [{"$iregex": [brand, "^BRAND#5"]}, {"$inotregex": [kind, "copper"]}]},
    ]}
    return q(spark, d, "part").where({"$expr": f}).df().select("p_partkey")


@query("SELECT o_orderkey FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS paid FROM orders) WHERE paid IS NULL AND o_totalprice > 100000 OR paid * 2 IS NOT NULL AND o_totalprice < 50000")
def pred_null_expression(spark, d):
    paid, price = {"$field": "Paid"}, {"$field": "o_totalprice"}
    f = {"$or": [{"$and": [{"$isNull": paid}, {"$gt": [price, 100000]}]}, {"$and": [{"$notNull": {"$mul": [paid, 2]}}, {"$lt": [price, 50000]}]}]}
    return _nullable(spark, d).where({"$expr": f}).df().select("o_orderkey")


@query("""SELECT o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE coalesce(n, 0) > 5 OR coalesce(n, 0) < 2 OR coalesce(n, 0) <= 3 AND o_orderstatus = 'O' OR n >= 5 AND o_orderstatus = 'P'
UNION ALL SELECT -o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def pred_array_counts(spark, d):
    whole = orders_with_lines(spark, d)
    f = {"$or": [{"Lines": {"$arrayCountGt": 5}}, {"Lines": {"$arrayCountLt": 2}}, {"Lines": {"$arrayCountLte": 3}, "o_orderstatus": "O"}, {"Lines": {"$arrayCountGte": 5}, "o_orderstatus": "P"}]}
    returned = whole.df.withColumn("Back", F.filter("Lines", lambda x: x["l_returnflag"] == "R"))
    none = Query(View(returned, {"id": "o_orderkey"}, None, "orders")).where({"Back": {"$arrayEmpty": True}}).df()
    counted = Query(whole).where(f).df()
    return counted.select("o_orderkey").union(none.select(-F.col("o_orderkey")))


def _nullable(spark, d) -> Query:
    df = view(spark, d, "orders").df.withColumn("Paid", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")))
    return Query(View(df, {"id": "o_orderkey"}, None, "orders"))


_NULLABLE = "WITH o AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS paid FROM orders)"


@query(f"""{_NULLABLE} SELECT count(*) FILTER (WHERE paid IS NULL) AS n_null, count(*) FILTER (WHERE paid IS NOT NULL) AS n_set,
count(*) FILTER (WHERE paid <> 0) AS n_ne, 0::BIGINT AS n_expr_null, count(*) FILTER (WHERE NOT (paid > 1000)) AS n_not FROM o""")
def pred_null(spark, d):
    o = _nullable(spark, d)
    return _scalar_row(
        spark,
        n_null=o.where({"Paid": None}).count(),
        n_set=o.where({"Paid": {"$exists": True, "$isNull": False}}).count(),
        n_ne=o.where({"Paid": {"$ne": 0}}).count(),
        n_expr_null=o.where({"$expr": {"$eq": [{"$field": "Paid"}, None]}}).count(),
        n_not=o.where({"$not": {"Paid": {"$gt": 1000}}}).count(),
    )


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity * l_discount > 2 AND l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30' AND coalesce(l_returnflag, 'x') <> 'N'")
def pred_expression(spark, d):
    f = (field("l_quantity") * field("l_discount") > 2) & field("l_shipdate").between("1997-01-01", "1997-06-30") & (field("l_returnflag").or_else("x") != "N")
    return q(spark, d, "lineitem").where(f).df().select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderstatus = 'F' THEN o_totalprice > 200000 ELSE o_totalprice < 5000 END AND o_orderpriority IN ('1-URGENT', '3-MEDIUM')")
def pred_ternary(spark, d):
    f = when(field("o_orderstatus") == "F", field("o_totalprice") > 200000, field("o_totalprice") < 5000) & field("o_orderpriority").is_in(["1-URGENT", "3-MEDIUM"])
    return q(spark, d, "orders").where({"$expr": f.tree}).df().select("o_orderkey")


@query("SELECT vec_id FROM embeddings WHERE embedding[1] > 0.1 AND len(embedding) >= 10 AND list_max(embedding) < 5")
def pred_array_elements(spark, d):
    f = {"$and": [{"$expr": {"$gt": [{"$field": "embedding[0]"}, 0.1]}}, {"embedding": {"$arrayCountGte": 10}}, {"$expr": {"$lt": [{"$field": "embedding[0]"}, 100]}}]}
    found = q(spark, d, "embeddings").where(f).df()
    return found.where(F.array_max("embedding") < 5).select("vec_id")


_FLAGS = "WITH o AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS flags FROM lineitem GROUP BY l_orderkey)"


def _flags(spark, d) -> Query:
    v = orders_with_lines(spark, d)
    df = v.df.where("Lines is not null").select("o_orderkey", F.transform("Lines", lambda x: x["l_returnflag"]).alias("Flags"), F.transform("Lines", lambda x: x["l_linenumber"]).alias("Numbers"))
    return Query(View(df, {"id": "o_orderkey"}, None, "orders"))


@query(f"""{_FLAGS} SELECT count(*) FILTER (WHERE list_contains(flags, 'R')) AS n_has, count(*) FILTER (WHERE NOT list_contains(flags, 'R')) AS n_ne,
count(*) FILTER (WHERE list_has_any(flags, ['A','R'])) AS n_in, count(*) FILTER (WHERE NOT list_has_any(flags, ['A','R'])) AS n_nin,
count(*) FILTER (WHERE len(flags) = 2) AS n_two, count(*) FILTER (WHERE flags[2] = 'N') AS n_second, count(*) FILTER (WHERE flags[1] = 'A') AS n_first,
count(*) FILTER (WHERE flags[-1] = 'A') AS n_last, count(*) FILTER (WHERE len(flags) > 0) AS n_any FROM o""")
def pred_array(spark, d):
    o = _flags(spark, d)
    tests = {
        "n_has": {"$arrayContains": "R"}, "n_ne": {"$ne": "R"}, "n_in": {"$in": ["A", "R"]}, "n_nin": {"$nin": ["A", "R"]}, "n_two": {"$arrayCount": 2},
        "n_second": {"$arrayAt": {"index": 1, "value": "N"}}, "n_first": {"$arrayFirst": "A"}, "n_last": {"$arrayLast": "A"}, "n_any": {"$arrayAny": True},
    }
    c = o.compiler()
    return o.view.df.agg(*[F.count_if(c.filter({"Flags": t})).alias(n) for n, t in tests.items()])


@query("""WITH o AS (SELECT l_orderkey, list(l_linenumber) AS n, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS f FROM lineitem GROUP BY l_orderkey)
SELECT count(*) FILTER (WHERE list_sum(n) = 6) AS n_sum, count(*) FILTER (WHERE list_max(n) = 4) AS n_max, count(*) FILTER (WHERE list_min(n) = 1) AS n_min,
count(*) FILTER (WHERE list_avg(n) = 2) AS n_avg, count(*) FILTER (WHERE starts_with(f[1], 'N')) AS n_starts, count(*) FILTER (WHERE ends_with(f[-1], 'R')) AS n_ends,
count(*) FILTER (WHERE len(list_filter(f, lambda x: x LIKE 'A%')) > 0) AS n_like, count(*) FILTER (WHERE len(n) >= 5) AS n_count FROM o""")
def pred_array_aggregates(spark, d):
    o = _flags(spark, d)
    c = o.compiler()
    tests = {
        "n_sum": {"Numbers": {"$arraySum": 6}}, "n_max": {"Numbers": {"$arrayMax": 4}}, "n_min": {"Numbers": {"$arrayMin": 1}}, "n_avg": {"Numbers": {"$arrayAvg": 2}},
        "n_starts": {"Flags": {"$arrayStartsWith": "N"}}, "n_ends": {"Flags": {"$arrayEndsWith": "R"}}, "n_like": {"Flags": {"$arrayMatches": "A%"}}, "n_count": {"Numbers.$count": {"$gte": 5}},
    }
    return o.view.df.agg(*[F.count_if(c.filter(t)).alias(n) for n, t in tests.items()])


@query("SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_quantity > 49 AND l_orderkey IN (SELECT o_orderkey FROM orders)")
def pred_each_element(spark, d):
    return Query(orders_with_lines(spark, d)).where({"Lines[].l_quantity": {"$gt": 49}}).df().select("o_orderkey")


@query("SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events WHERE json_extract(props, '$.k')::INT > 90 AND json_extract(props, '$.none') IS NULL")
def pred_map(spark, d):
    f = {"Map.ContainsKey": "k", "Map[k]": {"$gt": 90}, "$not": {"Map.ContainsKey": "none"}}
    return Query(events_with_map(spark, d)).where(f).select({"field": "event_id", "alias": "event_id"}, {"field": "Map[k]", "alias": "k"}).df()


@query("SELECT event_id FROM events WHERE json_extract(props, '$.k')::DOUBLE > 89.5 AND json_extract(props, '$.k')::DOUBLE <= 95 OR value < 1.5 AND value >= 0.25")
def pred_doubles(spark, d):
    f = {"$or": [{"Map[k]": {"$gtDouble": 89.5, "$lteDouble": 95}}, {"value": {"$ltDouble": 1.5, "$gteDouble": 0.25}}]}
    return Query(events_with_map(spark, d)).where(f).df().select("event_id")


_BY_PLACE = """WITH low AS (SELECT r_name, n_name, min(c_acctbal) AS low, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)"""


@query(f"""{_BY_PLACE} SELECT r_name, max(n) FILTER (WHERE n_name = 'NATION_3') AS n, max(low) FILTER (WHERE n_name = 'NATION_3') AS low FROM low GROUP BY 1 HAVING max(n) FILTER (WHERE n_name = 'NATION_3') > 0
UNION ALL SELECT r_name, NULL, NULL FROM low GROUP BY 1 HAVING count(*) FILTER (WHERE n_name = 'NATION_7') > 0""")
def pred_nested_maps(spark, d):
    """Regions with a map of nations to maps of figures; a key of a map in a map, and a key of a class in a map."""
    c, n, r = (view(spark, d, t).df for t in ("customer", "nation", "region"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_name").agg(F.min("c_acctbal").alias("low"), F.count("*").alias("n"))
    figures = F.create_map(F.lit("low"), F.col("low"), F.lit("n"), F.col("n").cast("double"))
    both = rows.groupBy("n_regionkey").agg(
        F.map_from_entries(F.collect_list(F.struct("n_name", figures))).alias("Figures"), F.map_from_entries(F.collect_list(F.struct("n_name", F.struct(F.col("n").alias("Count"), F.col("low").alias("Low"))))).alias("Places")
    )
    v = View(r.join(both, F.col("r_regionkey") == F.col("n_regionkey")), {"id": "r_regionkey"}, None, "region")
    found = Query(v).where({"Figures[NATION_3][n]": {"$gt": 0}, "Places[NATION_3].Count": {"$gt": 0}})
    out = found.select({"field": "r_name", "alias": "r_name"}, {"field": "Figures[NATION_3][n]", "alias": "n"}, {"field": "Places[NATION_3].Low", "alias": "low"}).df()
    seventh = Query(v).where({"Places.ContainsKey": "NATION_7"}).df().select("r_name", F.lit(None).cast("long"), F.lit(None).cast("double"))
    return out.select("r_name", F.col("n").cast("long").alias("n"), "low").union(seventh)


@query("SELECT c_custkey, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = (SELECT min(r_name) FROM region) AND length(n_name) > 4")
def pred_nested_path(spark, d):
    v = nested_customers(spark, d)
    first = view(spark, d, "region").df.agg(F.min("r_name")).first()[0]
    f = {"Nation.Region.Name": first, "Nation.Name.$length": {"$gt": 4}}
    return Query(v).where(f).select({"field": "c_custkey", "alias": "c_custkey"}, {"field": "Nation.Name", "alias": "nation"}).df()


def _priorities(spark, d) -> Query:
    o = view(spark, d, "orders").df
    items = lists.items(o, "o_orderpriority")
    coded = o.join(F.broadcast(items.select(F.col("id").alias("Priority"), F.col("value").alias("o_orderpriority"))), "o_orderpriority").drop("o_orderpriority")
    return Query(View(lists.with_items(coded, "Priority", items), {"id": "o_orderkey"}, None, "orders"))


@query("SELECT o_orderkey, o_orderpriority AS priority, dense_rank FROM (SELECT *, dense_rank() OVER (ORDER BY o_orderpriority) AS dense_rank FROM orders) WHERE o_orderpriority LIKE '%HIGH%' OR dense_rank = 1")
def list_items(spark, d):
    found = _priorities(spark, d).where({"$or": [{"Priority.Value": {"$like": "%HIGH%"}}, {"Priority": 1}]})
    return found.select({"field": "o_orderkey", "alias": "o_orderkey"}, {"field": "Priority.Value", "alias": "priority"}, {"field": "Priority.Id", "alias": "dense_rank"}).df()


@query("SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1")
def list_item_groups(spark, d):
    return _priorities(spark, d).group_by({"field": "Priority.Value", "alias": "priority"}).select({"$count": "*", "alias": "n"})


@query("SELECT o_orderkey, o_orderpriority AS priority FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 50")
def list_item_order(spark, d):
    found = _priorities(spark, d).order([{"field": "Priority.Value", "dir": "desc"}, "o_orderkey"]).take(50)
    return found.select({"field": "o_orderkey", "alias": "o_orderkey"}, {"field": "Priority.Value", "alias": "priority"}).df()


@query("SELECT o_orderkey, o_orderdate FROM (SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 40 OFFSET 25) WHERE o_orderkey % 2 = 0")
def project_after_paging(spark, d):
    page = q(spark, d, "orders").order_by("o_orderdate").then_by("o_orderkey").skip(25).take(40)
    return page.select("o_orderkey", "o_orderdate").where(field("o_orderkey") % 2 == 0).order_by("o_orderkey").df()


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def project_distinct(spark, d):
    return q(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct().df()


@query("SELECT c_custkey, c_acctbal, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_acctbal DESC NULLS FIRST, c_custkey) AS rn FROM customer) WHERE rn = 1")
def distinct_by(spark, d):
    found = q(spark, d, "customer").order_by("c_acctbal", desc=True).then_by("c_custkey").distinct_by("c_mktsegment", "c_nationkey")
    return found.df().select("c_custkey", "c_acctbal", "c_mktsegment")


@query("SELECT count(*) AS n_distinct FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)")
def distinct_props(spark, d):
    o = view(spark, d, "orders").df.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    found = Query(View(o, {"id": "o_orderkey"}, None, "orders")).distinct()
    return _scalar_row(spark, n_distinct=found.count())


@query(f"WITH {_NODES} SELECT count(*) AS n FROM (SELECT DISTINCT parent_id, scheme_id, name FROM nodes)")
def distinct_base(spark, d):
    return _scalar_row(spark, n=Query(forest(spark, d)).distinct_base().count())


@query(f"{_NULLABLE} SELECT o_orderkey, paid AS \"Paid\" FROM o ORDER BY paid DESC NULLS LAST, o_orderkey LIMIT 20")
def order_nulls(spark, d):
    return _nullable(spark, d).order([{"field": "Paid", "dir": "desc", "nulls": "last"}, "o_orderkey"]).take(20).select("o_orderkey", "Paid").df()


@query(f"{_NULLABLE} SELECT o_orderkey, paid AS \"Paid\" FROM o ORDER BY paid DESC NULLS FIRST, o_orderkey LIMIT 20")
def order_nulls_default(spark, d):
    return _nullable(spark, d).order_by("Paid", desc=True).then_by("o_orderkey").take(20).select("o_orderkey", "Paid").df()


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice * (1 - l_discount) DESC, l_orderkey, l_linenumber, l_partkey LIMIT 30")
def order_by_expression(spark, d):
    value = field("l_extendedprice") * (const(1) - field("l_discount"))
    found = q(spark, d, "lineitem").order_by(value, desc=True).then_by("l_orderkey").then_by("l_linenumber").then_by("l_partkey").take(30)
    return found.df().select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("""SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS n, EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 1e9) AS any_rich,
(SELECT bool_and(o_totalprice > 0) FROM orders) AS all_paid, (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS first_key, 0::BIGINT AS n_taken""")
def terminals(spark, d):
    o = q(spark, d, "orders")
    return _scalar_row(
        spark,
        n=o.where({"o_orderstatus": "F"}).take(3).skip(1).count(),
        any_rich=o.any({"o_totalprice": {"$gt": 1e9}}),
        all_paid=o.all({"o_totalprice": {"$gt": 0}}),
        first_key=o.order_by("o_totalprice", desc=True).then_by("o_orderkey").first()["o_orderkey"],
        n_taken=len(o.take(0).to_list()),
    )


@query("SELECT o_orderkey FROM orders WHERE NOT (o_totalprice < 150000)")
def delete_by_filter(spark, d):
    return q(spark, d, "orders").where({"o_totalprice": {"$lt": 150000}}).remaining().select("o_orderkey")


# Scalar functions.


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(l_quantity), 6) AS a, round(pow(l_quantity, 1.5), 4) AS b, round(ln(l_extendedprice), 6) AS c,
round(log10(l_extendedprice), 6) AS e, round(ln(l_extendedprice) / ln(2), 6) AS f, abs(-l_quantity) AS g, floor(l_discount * 100)::BIGINT AS h, ceil(l_tax * 10)::BIGINT AS i,
round(exp(l_discount), 6) AS j, sign(l_tax - 0.04) AS k FROM lineitem""")
def functions_math(spark, d):
    x, p, dc, t = field("l_quantity"), field("l_extendedprice"), field("l_discount"), field("l_tax")
    made = {
        "a": call("round", call("sqrt", x), 6), "b": call("round", call("power", x, 1.5), 4), "c": call("round", call("ln", p), 6), "e": call("round", call("log10", p), 6),
        "f": call("round", call("log", 2.0, p), 6), "g": call("abs", -x), "h": call("floor", dc * 100), "i": call("ceil", t * 10), "j": call("round", call("exp", dc), 6),
        "k": call("sign", t - 0.04),
    }
    return _projected(q(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], made)


def _projected(found: Query, names: list[str], made: dict) -> DataFrame:
    return found.select(*names, *[{"$expr": v.tree, "alias": k} for k, v in made.items()]).df()


@query("""SELECT event_id, round(sin(value), 6) AS a, round(cos(value), 6) AS b, round(tan(value / 1000), 6) AS c, round(asin(value / 1000000), 6) AS e,
round(acos(value / 1000000), 6) AS f, round(atan(value), 6) AS g FROM events""")
def functions_trigonometry(spark, d):
    v = field("value")
    made = {"a": call("sin", v), "b": call("cos", v), "c": call("tan", v / 1000), "e": call("asin", v / 1000000), "f": call("acos", v / 1000000), "g": call("atan", v)}
    return _projected(q(spark, d, "events"), ["event_id"], {k: call("round", x, 6) for k, x in made.items()})


@query("""SELECT p_partkey, p_size // 7 AS a, p_size % 7 AS b, -p_size // 7 AS c, least(p_size, 10, 25) AS e, greatest(p_size, 10) AS f, p_size + p_partkey + 1 AS g,
p_size * 2 * 3 AS h FROM part""".replace("-p_size // 7", "-(p_size // 7)"))
def functions_integers(spark, d):
    s = field("p_size")
    made = {"a": s / 7, "b": s % 7, "c": (-s) / 7, "e": call("min", s, 10, 25), "f": call("max", s, 10), "g": call("add", s, field("p_partkey"), 1), "h": call("mul", s, 2, 3)}
    return _projected(q(spark, d, "part"), ["p_partkey"], made)


@query("""SELECT p_partkey, upper(p_name) AS a, lower(p_type) AS b, trim('  ' || p_brand || ' ') AS c, ltrim('  ' || p_brand) AS e, rtrim(p_brand || '  ') AS f,
length(p_name) AS g, p_brand || '/' || p_type AS h, substr(p_name, 2, 3) AS i, replace(p_type, 'E', 'ee') AS j, strpos(p_name, 'a') AS k,
CASE WHEN length(p_brand) >= 12 THEN p_brand ELSE lpad(p_brand, 12, '*') END AS l, CASE WHEN length(p_name) >= 5 THEN p_name ELSE rpad(p_name, 5, ' ') END AS m,
substr(p_name, 3) AS n FROM part""")
def functions_text(spark, d):
    n, t, b = field("p_name"), field("p_type"), field("p_brand")
    made = {
        "a": call("upper", n), "b": call("lower", t), "c": call("trim", call("concat", "  ", b, " ")), "e": call("trimStart", call("concat", "  ", b)),
        "f": call("trimEnd", b + "  "), "g": call("length", n), "h": call("concat", b, "/", t), "i": call("substring", n, 2, 3), "j": call("replace", t, "E", "ee"),
        "k": call("indexOf", n, "a"), "l": call("padLeft", b, 12, "*"), "m": call("padRight", n, 5), "n": call("substring", n, 3),
    }
    return _projected(q(spark, d, "part"), ["p_partkey"], made)


@query(r"""SELECT p_partkey, regexp_replace(p_type, '[AEIOU]', '_') AS a, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS b, regexp_replace(p_type, '([A-Z])([A-Z])', '\2\1', 'g') AS c,
regexp_replace(p_type, '([A-Z])([A-Z])', '\2\1') AS e FROM part""")
def functions_regex_replace(spark, d):
    t = field("p_type")
    made = {
        "a": call("regexReplace", t, "[AEIOU]", "_"), "b": call("regexReplace", t, "[AEIOU]", "_", "g"), "c": call("regexReplace", t, "([A-Z])([A-Z])", r"\2\1", "g"),
        "e": call("regexReplace", t, "([A-Z])([A-Z])", r"\2\1"),
    }
    return _projected(q(spark, d, "part"), ["p_partkey"], made)


@query("""SELECT event_id, year(ts) AS a, month(ts) AS b, day(ts) AS c, hour(ts) AS e, minute(ts) AS f, floor(extract('second' FROM ts))::BIGINT AS g, dayofweek(ts) AS h, dayofyear(ts) AS i FROM events""")
def functions_date_parts(spark, d):
    t = field("ts")
    made = {"a": call("year", t), "b": call("month", t), "c": call("day", t), "e": call("hour", t), "f": call("minute", t), "g": call("floor", call("second", t)), "h": call("dayOfWeek", t), "i": call("dayOfYear", t)}
    return _projected(q(spark, d, "events"), ["event_id"], made)


@query("""SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS a, o_orderdate - INTERVAL 10 DAY AS b, o_orderdate + INTERVAL 90 MINUTE AS c,
round((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1996-02-29 13:00:00')) / 86400000000.0)::BIGINT AS e, round((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1996-02-29 13:00:00')) / 604800000000.0)::BIGINT AS f,
date_trunc('month', o_orderdate)::TIMESTAMP AS g, date_trunc('year', o_orderdate)::TIMESTAMP AS h, make_timestamp((year(o_orderdate) // 10) * 10, 1, 1, 0, 0, 0) AS i,
make_timestamp(((year(o_orderdate) - 1) // 100) * 100 + 1, 1, 1, 0, 0, 0) AS j FROM orders""")
def functions_dates(spark, d):
    t = field("o_orderdate")
    made = {
        "a": call("dateAdd", "month", t, 1), "b": call("dateSub", "day", t, 10), "c": call("dateAdd", "minute", t, 90), "e": call("dateDiff", "day", t, "1996-02-29 13:00:00"),
        "f": call("dateDiff", "week", t, "1996-02-29 13:00:00"), "g": call("dateTrunc", "month", t), "h": call("dateTrunc", "year", t), "i": call("dateTrunc", "decade", t),
        "j": call("dateTrunc", "century", t),
    }
    return _projected(q(spark, d, "orders"), ["o_orderkey"], made)


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS a, CASE WHEN o_orderstatus = 'P' THEN 1 END AS b,
coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, 'none') AS c, CAST(o_custkey AS VARCHAR) AS e, CAST(o_totalprice AS BIGINT) AS f, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'done' END AS g
FROM orders""")
def functions_conditional(spark, d):
    p, s = field("o_totalprice"), field("o_orderstatus")
    case = call("case", {"when": (p > 200000).tree, "then": "high"}, {"when": (p > 100000).tree, "then": "mid"}, {"else": "low"})
    made = {
        "a": case, "b": call("case", {"when": (s == "P").tree, "then": 1}), "c": when(s == "F", field("o_orderpriority")).or_else("none"), "e": call("cast", "text", field("o_custkey")),
        "f": call("cast", "bigint", p), "g": when(s == "O", "open", "done"),
    }
    return _projected(q(spark, d, "orders"), ["o_orderkey"], made)


@query("""SELECT o_orderkey, year(age(o_orderdate, t)) * 12 + month(age(o_orderdate, t)) AS a, year(age(o_orderdate, t)) AS b, year(age(t, o_orderdate)) * 12 + month(age(t, o_orderdate)) AS c,
year(age(o_orderdate, u)) * 12 + month(age(o_orderdate, u)) AS e FROM (SELECT o_orderkey, o_orderdate::TIMESTAMP AS o_orderdate, TIMESTAMP '1996-01-31 12:00:00' AS t, TIMESTAMP '1995-02-28 00:00:00' AS u FROM orders)""")
def date_diff_months(spark, d):
    t, at = field("o_orderdate"), "1996-01-31 12:00:00"
    made = {"a": call("dateDiff", "month", t, at), "b": call("dateDiff", "year", t, at), "c": call("dateDiff", "month", at, t), "e": call("dateDiff", "month", t, "1995-02-28 00:00:00")}
    return _projected(q(spark, d, "orders"), ["o_orderkey"], made)


@query("""SELECT l_orderkey, l_linenumber, CAST(l_extendedprice / 4 AS BIGINT) AS a, CAST(CAST(l_linenumber / 2.0 AS DOUBLE) AS INTEGER) AS b, CAST(round(CAST(l_linenumber AS DECIMAL(10,1)) / 2, 0) AS BIGINT) AS c,
CAST(-l_linenumber / 2.0::DOUBLE AS SMALLINT) AS e FROM lineitem""")
def cast_rounds(spark, d):
    n = field("l_linenumber")
    made = {"a": call("cast", "bigint", field("l_extendedprice") / 4), "b": call("cast", "int", n / 2.0), "c": call("cast", "bigint", call("cast", "numeric", n) / 2), "e": call("cast", "smallint", -(n / 2.0))}
    return _projected(q(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], made)


# Aggregates and groups.


@query("""SELECT count(*) AS n, count(paid) AS n_paid, count(DISTINCT o_custkey) AS n_cust, round(sum(paid), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS low, max(o_orderdate) AS last,
count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent, bool_and(o_totalprice > 0) AS all_pos, bool_or(o_totalprice > 400000) AS any_big FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS paid FROM orders)""")
def aggregate_batch(spark, d):
    out = _nullable(spark, d).aggregate(
        {"$count": "*", "alias": "n"}, {"$count": "Paid", "alias": "n_paid"}, {"$count": "o_custkey", "distinct": True, "alias": "n_cust"}, {"$sum": "Paid", "alias": "total"},
        {"$avg": "o_totalprice", "alias": "mean"}, {"$min": "o_totalprice", "alias": "low"}, {"$max": "o_orderdate", "alias": "last"},
        {"$count": "*", "filter": {"o_orderpriority": "1-URGENT"}, "alias": "n_urgent"}, {"$bool_and": {"$gt": [{"$field": "o_totalprice"}, 0]}, "alias": "all_pos"},
        {"$bool_or": (field("o_totalprice") > 400000).tree, "alias": "any_big"},
    )
    return out.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})


@query("SELECT round(sum(c_acctbal), 2) AS sum, round(avg(c_acctbal), 4) AS average, min(c_acctbal) AS min, max(c_acctbal) AS max, count(c_acctbal) AS count FROM customer WHERE c_mktsegment = 'BUILDING'")
def aggregate_statistics(spark, d):
    out = q(spark, d, "customer").where({"c_mktsegment": "BUILDING"}).statistics("c_acctbal")
    return out.withColumns({"sum": F.round("sum", 2), "average": F.round("average", 4)})


@query("""SELECT coalesce(sum(p_size) FILTER (WHERE p_size < -1), 0)::BIGINT AS sum_none, coalesce(avg(p_size) FILTER (WHERE p_size < -1), 0)::BIGINT AS avg_none, min(p_size) FILTER (WHERE p_size < -1) IS NULL AS min_is_null,
max(p_size)::BIGINT AS max_size, min(p_size)::BIGINT AS min_size, sum(p_size)::BIGINT AS total, round(avg(p_size), 6) AS mean FROM part""")
def aggregate_terminals(spark, d):
    p = q(spark, d, "part")
    none = p.where({"p_size": {"$lt": -1}})
    return _scalar_row(
        spark, sum_none=int(none.sum("p_size")), avg_none=int(none.average("p_size")), min_is_null=none.min("p_size") is None, max_size=int(p.max("p_size")), min_size=int(p.min("p_size")),
        total=int(p.sum("p_size")), mean=round(float(p.average("p_size")), 6),
    )


@query(f"WITH {_NODES} SELECT sum(id)::BIGINT AS total, round(avg(id), 3) AS mean, min(name) AS low, max(id)::BIGINT AS high FROM nodes WHERE scheme_id = 3")
def aggregate_base_terminals(spark, d):
    c = tq(spark, d, 3)
    return _scalar_row(spark, total=int(c.sum("0$:Id")), mean=round(float(c.average("0$:Id")), 3), low=c.min("0$:Name"), high=int(c.max("0$:Id")))


@query("SELECT sum(DISTINCT p_size)::BIGINT AS s, round(avg(DISTINCT p_size), 6) AS a, count(DISTINCT p_brand) AS n FROM part")
def aggregate_distinct(spark, d):
    size = {"$field": "p_size"}
    out = q(spark, d, "part").aggregate({"$sum": size, "distinct": True, "alias": "s"}, {"$avg": size, "distinct": True, "alias": "a"}, {"$count": {"$field": "p_brand"}, "distinct": True, "alias": "n"})
    return out.withColumn("a", F.round("a", 6))


@query("""SELECT o_orderstatus, list_aggregate(list_sort(list(DISTINCT o_orderpriority)), 'string_agg', ',') AS priorities FROM orders GROUP BY 1""")
def aggregate_text(spark, d):
    out = q(spark, d, "orders").group_by("o_orderstatus").select({"$string_agg": [{"$field": "o_orderpriority"}, ","], "distinct": True, "alias": "priorities"})
    return out.withColumn("priorities", F.array_join(F.array_sort(F.split("priorities", ",")), ","))


@query("SELECT sum(l_linenumber)::BIGINT AS total, count(*) AS n, min(l_linenumber) AS low, max(l_linenumber) AS high, round(avg(l_linenumber), 6) AS mean, (SELECT round(avg(x), 6) FROM (SELECT min(l_linenumber) AS x FROM lineitem GROUP BY l_orderkey)) AS first_mean FROM lineitem")
def aggregate_arrays(spark, d):
    out = _flags(spark, d).aggregate(
        {"$sum": "Numbers", "alias": "total"}, {"$count": "Numbers", "alias": "n"}, {"$min": "Numbers", "alias": "low"}, {"$max": "Numbers", "alias": "high"}, {"$avg": "Numbers", "alias": "mean"},
        {"$avg": "Numbers[0]", "alias": "first_mean"},
    )
    return out.withColumns({"mean": F.round("mean", 6), "first_mean": F.round("first_mean", 6)})


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def group_by_keys(spark, d):
    net = field("l_extendedprice") * (const(1) - field("l_discount"))
    out = q(spark, d, "lineitem").where({"l_shipdate": {"$lte": "1998-09-02"}}).group_by("l_returnflag", "l_linestatus").select(
        {"$sum": "l_quantity", "alias": "sum_qty"}, {"$sum": "l_extendedprice", "alias": "sum_base"}, {"$sum": net.tree, "alias": "sum_disc"}, {"$avg": "l_quantity", "alias": "avg_qty"}, {"$count": "*", "alias": "n"}
    )
    return out.withColumns({"sum_base": F.round("sum_base", 2), "sum_disc": F.round("sum_disc", 2), "avg_qty": F.round("avg_qty", 6)})


@query("""SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING (count(*) > 12 OR max(o_totalprice) > 450000) AND NOT (min(o_totalprice) < 2000)""")
def group_having(spark, d):
    having = {"$and": [{"$or": [{"$gt": [{"$count": "*"}, 12]}, {"$gt": [{"$max": "o_totalprice"}, 450000]}]}, {"$not": {"$lt": [{"$min": "o_totalprice"}, 2000]}}]}
    return q(spark, d, "orders").group_by("o_custkey").having(having).select({"$count": "*", "alias": "n"})


@query("SELECT year(o_orderdate) AS y, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY n DESC, y, o_orderpriority LIMIT 10 OFFSET 3")
def group_by_expression(spark, d):
    g = q(spark, d, "orders").group_by({"$expr": call("year", field("o_orderdate")).tree, "alias": "y"}, "o_orderpriority")
    return g.order({"field": "n", "dir": "desc"}, "y", "o_orderpriority").skip(3).take(10).select({"$count": "*", "alias": "n"})


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)) AS n_groups, (SELECT count(*) FROM orders) AS n_all")
def group_counts(spark, d):
    o = q(spark, d, "orders")
    return _scalar_row(spark, n_groups=o.group_by("o_custkey", "o_orderstatus").count(), n_all=o.group_by().select({"$count": "*", "alias": "n"}).first()["n"])


@query("""SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS qty, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1""")
def group_by_array(spark, d):
    out = Query(orders_with_lines(spark, d)).group_by_array("Lines", "l_returnflag").select({"$count": "*", "alias": "n"}, {"$sum": "l_quantity", "alias": "qty"}, {"$avg": "l_extendedprice", "alias": "mean"})
    return out.withColumn("mean", F.round("mean", 4))


@query("""SELECT l_returnflag, l_linenumber, count(*) AS n, max(l_quantity) AS top FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 100000 GROUP BY 1, 2 HAVING count(*) > 20
ORDER BY n DESC, l_returnflag, l_linenumber LIMIT 8""")
def group_by_array_having(spark, d):
    g = Query(orders_with_lines(spark, d)).where({"o_totalprice": {"$gt": 100000}}).group_by_array("Lines", "l_returnflag", "l_linenumber").having({"$gt": [{"$count": "*"}, 20]})
    return g.order({"field": "n", "dir": "desc"}, "l_returnflag", "l_linenumber").take(8).select({"$count": "*", "alias": "n"}, {"$max": "l_quantity", "alias": "top"})


@query("""SELECT c_mktsegment, c_nationkey, n, rank() OVER (PARTITION BY c_mktsegment ORDER BY n DESC) AS place, sum(n) OVER (PARTITION BY c_mktsegment)::BIGINT AS segment_n
FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2)""")
def group_window(spark, d):
    g = q(spark, d, "customer").group_by("c_mktsegment", "c_nationkey")
    w = g.with_window({"partition_by": ["c_mktsegment"]}, {"$count": "*", "alias": "n"})
    return w.select("c_mktsegment", "c_nationkey", "n", {"func": "rank", "order_by": [{"field": "n", "dir": "desc"}], "alias": "place"}, {"func": "sum", "args": ["n"], "alias": "segment_n"})


@query("SELECT o_custkey, list_aggregate(list_sort(list(DISTINCT o_orderpriority)), 'string_agg', ',') AS priorities FROM orders GROUP BY 1 HAVING bool_or(o_orderpriority = '1-URGENT')")
def list_item_arrays(spark, d):
    """Customers with an array of list items, those of an urgent one."""
    items = lists.items(view(spark, d, "orders").df, "o_orderpriority")
    coded = view(spark, d, "orders").df.join(F.broadcast(items), F.col("o_orderpriority") == F.col("value")).groupBy("o_custkey").agg(F.array_sort(F.collect_set("id")).alias("Priorities"))
    found = Query(View(lists.with_items(coded, "Priorities", items), {"id": "o_custkey"}, None, "customers")).where({"Priorities[].Value": "1-URGENT"}).df()
    return found.select("o_custkey", F.array_join(F.transform("Priorities", lambda x: x["Value"]), ",").alias("priorities"))


@query(f"WITH {_NODES}, g AS (SELECT c.parent_id, count(*) AS n FROM nodes c JOIN nodes n ON c.parent_id = n.id WHERE c.scheme_id = 3 AND n.parent_id IN (1, 2) GROUP BY 1) SELECT parent_id, n, rank() OVER (ORDER BY n DESC) AS place FROM g")
def tree_group_window(spark, d):
    g = tq(spark, d, 3).where_descendants_of(1, 2).group_by({"field": "0$:ParentId", "alias": "parent_id"})
    w = g.with_window({}, {"$count": "*", "alias": "n"})
    return w.select("parent_id", "n", {"func": "rank", "order_by": [{"field": "n", "dir": "desc"}], "alias": "place"})


@query("SELECT count(DISTINCT o_orderstatus) AS n, (SELECT count(*) FROM orders WHERE o_totalprice > 300000) AS n_rows, (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS top FROM orders")
def project_terminals(spark, d):
    o = q(spark, d, "orders")
    rich = o.where({"o_totalprice": {"$gt": 300000}}).select("o_orderkey")
    top = o.order_by("o_totalprice", desc=True).then_by("o_orderkey").select("o_orderkey").first()
    return _scalar_row(spark, n=o.select("o_orderstatus").distinct().count(), n_rows=rich.count(), top=top["o_orderkey"])


# Windows.

_BY_CUSTOMER = {"partition_by": ["o_custkey"], "order_by": ["o_orderdate", "o_orderkey"]}
_W = "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


@query(f"""SELECT o_orderkey, row_number() OVER {_W}) AS a, rank() OVER {_W}) AS b, dense_rank() OVER {_W}) AS c, ntile(3) OVER {_W}) AS e,
round(percent_rank() OVER {_W}), 6) AS f, round(cume_dist() OVER {_W}), 6) AS g FROM orders""")
def window_ranking(spark, d):
    w = q(spark, d, "orders").with_window(_BY_CUSTOMER)
    out = w.select("o_orderkey", *[{"func": f, "alias": a, "args": [3] if f == "ntile" else []} for a, f in zip("abcefg", ["row_number", "rank", "dense_rank", "ntile", "percent_rank", "cume_dist"], strict=True)])
    return out.withColumns({"f": F.round("f", 6), "g": F.round("g", 6)})


@query(f"""SELECT o_orderkey, lag(o_totalprice) OVER {_W}) AS a, lead(o_totalprice, 2, 0) OVER {_W}) AS b, first_value(o_orderkey) OVER {_W}) AS c, last_value(o_orderkey) OVER {_W}) AS e,
nth_value(o_orderkey, 2) OVER {_W}) AS f FROM orders""")
def window_values(spark, d):
    w = q(spark, d, "orders").with_window(_BY_CUSTOMER)
    return w.select("o_orderkey", {"func": "lag", "args": ["o_totalprice"], "alias": "a"}, {"func": "lead", "args": ["o_totalprice", 2, 0.0], "alias": "b"}, {"func": "first_value", "args": ["o_orderkey"], "alias": "c"},
        {"func": "last_value", "args": ["o_orderkey"], "alias": "e"}, {"func": "nth_value", "args": ["o_orderkey", 2], "alias": "f"})


@query(f"""SELECT o_orderkey, sum(round(o_totalprice)) OVER {_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS a, round(avg(round(o_totalprice)) OVER {_W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS b,
count(*) OVER {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c, max(o_totalprice) OVER {_W}) AS e,
count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS f FROM orders""")
def window_frames(spark, d):
    whole = call("round", field("o_totalprice"))  # whole numbers add up alike in any order
    w = q(spark, d, "orders").with_window(_BY_CUSTOMER)
    out = w.select(
        "o_orderkey",
        {"func": "sum", "args": [whole], "frame": Frame.rows(2), "alias": "a"},
        {"func": "avg", "args": [whole], "frame": Frame.rows(1).and_following(1), "alias": "b"},
        {"func": "count", "args": ["*"], "frame": Frame.rows().unbounded_preceding().and_unbounded_following(), "alias": "c"},
        {"func": "max", "args": ["o_totalprice"], "alias": "e"},
        {"func": "count", "args": ["*"], "filter": {"o_orderstatus": "F"}, "order_by": [], "alias": "f"},
    )
    return out.withColumn("b", F.round("b", 4))


@query("""SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS a, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)::BIGINT AS b FROM part""")
def window_range_groups(spark, d):
    w = q(spark, d, "part").with_window({"partition_by": ["p_brand"], "order_by": ["p_size"]})
    return w.select("p_partkey", {"func": "count", "args": ["*"], "frame": Frame.range().preceding(2).and_following(1), "alias": "a"}, {"func": "sum", "args": ["p_size"], "frame": Frame.groups().preceding(1).and_following(1), "alias": "b"})


_X = "OVER (PARTITION BY p_brand, p_type ORDER BY p_size {mode} BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE {what})"


@query(f"""SELECT p_partkey, coalesce(sum(p_size) OVER (PARTITION BY p_brand, p_type ORDER BY p_size, p_partkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW), 0)::BIGINT AS a,
count(*) {_X.format(mode="GROUPS", what="GROUP")} AS b, count(*) {_X.format(mode="RANGE", what="TIES")} AS c FROM part""")
def window_exclude(spark, d):
    base = {"partition_by": ["p_brand", "p_type"]}
    both = {"preceding": 2}, {"following": 2}
    w = q(spark, d, "part").with_window(base)
    out = w.select(
        "p_partkey",
        {"func": "sum", "args": ["p_size"], "order_by": ["p_size", "p_partkey"], "frame": {"mode": "rows", "start": both[0], "end": both[1], "exclude": "current_row"}, "alias": "a"},
        {"func": "count", "args": ["*"], "order_by": ["p_size"], "frame": {"mode": "groups", "start": both[0], "end": both[1], "exclude": "group"}, "alias": "b"},
        {"func": "count", "args": ["*"], "order_by": ["p_size"], "frame": {"mode": "range", "start": both[0], "end": both[1], "exclude": "ties"}, "alias": "c"},
    )
    return out.withColumn("a", F.coalesce("a", F.lit(0)).cast("long"))


@query("SELECT c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) ORDER BY rn, c_custkey LIMIT 25")
def window_in_order(spark, d):
    place = {"$over": {"func": "row_number", "partition_by": ["c_nationkey"], "order_by": [{"field": "c_acctbal", "dir": "desc"}, "c_custkey"]}}
    c = q(spark, d, "customer")
    df = c.view.df.withColumn("rn", c.compiler().scalar(place))
    return Query(c.view.with_df(df)).order_by("rn").then_by("c_custkey").take(25).df().select("c_custkey", "c_acctbal")


@query("SELECT r_regionkey, row_number() OVER (ORDER BY r_regionkey) AS n FROM region")
def window_without_order(spark, d):
    return q(spark, d, "region").with_window().select("r_regionkey", {"func": "row_number", "alias": "n"})


# Trees.


@query(f"WITH {_NODES} SELECT id, name FROM nodes WHERE parent_id IS NULL")
def tree_roots(spark, d):
    return tq(spark, d).where_roots().df().select("id", "name")


@query(f"WITH {_NODES} SELECT id, scheme_id FROM nodes WHERE id NOT IN (SELECT parent_id FROM nodes WHERE parent_id IS NOT NULL) ")
def tree_leaves(spark, d):
    return tq(spark, d).where_leaves().df().select("id", "scheme_id")


@query(f"{_PATHS} SELECT n.id, n.name FROM nodes n JOIN paths p USING (id) WHERE level >= 1 AND level < 3")
def tree_level(spark, d):
    return tq(spark, d).where_level({"$gte": 1, "$lt": 3}).df().select("id", "name")


@query(f"WITH {_NODES} SELECT id, name FROM nodes WHERE parent_id IN (1, 3)")
def tree_children(spark, d):
    return tq(spark, d).where_children_of(1, 3).df().select("id", "name")


@query(f"{_PATHS} SELECT n.id, n.scheme_id FROM nodes n JOIN paths p USING (id) WHERE root = 2 AND level BETWEEN 1 AND 2")
def tree_descendants(spark, d):
    return tq(spark, d).where_descendants_of(2, max_depth=2).df().select("id", "scheme_id")


@query(f"{_PATHS} SELECT n.id FROM nodes n JOIN paths p USING (id) WHERE root = 2 AND scheme_id = 4 AND n.\"Value\" > 300000")
def tree_descendants_of_scheme(spark, d):
    return tq(spark, d, 4).where_descendants_of(2).where({"Value": {"$gt": 300000}}).df().select("id")


@query(f"{_PATHS} SELECT id, name FROM nodes WHERE id IN (SELECT unnest(path) FROM paths WHERE id IN (SELECT min(id) FROM nodes WHERE scheme_id = 4)) AND scheme_id < 4")
def tree_ancestors(spark, d):
    whole = forest(spark, d)
    node = whole.df.where("scheme_id = 4").agg(F.min("id")).first()[0]
    return tq(spark, d).where_ancestors_of(node).df().select("id", "name")


@query(f"WITH {_NODES} SELECT o.id FROM nodes o JOIN nodes c ON o.parent_id = c.id JOIN nodes n ON c.parent_id = n.id WHERE o.scheme_id = 4 AND n.name LIKE '%A%' AND o.\"Value\" > 200000")
def tree_has_ancestor(spark, d):
    whole = forest(spark, d)
    return tq(spark, d, 4).where_has_ancestor({"0$:Name": {"$like": "%A%"}}, of_scheme(whole, 2)).where({"Value": {"$gt": 200000}}).df().select("id")


@query(f"WITH {_NODES} SELECT DISTINCT c.id FROM nodes o JOIN nodes c ON o.parent_id = c.id WHERE o.scheme_id = 4 AND o.\"Value\" > 350000")
def tree_has_descendant(spark, d):
    whole = forest(spark, d)
    return tq(spark, d, 3).where_has_descendant({"Value": {"$gt": 350000}}, of_scheme(whole, 4)).df().select("id")


@query(f"""{_PATHS}, has AS (SELECT DISTINCT c.id FROM nodes o JOIN nodes c ON o.parent_id = c.id WHERE o.scheme_id = 4 AND o."Value" > 450000)
SELECT n.id, n.scheme_id FROM nodes n JOIN paths p USING (id) WHERE n.scheme_id < 4 AND (n.parent_id IS NULL OR level = 2 AND n.id IN (FROM has) OR n.parent_id = 3 OR n.scheme_id = 3 AND n.id NOT IN (SELECT parent_id FROM nodes WHERE parent_id IS NOT NULL) AND root = 1)""")
def tree_operators_in_filters(spark, d):
    """Tree operators anywhere in a filter."""
    f = {"$or": [
        {"$isRoot": True},
        {"$level": 2, "$hasDescendant": {"$and": [{"0$:SchemeId": 4}, {"Value": {"$gt": 450000}}]}},
        {"$childrenOf": 3},
        {"$and": [{"0$:SchemeId": 3}, {"$isLeaf": True}, {"$descendantsOf": 1}]},
    ]}
    return tq(spark, d).where({"0$:SchemeId": {"$lt": 4}}).where(f).df().select("id", "scheme_id")


@query(f"{_PATHS} SELECT id, scheme_id FROM nodes WHERE id IN (SELECT unnest(path) FROM paths JOIN nodes USING (id) WHERE scheme_id = 4 AND \"Value\" > 400000)")
def tree_list(spark, d):
    return tq(spark, d, 4).where({"Value": {"$gt": 400000}}).with_ancestors().select("id", "scheme_id")


@query(f"{_PATHS} SELECT id, name FROM nodes WHERE id IN (SELECT root FROM paths JOIN nodes USING (id) WHERE scheme_id = 4 AND \"Value\" > 400000)")
def tree_root_list(spark, d):
    return tq(spark, d, 4).where({"Value": {"$gt": 400000}}).root_list().select("id", "name")


@query(f"{_PATHS} SELECT id, name FROM nodes WHERE id IN (SELECT unnest(path) FROM paths WHERE id = (SELECT max(id) FROM nodes WHERE scheme_id = 3))")
def tree_path_to_root(spark, d):
    whole = forest(spark, d)
    node = whole.df.where("scheme_id = 3").agg(F.max("id")).first()[0]
    return tree.path_to_root(whole, node).select("id", "name")


@query(f"{_PATHS}, crumbs AS (SELECT p.id, string_agg(m.name, ' > ' ORDER BY q.level) AS breadcrumbs FROM paths p JOIN paths q ON list_contains(p.path, q.id) JOIN nodes m ON m.id = q.id GROUP BY p.id) SELECT c.id, p.level, c.breadcrumbs FROM crumbs c JOIN paths p USING (id)")
def tree_breadcrumbs(spark, d):
    return tree.flattened(forest(spark, d), "name", "breadth_first").select("id", "level", "breadcrumbs")


@query(f"{_PATHS} SELECT a AS id, count(*) AS subtree_size, max(level) - min(level) AS height FROM (SELECT unnest(path) AS a, level FROM paths) GROUP BY a")
def tree_subtree_sizes(spark, d):
    return tree.subtree_sizes(forest(spark, d))


@query(f"""{_PATHS} SELECT (SELECT count(*) FROM nodes) AS total, (SELECT count(*) FROM nodes WHERE parent_id IS NULL) AS roots, (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT parent_id FROM nodes WHERE parent_id IS NOT NULL)) AS leaves,
0::BIGINT AS orphans, (SELECT max(level) FROM paths) AS max_depth, (SELECT round(avg(n), 6) FROM (SELECT count(*) AS n FROM nodes WHERE parent_id IS NOT NULL GROUP BY parent_id)) AS avg_children""")
def tree_statistics(spark, d):
    return tree.statistics(forest(spark, d)).withColumn("avg_children", F.round("avg_children", 6))


@query(f"""WITH {_NODES}, broken AS (SELECT id, CASE WHEN id % 1000 = 7 THEN id WHEN id % 1000 = 8 THEN -id ELSE parent_id END AS parent_id FROM nodes UNION ALL SELECT id, parent_id FROM nodes WHERE id % 1000 = 9)
SELECT id, 'duplicate id' AS problem FROM broken GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'missing parent' FROM broken WHERE parent_id NOT IN (SELECT id FROM broken) UNION ALL SELECT id, 'own parent' FROM broken WHERE id = parent_id""")
def tree_integrity(spark, d):
    whole = forest(spark, d)
    last = F.pmod("id", F.lit(1000))
    parent = F.when(last == 7, F.col("id")).when(last == 8, -F.col("id")).otherwise(F.col("parent_id"))
    broken = whole.df.withColumn("parent_id", parent).union(whole.df.where(last == 9))
    return tree.integrity_errors(whole.with_df(broken))


@query(f"WITH {_NODES} SELECT c.parent_id, count(*) AS n, round(avg(c.\"Value\"), 4) AS mean FROM nodes c JOIN nodes n ON c.parent_id = n.id WHERE c.scheme_id = 3 AND n.parent_id = 1 GROUP BY 1")
def tree_group_by(spark, d):
    out = tq(spark, d, 3).where_descendants_of(1).group_by("0$:ParentId").select({"$count": "*", "alias": "n"}, {"$avg": "Value", "alias": "mean"})
    return out.select(F.col("`0$:ParentId`").alias("parent_id"), "n", F.round("mean", 4).alias("mean"))


@query(f"WITH {_NODES} SELECT c.id, row_number() OVER (PARTITION BY c.parent_id ORDER BY c.\"Value\" DESC, c.id) AS place FROM nodes c JOIN nodes n ON c.parent_id = n.id WHERE c.scheme_id = 3 AND n.parent_id = 1")
def tree_window(spark, d):
    w = tq(spark, d, 3).where_descendants_of(1).with_window({"partition_by": ["0$:ParentId"], "order_by": [{"field": "Value", "dir": "desc"}, "0$:Id"]})
    return w.select({"field": "0$:Id", "alias": "id"}, {"func": "row_number", "alias": "place"})


@query(f"WITH {_NODES} SELECT id, CASE WHEN id = 1000 THEN 3 ELSE parent_id END AS parent_id FROM nodes")
def tree_move(spark, d):
    return tree.move(forest(spark, d), 1000, 3).select("id", "parent_id")


@query(f"{_PATHS} SELECT id FROM paths WHERE NOT list_contains(path, 1000)")
def tree_delete_subtree(spark, d):
    return tree.without_subtree(forest(spark, d), 1000).select("id")


@query(f"WITH {_NODES} SELECT id, parent_id, name FROM nodes UNION ALL SELECT -5, 1003, 'new'")
def tree_create_child(spark, d):
    return tree.create_child(forest(spark, d), 1003, {"id": -5, "name": "new", "scheme_id": 3}).select("id", "parent_id", "name")


@query(f"{_PATHS}, ends AS (SELECT id, level, path, row_number() OVER (ORDER BY list_concat(path, [9223372036854775807])) AS place FROM paths) SELECT id, place FROM ends")
def tree_post_order(spark, d):
    return tree.places(forest(spark, d), "post_order")


@query(f"WITH {_NODES} SELECT id FROM nodes WHERE scheme_id = 3 AND parent_id IN (1000, 1003)")
def tree_own_scheme(spark, d):
    """Customers below two nations through customers only, so without orders, and none below a region."""
    three = tq(spark, d, 3)
    below = three.where_descendants_of(1000, 1003, polymorphic=False).df().select("id")
    return below.union(three.where_descendants_of(1, 2, polymorphic=False).df().select("id"))


@query(f"{_PATHS} SELECT n.id, p.level - 1 AS depth, coalesce(c.n, 0)::BIGINT AS n_children FROM nodes n JOIN paths p USING (id) LEFT JOIN (SELECT parent_id, count(*) AS n FROM nodes WHERE scheme_id < 4 GROUP BY 1) c ON c.parent_id = n.id AND p.level < 3 WHERE list_contains(path, 1003) AND p.level <= 2")
def tree_load(spark, d):
    return tree.load_tree(forest(spark, d), 1003, 1).select("id", F.col("depth").cast("long").alias("depth"), F.size("children").cast("long").alias("n_children"))


@query(f"WITH {_NODES} SELECT scheme_id, count(*) AS n, min(id) AS low, max(name) AS last FROM nodes GROUP BY 1")
def group_by_base_column(spark, d):
    out = Query(forest(spark, d)).group_by("0$:SchemeId").select({"$count": "*", "alias": "n"}, {"$min": "0$:Id", "alias": "low"}, {"$max": "0$:Name", "alias": "last"})
    return out.withColumnRenamed("0$:SchemeId", "scheme_id")


# Sources, storage and services.


def _graph(spark, d) -> tuple[graph.Store, graph.References]:
    """Orders that refer to customers, those to nations, those to regions; and nations that list their customers, and map them by segment."""
    c = view(spark, d, "customer")
    first = c.df.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("first"))
    first = first.groupBy("c_nationkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("c_mktsegment", "first")))).alias("First"))
    rich = c.df.where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c_custkey")).alias("Rich"))
    n = view(spark, d, "nation")
    groups = n.df.select("n_nationkey", "n_name").join(first, F.col("n_nationkey") == first["c_nationkey"], "left").drop("c_nationkey").join(rich, F.col("n_nationkey") == rich["c_nationkey"], "left").drop("c_nationkey")
    store = {name: view(spark, d, name) for name in ("orders", "customer", "nation", "region")} | {"groups": View(groups, {"id": "n_nationkey"}, None, "groups")}
    return store, {"orders": {"o_custkey": "customer"}, "customer": {"c_nationkey": "nation"}, "nation": {"n_regionkey": "region"}, "groups": {"Rich": "customer", "First": "customer"}}


@query("""SELECT o_orderkey, c_name AS customer, n_name AS nation, r_name AS region, true AS shallow FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 300000""")
def load_graph(spark, d):
    store, references = _graph(spark, d)
    rows = store["orders"].df.where("o_totalprice > 300000")
    deep = graph.load_graph(store, references, "orders", rows, 10)
    shallow = graph.load_graph(store, references, "orders", rows, 1).schema["o_custkey"].dataType.names == ["c_custkey"]
    return deep.select("o_orderkey", F.col("o_custkey.c_name").alias("customer"), "o_custkey.c_nationkey.n_name", F.col("o_custkey.c_nationkey.n_regionkey.r_name").alias("region"), F.lit(shallow).alias("shallow")).withColumnRenamed("n_name", "nation")


@query("""SELECT n_nationkey, coalesce(rich, '') AS rich, segments FROM nation LEFT JOIN (SELECT c_nationkey, string_agg(c_name, ',' ORDER BY c_custkey) AS rich FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a ON a.c_nationkey = n_nationkey
LEFT JOIN (SELECT c_nationkey, string_agg(c_mktsegment || '=' || low, ',' ORDER BY c_mktsegment) AS segments FROM (SELECT c_nationkey, c_mktsegment, arg_min(c_name, c_custkey) AS low FROM customer GROUP BY 1, 2) GROUP BY 1) b ON b.c_nationkey = n_nationkey""")
def load_graph_arrays_and_maps(spark, d):
    store, references = _graph(spark, d)
    out = graph.load_graph(store, references, "groups", depth=2)
    pairs = F.transform(F.map_entries("First"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["c_name"]))
    return out.select("n_nationkey", F.coalesce(F.array_join(F.transform("Rich", lambda x: x["c_name"]), ","), F.lit("")).alias("rich"), F.array_join(pairs, ",").alias("segments"))


@query("""SELECT o_orderkey, c_name AS customer, r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 300000""")
def graph_json(spark, d):
    """Objects with those that they refer to as JSON, and read from it."""
    store, references = _graph(spark, d)
    deep = graph.load_graph(store, references, "orders", store["orders"].df.where("o_totalprice > 300000"))
    text = objects.graph_to_json(deep, "o_orderkey")
    return text.select("o_orderkey", F.get_json_object("json", "$.o_custkey.c_name").alias("customer"), F.get_json_object("json", "$.o_custkey.c_nationkey.n_regionkey.r_name").alias("region"))


@query("SELECT n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS name, n_regionkey AS region FROM nation")
def save_from_json(spark, d):
    """Nations with their regions read from JSON, and saved."""
    store, references = _graph(spark, d)
    deep = graph.load_graph(store, references, "nation", store["nation"].df.where("n_regionkey = 1"))
    text = objects.graph_to_json(deep.withColumn("n_name", F.lower("n_name")), "n_nationkey")
    saved = graph.save_graph(store, references, "nation", objects.from_json(text, "json", deep.schema), missing="error")
    return saved["nation"].select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))


@query("""SELECT 'customer' AS scheme, c_custkey AS id, upper(c_name) AS name, c_nationkey AS up FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT 'customer', c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 10 <> 0
UNION ALL SELECT 'nation', n_nationkey, CASE WHEN n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 10 = 0) THEN lower(n_name) ELSE n_name END, n_regionkey FROM nation
UNION ALL SELECT 'customer', (SELECT max(c_custkey) FROM customer) + 1, 'new', (SELECT max(n_nationkey) FROM nation) + 1 UNION ALL SELECT 'nation', (SELECT max(n_nationkey) FROM nation) + 1, 'new nation', 1""")
def save_graph(spark, d):
    """Customers with changed names saved with their changed nations, and one of a new nation, both without ids."""
    store, references = _graph(spark, d)
    references = {"customer": {"c_nationkey": "nation"}}
    found = graph.load_graph(store, references, "customer", store["customer"].df.where("c_custkey % 10 = 0"))
    found = found.withColumn("c_name", F.upper("c_name")).withColumn("c_nationkey", F.col("c_nationkey").withField("n_name", F.lower("c_nationkey.n_name")))
    kind = found.schema
    nation = {f.name: None for f in kind["c_nationkey"].dataType.fields} | {"n_name": "new nation", "n_regionkey": 1}
    new = {f.name: None for f in kind.fields} | {"c_name": "new", "c_nationkey": nation}
    saved = graph.save_graph(store, references, "customer", found.union(spark.createDataFrame([new], T.StructType([T.StructField(f.name, f.dataType) for f in kind.fields]))))
    c = saved["customer"].select(F.lit("customer").alias("scheme"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("up"))
    return c.union(saved["nation"].select(F.lit("nation"), "n_nationkey", "n_name", "n_regionkey"))


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def reference_load(spark, d):
    o = q(spark, d, "orders").where({"o_totalprice": {"$gt": 300000}}).df()
    out = objects.with_reference(o, "o_custkey", view(spark, d, "customer"), "Customer")
    return out.select("o_orderkey", "Customer.c_name", "Customer.c_mktsegment")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 5, 7, 33, 99999999)")
def load_by_ids(spark, d):
    return objects.by_ids(view(spark, d, "orders"), [1, 5, 7, 33, 99999999]).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_brand, p_size FROM part")
def json_round_trip(spark, d):
    v = view(spark, d, "part")
    kind = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("properties", T.StructType([T.StructField("p_brand", T.StringType()), T.StructField("p_size", T.IntegerType())]))])
    return objects.from_json(objects.to_json(v), "json", kind).select("p_partkey", "properties.p_brand", "properties.p_size")


@query("""SELECT structure, count(*) AS n, round(sum(v), 2) AS total FROM (SELECT 'p_size' AS structure, p_size::DOUBLE AS v FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part UNION ALL SELECT 'p_name', NULL FROM part) GROUP BY 1""")
def values_long_form(spark, d):
    long = objects.to_values(view(spark, d, "part").df, "p_partkey", ["p_name", "p_size", "p_retailprice"])
    out = long.groupBy("structure").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("_long").cast("double"), "_double")).alias("total"))
    return out.withColumn("total", F.round("total", 2))


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def values_pivot(spark, d):
    df = view(spark, d, "part").df
    long = objects.to_values(df, "p_partkey", ["p_name", "p_size", "p_retailprice"])
    kind = T.StructType([f for f in df.schema.fields if f.name in ("p_name", "p_size", "p_retailprice")])
    return objects.from_values(long, "p_partkey", kind, df)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def exchange_round_trip(spark, d):
    df = view(spark, d, "nation").df
    path = f"{shared_folder(spark)}/nations-{uuid.uuid4().hex}.zip"
    exchange.export({"object": df}, path, compress=True)
    return exchange.load(spark, path, {"object": df.schema})["object"]


@query("SELECT DISTINCT dense_rank() OVER (ORDER BY o_orderpriority) AS id, o_orderpriority AS value FROM orders")
def list_items_used(spark, d):
    items = lists.items(view(spark, d, "orders").df, "o_orderpriority")
    coded = _priorities(spark, d).view.df.select(F.col("Priority.Id").alias("Priority"))
    return lists.used(items, [(coded, "Priority")]).select("id", "value")


@query("""SELECT id, value FROM (SELECT DISTINCT dense_rank() OVER (ORDER BY o_orderpriority) AS id, o_orderpriority AS value FROM orders) WHERE value <> '3-MEDIUM' AND value <> '5-LOW'
UNION ALL SELECT (SELECT count(DISTINCT o_orderpriority) FROM orders) + 1, '6-NEW' UNION ALL SELECT 5, 'LOWEST'""")
def list_changes(spark, d):
    """Items added, renamed, deleted, and kept to a set of values."""
    items = lists.items(view(spark, d, "orders").df, "o_orderpriority")
    items = lists.add_items(items, spark.createDataFrame([("6-NEW",), ("1-URGENT",)], "value string"))
    items = lists.update_items(items, spark.createDataFrame([(5, "LOWEST", None), (99, "none", None)], "id long, value string, alias string"))
    wanted = lists.delete_items(items, spark.createDataFrame([(3,)], "id long"))
    return lists.sync_items(items, wanted).select("id", "value")


@query(f"""{_PATHS} SELECT id FROM paths WHERE list_contains(path, 1) AND NOT list_contains(path, 1000) OR list_contains(path, 1007)""")
def permissions_changed(spark, d):
    kind = "id_ref long, user_id long, role_id long, select boolean, insert boolean, update boolean, delete boolean"
    made = lambda *rows: spark.createDataFrame([(r, u, None, x, False, False, False) for r, u, x in rows], kind)
    granted = permissions.grant(made((0, 7, True), (1, 7, False), (2, 7, True)), made((0, 7, False), (1, 7, True), (1000, 7, False), (1007, 7, True)))
    granted = permissions.revoke(granted, spark.createDataFrame([(2, 7)], "id_ref long, user_id long"))
    return permissions.allowed(forest(spark, d), granted, 7).select("id")


@query(f"""{_PATHS} SELECT id, CASE WHEN list_contains(path, 1) THEN 7 ELSE 5 END AS subject FROM paths WHERE level = 1 UNION ALL SELECT 1, 7 UNION ALL SELECT 0, 5""")
def permissions_of_parents(spark, d):
    """Nations that got children have a copy of what holds for them from above."""
    kind = "id_ref long, user_id long, role_id long, select boolean, insert boolean, update boolean, delete boolean"
    granted = spark.createDataFrame([(0, None, 5, True, False, False, False), (1, 7, None, True, True, False, False)], kind)
    nations = of_scheme(forest(spark, d), 2).df.select("id")
    out = permissions.for_new_children(forest(spark, d), granted, nations)
    return out.select(F.col("id_ref").alias("id"), F.coalesce("user_id", "role_id").alias("subject"))


@query("SELECT 'p_' || p_partkey AS label, p_size * p_size + 1 AS area FROM part WHERE p_size * p_size + 1 > 500")
def stored_functions(spark, d):
    table = spark.createDataFrame([(1, "orrery_label", "x BIGINT", "STRING", "'p_' || x"), (1, "orrery_area", "x INT", "INT", "x * x + 1"), (2, "orrery_other", "x INT", "INT", "0")], "scheme_id long, name string, parameters string, returns string, body string")
    names = registered.register(table, 1)
    v = view(spark, d, "part")
    compiler = Compiler(v, registered.operators(names, Compiler(v).scalar))
    found = v.df.where(compiler.boolean({"$gt": [{"$orrery_area": [{"$field": "p_size"}]}, 500]}))
    return found.select(compiler.scalar({"$orrery_label": {"$field": "p_partkey"}}).alias("label"), compiler.scalar({"$orrery_area": [{"$field": "p_size"}]}).alias("area"))


@query(f"""WITH {_NODES}, leaf AS (SELECT id, CASE WHEN id IN (SELECT parent_id FROM nodes WHERE scheme_id = 4 AND name = 'P') THEN 1 ELSE 0 END AS height, parent_id FROM nodes WHERE scheme_id = 3)
SELECT parent_id AS id FROM leaf GROUP BY 1 HAVING max(height) > min(height)""")
def tree_unbalanced(spark, d):
    """Nations with customers with pending orders and others without."""
    whole = forest(spark, d)
    return tree.unbalanced(whole.with_df(whole.df.where("scheme_id < 4 or name = 'P'")), most=0)


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -1, 0.5")
def save_batch(spark, d):
    c = view(spark, d, "customer").df.select("c_custkey", "c_acctbal")
    new = c.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1).union(spark.createDataFrame([(-1, 0.5)], "c_custkey long, c_acctbal double"))
    return storage.upsert(c, new, "c_custkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def write_and_read(spark, d):
    path = f"{shared_folder(spark)}/objects-{uuid.uuid4().hex}"
    view(spark, d, "orders").df.select("o_orderkey", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    return objects.load(spark, path, {"id": "o_orderkey"}).df.select("o_orderkey", "o_orderstatus")


@query(f"{_PATHS} SELECT n.id, CASE WHEN list_contains(path, 1003) THEN -10 ELSE scheme_id END AS scheme_id FROM nodes n JOIN paths p USING (id)")
def soft_delete(spark, d):
    return storage.soft_delete(forest(spark, d), spark.createDataFrame([(1003,)], "id long")).select("id", "scheme_id")


@query(f"{_PATHS} SELECT id FROM paths WHERE NOT list_contains(path, 1003)")
def purge(spark, d):
    whole = forest(spark, d)
    marked = storage.soft_delete(whole, spark.createDataFrame([(1003,)], "id long"))
    return storage.purge(whole.with_df(marked)).select("id")


@query(f"{_PATHS} SELECT id FROM paths WHERE (list_contains(path, 1) OR list_contains(path, 1004)) AND NOT list_contains(path, 1000)")
def permissions_inherited(spark, d):
    granted = spark.createDataFrame(
        [(0, 7, None, False, False, False, False), (1, 7, None, True, False, False, False), (1004, None, 5, True, True, False, False), (1000, 7, None, False, False, False, False)],
        "id_ref long, user_id long, role_id long, select boolean, insert boolean, update boolean, delete boolean",
    )
    roles = spark.createDataFrame([(7, 5)], "user_id long, role_id long")
    return permissions.allowed(forest(spark, d), granted, 7, "select", roles).select("id")


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE mixed IS NULL OR TRY_CAST(mixed AS BIGINT) IS NOT NULL) AS success, count(*) FILTER (WHERE mixed IS NOT NULL AND TRY_CAST(mixed AS BIGINT) IS NULL) AS errors
FROM (SELECT CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN p_name ELSE CAST(p_size AS VARCHAR) END AS mixed FROM part)""")
def migrate_type(spark, d):
    mixed = F.when(F.col("p_partkey") % 5 == 0, None).when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.col("p_size").cast("string"))
    return schemes.migration_report(view(spark, d, "part").df.withColumn("mixed", mixed), "mixed", T.LongType())


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size, TRY_CAST(p_name AS BIGINT) AS p_name, NULL::DOUBLE AS added FROM part")
def schema_evolution(spark, d):
    kind = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_size", T.StringType()), T.StructField("p_name", T.LongType()), T.StructField("added", T.DoubleType())])
    return schemes.evolve(view(spark, d, "part").df, kind)


@query("SELECT r_regionkey, md5(r_name || '|' || CAST(r_regionkey AS VARCHAR)) AS hash FROM region")
def object_hash(spark, d):
    df = view(spark, d, "region").df
    return df.select("r_regionkey", schemes.object_hash(T.StructType([df.schema["r_name"], df.schema["r_regionkey"]])).alias("hash"))


@query("SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS window_start, count(*) AS n FROM events WHERE value > 10 GROUP BY 1, 2")
def stream_windows(spark, d):
    """A stream of the events file, run to its end; the batch of the last state is complete."""
    schema = view(spark, d, "events").df.schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    counted = streams.windowed_counts(streams.where(stream, {"value": {"$gt": 10}}), "ts", "1 hour", ["event_type"])
    path = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    out = counted.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/out"))
    out.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_type", "window_start", "n")


def compiled(spark: SparkSession, d: str, name: str, condition: object) -> DataFrame:
    """Any filter over any table, for the command line."""
    v = view(spark, d, name)
    return v.df.where(Compiler(v).filter(condition))
