"""What SQL on the driver's tables doesn't show: errors, null rules, nested records, previews."""

import datetime
import decimal
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions import text_search
from orrery.operators import storage, tree
from orrery.operators.query import Query
from orrery.operators.tree import TreeQuery
from orrery.operators.window import Frame
from orrery.plans import schemes, stored
from orrery.plans.compiler import Compiler
from orrery.plans.nodes import call, field, when
from orrery.plans.paths import PathError, View, encode_key
from orrery.sources import exchange, lists, objects
from orrery.streaming import filters as streams

EMPLOYEE = """id long, name string, FirstName string, Age int, HireDate timestamp, Position string, Salary decimal(38,18), EmployeeCode string, Rating double,
Skills array<string>, SkillLevels array<int>, HomeAddress struct<City: string, Building: struct<Floor: int, Amenities: array<string>>>,
Contacts array<struct<Type: string, Value: string>>, PhoneDirectory map<string,string>, Reviews map<string,string>, CurrentProject long"""


@pytest.fixture(scope="module")
def staff(spark):
    rows = []
    for i in range(20):
        rows.append((
            i, f"e{i}", f"Employee{i:03}", 25 + i % 30, datetime.datetime(2020 + i // 12, 1 + i % 12, 1), ["Developer", "Senior Developer", "Manager", "Analyst", "Tester"][i % 5],
            50000 + 5000 * i, None if i % 3 == 0 else f"EMP-{i:04}", None if i % 4 == 0 else 3.0 + (i % 5) * 0.5, ["C#", "SQL", "Go"][: i % 4] if i % 4 else None, [5 - i % 3, 4, 3 + i % 2],
            (["Paris", "Rome", "Oslo", "Bern", "Wien"][i % 5], (1 + i % 20, ["Parking", "Gym"])), [("email", f"e{i}@x.org"), ("phone", f"555-{i}")],
            {"desk": f"555-{1000 + i}"}, {encode_key([2024, "Q1"]): "Excellent" if i % 3 == 0 else "Good"}, i if i % 2 else None,
        ))
    from decimal import Decimal

    rows = [(*r[:6], Decimal(r[6]), *r[7:]) for r in rows]
    return Query(View(spark.createDataFrame(rows, EMPLOYEE), {"id": "id", "name": "name"}, None, "Employee"))


def ids(q):
    return sorted(r.id for r in q.df().collect())


def test_leaf_and_expression_treat_null_differently(staff):
    assert ids(staff.where({"EmployeeCode": None})) == [i for i in range(20) if i % 3 == 0]
    assert ids(staff.where({"$expr": {"$eq": [{"$field": "EmployeeCode"}, None]}})) == []
    assert ids(staff.where(field("EmployeeCode") == None)) == [i for i in range(20) if i % 3 == 0]  # noqa: E711
    assert ids(staff.where({"Rating": {"$ne": 3.5}})) == [i for i in range(20) if i % 4 and 3.0 + (i % 5) * 0.5 != 3.5]
    assert ids(staff.where({"Rating": {"$gt": None}})) == []


def test_arrays_keep_null_when_negated(staff):
    none = [i for i in range(20) if i % 4 == 0]
    assert ids(staff.where({"Skills": {"$ne": "SQL"}})) == sorted(none + [i for i in range(20) if i % 4 == 1])
    assert ids(staff.where({"Skills": {"$nin": ["SQL", "Go"]}})) == sorted(none + [i for i in range(20) if i % 4 == 1])
    assert ids(staff.where({"Skills": {"$arrayAny": False}})) == none
    assert ids(staff.where({"Skills": {"$arrayEmpty": True}})) == none
    assert ids(staff.where({"Skills": {"$arrayLast": "Go"}})) == [i for i in range(20) if i % 4 == 3]
    assert ids(staff.where({"Skills.$count": {"$lt": 2}})) == [i for i in range(20) if i % 4 < 2]
    assert ids(staff.where({"SkillLevels": {"$arraySum": 12, "$arrayMax": 5}})) == [i for i in range(20) if 5 - i % 3 == 5 and i % 2 == 0]


def test_paths(staff):
    assert ids(staff.where({"HomeAddress.City": "Oslo", "HomeAddress.Building.Floor": {"$gt": 5}})) == [7, 12, 17]
    assert ids(staff.where({"PhoneDirectory[desk]": "555-1003"})) == [3]
    assert ids(staff.where({"PhoneDirectory.ContainsKey": "none"})) == []
    key = encode_key([2024, "Q1"])
    assert ids(staff.where({f"Reviews[{key}]": "Excellent"})) == [i for i in range(20) if i % 3 == 0]
    assert ids(staff.where({"Contacts[].Value": {"$in": ["e4@x.org", "555-9"]}})) == [4, 9]
    assert ids(staff.where({"Contacts[1].Type": "phone", "0$:Id": {"$lt": 3}})) == [0, 1, 2]
    assert ids(staff.where({"_name": "e5"})) == [5]
    assert ids(staff.where({"CurrentProject": {"$exists": True}})) == list(range(1, 20, 2))
    for bad in ("Nope", "HomeAddress.Nope", "Age.x", "Age[0]", "0$:Nope", "A..B"):
        with pytest.raises(PathError):
            staff.where({bad: 1}).df()


def test_dates_and_decimals_compare_with_texts_and_floats(staff):
    assert ids(staff.where({"HireDate": {"$gte": "2021-06-01"}})) == [17, 18, 19]
    assert ids(staff.where({"Salary": {"$between": [60000.0, 65000]}})) == [2, 3]


@pytest.mark.parametrize(
    "bad",
    [{"Age": {}}, {"Age": {"$nope": 1}}, {"$nope": [1]}, {"$expr": {"$and": []}}, {"$expr": {"$or": []}}, {"Age": {"$arrayAny": True}}, {"$expr": {"$eq": [{"$nofunction": [1]}, 1]}}],
)
def test_unknown_and_empty_conditions_are_errors(staff, bad):
    with pytest.raises(ValueError):
        staff.where(bad).df()


def test_scalar_errors(staff):
    c = staff.compiler()
    for tree_ in ({"$cast": ["inet", 1]}, {"$datediff": ["eon", "2020-01-01", "2020-01-01"]}, {"$case": [{"else": 1}, {"else": 2}]}, {"$sub": [1]}, {"$add": [], "$mul": []}):
        with pytest.raises(ValueError):
            c.scalar(tree_)
    for aggregates in ([{"$count": "*", "distinct": True}], [{"$sum": "SkillLevels", "distinct": True}], [{"$sum": "Age", "alias": "x"}, {"$max": "Age", "alias": "x"}]):
        with pytest.raises(ValueError):
            c.aggregates(aggregates)


def test_functions(staff, spark):
    c = staff.compiler()
    one = staff.view.df.limit(1)
    value = lambda t: one.select(c.scalar(t).alias("x")).first().x
    assert value(call("padLeft", "abc", 2)) == "abc" and value(call("padRight", "a", 3, "xy")) == "axy"
    assert value(call("div", 7, 2)) == 3 and value(call("div", -7, 2)) == -3 and value(call("div", 7.0, 2)) == 3.5
    assert value(call("mod", -7, 3)) == -1 and value(call("min", 3, None, 1)) == 1
    assert value(call("indexOf", "hello", "l")) == 3 and value(call("indexOf", "hello", "z")) == 0
    assert value(call("regexReplace", "a.b\na.b", "(a)(.)", r"\2\1$")) == ".a$b\na.b"
    assert value(call("regexReplace", "aXbX", "x", "<\\&>", "gi")) == "a<X>b<X>"
    assert value(call("dateDiff", "day", "2024-01-02 18:00:00", "2024-01-01 00:00:00")) == 2
    assert value(call("dateDiff", "month", "2024-03-30", "2024-01-31")) == 1 and value(call("dateDiff", "year", "2020-01-01", "2023-12-31")) == -3
    assert value(call("dateTrunc", "century", "2000-06-01")) == datetime.datetime(1901, 1, 1)
    assert value(call("dateTrunc", "millennium", "2001-06-01")) == datetime.datetime(2001, 1, 1)
    assert value(call("dayOfWeek", call("cast", "date", "2024-03-31"))) == 0
    assert value(call("concat", "a", None)) is None and value(call("coalesce", None, "x")) == "x"
    assert value(when(field("Age") > 100, "old")) is None


def test_full_text_queries(spark):
    df = spark.createDataFrame([(1, "Red apples, green PEARS"), (2, "apples red"), (3, None), (4, "pear")], "id int, t string")
    hit = lambda q: [r.id for r in df.where(text_search.matches([F.col("t")], q)).orderBy("id").collect()]
    assert hit("red apples") == [1, 2] and hit('"red apples"') == [1] and hit("pears or pear") == [1, 4]
    assert hit("apples -green") == [2] and hit("") == [] and hit("-apples") == [3, 4]


def test_query_steps(staff):
    assert [r.id for r in staff.order_by("Rating").then_by("0$:Id", desc=True).take(3).df().collect()] == [15, 10, 5]
    assert [r.id for r in staff.order_by("Rating", desc=True).then_by("0$:Id").take(2).df().collect()] == [0, 4]
    assert [r.id for r in staff.order_by("Age").order_by("Salary", desc=True).skip(1).take(2).df().collect()] == [18, 17]
    assert staff.take(0).to_list() == [] and staff.take(3).count() == 20
    with pytest.raises(ValueError):
        staff.take(-1)
    assert staff.any({"Age": 44}) and not staff.any({"Age": 99}) and staff.all({"Age": {"$gt": 20}}) and not staff.all({"Rating": {"$gt": 0}})
    assert staff.where({"Age": 99}).all({"Age": 1})
    assert staff.where(field("Age") == 99).sum("Age") == 0 and staff.where({"Age": 99}).max("Age") is None
    assert {r.Position for r in staff.distinct_by("Position").df().collect()} == {r.Position for r in staff.to_list()}
    with pytest.raises(ValueError):
        staff.distinct().distinct_by("Age")
    assert json.loads(staff.where({"Age": 1}).where(field("Age") > 2).to_filter_json())["$and"][0] == {"Age": 1}
    assert "Filter" in staff.where({"Age": 1}).explain()


def test_pushdown_and_pruning(spark):
    v = View(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), {"id": "o_orderkey"}, None, "orders")
    df = Query(v).where({"o_totalprice": {"$gt": 1000}, "o_orderstatus": "F"}).select("o_custkey").df()
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(mode)
    assert "GreaterThan(o_totalprice" in plan and "EqualTo(o_orderstatus,F)" in plan
    (read,) = [line for line in plan.splitlines() if line.startswith("ReadSchema")]
    assert "o_orderdate" not in read and "o_orderpriority" not in read


def test_groups(staff):
    out = staff.group_by("Position").having({"$gt": [{"$avg": "Age"}, 33]}).having({"$lt": [{"$min": "Salary"}, 70000]}).select({"$count": "*", "alias": "n"})
    assert sorted(out.columns) == ["Position", "n"] and {r.n for r in out.collect()} == {4}
    assert staff.group_by("Position").count() == 5
    with pytest.raises(ValueError):
        staff.group_by().having({"$gt": [{"$count": "*"}, 1]}).select({"$count": "*"})
    with pytest.raises(ValueError):
        staff.group_by("Age", "Age").select({"$count": "*"})
    with pytest.raises(NotImplementedError):
        staff.group_by_array("Contacts", "Type").with_window({})
    arr = staff.where({"Age": {"$lt": 30}}).group_by_array("Contacts", "Type").select({"$count": "*", "alias": "n"})
    assert {(r.Type, r.n) for r in arr.collect()} == {("email", 5), ("phone", 5)}


def test_windows(staff):
    out = staff.with_window({"partition_by": ["Position"], "order_by": ["0$:Id"]}).select(
        {"field": "0$:Id", "alias": "id"}, {"func": "row_number", "alias": "n"}, {"func": "sum", "args": ["Age"], "frame": Frame.rows().unbounded_preceding(), "alias": "run"}
    )
    rows = {r.id: r for r in out.collect()}
    assert all(rows[i].n == 1 + i // 5 for i in range(20)) and rows[5].run == 25 + 30
    for bad in ({"func": "sum"}, {"func": "nope", "args": ["Age"]}, {"func": "lag", "args": ["Age"], "filter": {"Age": 1}}):
        with pytest.raises(ValueError):
            staff.with_window({"order_by": ["Age"]}).select(bad)


def forest(spark):
    rows = [(1, None, "a"), (2, 1, "b"), (3, 1, "c"), (4, 2, "d"), (5, 4, "e"), (6, None, "f"), (7, 99, "lost")]
    return View(spark.createDataFrame(rows, "id long, parent_id long, name string"), {"id": "id", "parent_id": "parent_id", "name": "name"}, None, "nodes")


def test_trees(spark):
    v = forest(spark)
    t = TreeQuery(v)
    found = lambda q: sorted(r.id for r in q.df().collect())
    assert found(t.where_roots()) == [1, 6] and found(t.where_leaves()) == [3, 5, 6, 7]
    assert found(t.where_level(2)) == [4] and found(t.where_level({"$gte": 1, "$ne": 2})) == [2, 3, 5]
    assert found(t.where_descendants_of(1)) == [2, 3, 4, 5] and found(t.where_descendants_of(1, max_depth=1)) == [2, 3]
    assert found(t.where_descendants_of(2, 4, include_seeds=True)) == [2, 4, 5] and found(t.where_descendants_of(2, 4)) == [4, 5]
    assert found(t.where_ancestors_of(5)) == [1, 2, 4] and found(t.where_has_descendant({"name": "e"})) == [1, 2, 4]
    assert found(t.where_has_ancestor({"name": "b"}, max_depth=1)) == [4] and found(t.where_descendants_of(1).where_leaves()) == [3, 5]
    assert found(t.with_max_depth(1).where_descendants_of(1)) == [2, 3] and found(t.with_max_depth(2).where({"$hasAncestor": {"name": "a"}})) == [2, 3, 4]
    assert sorted(r.id for r in t.where({"name": "e"}).with_ancestors().collect()) == [1, 2, 4, 5]
    assert [r.id for r in t.where({"name": "e"}).root_list().collect()] == [1]
    assert [r.id for r in tree.path_to_root(v, 5).collect()] == [1, 2, 4, 5]
    walk = lambda order: [r.id for r in tree.flattened(v, "name", order).where("id <= 6").collect()]
    assert walk("depth_first") == [1, 2, 4, 5, 3, 6] and walk("post_order") == [5, 4, 2, 3, 1, 6] and walk("breadth_first") == [1, 6, 2, 3, 4, 5]
    assert {r.id: r.breadcrumbs for r in tree.flattened(v, "name").collect()}[5] == "a > b > d > e"
    s = tree.statistics(v).first()
    assert (s.total, s.roots, s.leaves, s.orphans, s.max_depth) == (7, 2, 4, 1, 3)
    assert [tuple(r) for r in tree.integrity_errors(v).collect()] == [(7, "missing parent")]
    assert {r.id: (r.subtree_size, r.height) for r in tree.subtree_sizes(v).collect()}[1] == (5, 3)
    assert {r.id: r.parent_id for r in tree.move(v, 4, 6).collect()}[4] == 6
    for parent in (5, 42):
        with pytest.raises(ValueError):
            tree.move(v, 4, parent)
    assert sorted(r.id for r in tree.without_subtree(v, 2).collect()) == [1, 3, 6, 7]
    assert tree.create_child(v, 6, {"id": 8, "name": "new"}).where("parent_id = 6").count() == 1
    assert tree.is_ancestor(v, 1, 5) and not tree.is_ancestor(v, 5, 1)


def test_cycles_are_found(spark):
    v = View(spark.createDataFrame([(1, 2), (2, 1)], "id long, parent_id long"), {"id": "id", "parent_id": "parent_id"}, None, "loop")
    with pytest.raises(ValueError):
        tree.levels(v)


def test_long_chains(spark):
    """Twelve thousand levels, in some dozen rounds."""
    n = 12_000
    df = spark.range(n).selectExpr("id", "nullif(id - 1, -1) as parent_id")
    v = View(df, {"id": "id", "parent_id": "parent_id"}, None, "chain")
    seed = lambda k: spark.createDataFrame([(k,)], "id long")
    assert tree.levels(v).agg({"level": "max"}).first()[0] == n - 1
    below = tree.descendants(v, seed(100))
    assert below.count() == n - 101 and below.agg({"depth": "max"}).first()[0] == n - 101
    assert tree.descendants(v, seed(100), max_depth=37).count() == 37
    assert tree.ancestors(v, seed(11_000)).count() == 11_000 and tree.ancestors(v, seed(11_000), max_depth=50).count() == 50
    sizes = {r.id: (r.subtree_size, r.height) for r in tree.subtree_sizes(v).where("id in (0, 5000, 11999)").collect()}
    assert sizes == {0: (n, n - 1), 5000: (n - 5000, n - 5001), 11999: (1, 0)}


def test_walks_from_several_seeds(spark):
    """Depth from the nearest seed, seeds below seeds, circles and limits, against a walk step by step."""
    rng = random.Random(4)
    up = {k: rng.randrange(k) if k and rng.random() < 0.97 else None for k in range(400)}
    up |= {500: 502, 501: 500, 502: 501, 503: 502, 504: 9999}
    v = View(spark.createDataFrame(list(up.items()), "id long, parent_id long"), {"id": "id", "parent_id": "parent_id"}, None, "nodes")

    def climb(k):
        out, seen = [], set()
        while up.get(k) in up and up[k] not in seen:
            k = up[k]
            seen.add(k)
            out.append(k)
        return out

    for _ in range(2):
        seeds = rng.sample(sorted(up), 6) + [7777]
        limit = rng.choice([None, 1, 2, 3, 5])
        near = {k: min([d for d, x in enumerate(climb(k), 1) if x in seeds], default=None) for k in up}
        below = {k: d for k, d in near.items() if d is not None and (limit is None or d <= limit)}
        above = {}
        for s in seeds:
            for d, x in enumerate(climb(s) if s in up else [], 1):
                if limit is None or d <= limit:
                    above[x] = min(d, above.get(x, d))
        df = spark.createDataFrame([(s,) for s in seeds], "id long")
        assert {r.id: r.depth for r in tree.descendants(v, df, limit).collect()} == below
        assert {r.id: r.depth for r in tree.ancestors(v, df, limit).collect()} == above
        own = {s: 0 for s in seeds if s in up}
        assert {r.id: r.depth for r in tree.descendants(v, df, limit, include_seeds=True).collect()} == below | own
        assert {r.id: r.depth for r in tree.ancestors(v, df, limit, include_seeds=True).collect()} == above | own


@pytest.mark.parametrize("mode", ["rows", "groups", "range"])
@pytest.mark.parametrize("exclude", ["current_row", "group", "ties"])
def test_exclusions_against_brute_force(spark, mode, exclude):
    rng = random.Random(8)
    rows = [(k, rng.randrange(3), rng.randrange(6), rng.choice([None, *range(1, 9)])) for k in range(120)]
    v = View(spark.createDataFrame(rows, "id long, p int, o int, v int"), {"id": "id"}, None, "rows")
    ends = {"rows": [(-2, 2), (1, 3), (-3, 0)], "groups": [(-1, 1), (0, 2), (1, 2)], "range": [(-1, 1), (-2, 0), (1, 2)]}[mode]
    side = lambda n: "current" if n == 0 else {"preceding": -n} if n < 0 else {"following": n}
    names = ("sum", "count", "avg", "min", "max")
    for start, end in ends:
        frame = {"mode": mode, "start": side(start), "end": side(end), "exclude": exclude}
        items = [{"func": f, "args": ["v"], "partition_by": ["p"], "order_by": ["o"], "frame": frame, "alias": f} for f in names]
        got = {r.id: tuple(r)[1:] for r in Query(v).with_window().select("id", *items).collect()}
        for k, p, o, _ in rows:
            part = sorted((x for x in rows if x[1] == p), key=lambda x: (x[2], x[0]))
            order = sorted({x[2] for x in part})
            at = next(i for i, x in enumerate(part) if x[0] == k)
            offset = {"rows": lambda i, x: i - at, "groups": lambda i, x: order.index(x[2]) - order.index(o), "range": lambda i, x: x[2] - o}[mode]
            inside = [x for i, x in enumerate(part) if start <= offset(i, x) <= end]
            inside = [x for x in inside if not (x[0] == k if exclude == "current_row" else x[2] == o and (exclude == "group" or x[0] != k))]
            values = [x[3] for x in inside if x[3] is not None]
            want = (sum(values), len(values), sum(values) / len(values), min(values), max(values)) if values else (None, 0, None, None, None)
            assert got[k] == pytest.approx(want) if values else got[k] == want, (k, start, end)


@pytest.mark.parametrize("desc", [False, True])
@pytest.mark.parametrize("key", ["i", "f", "s", "t", "d", "m"])
def test_first_of_each_key(spark, key, desc):
    rng = random.Random(3)
    nan = float("nan")
    day = datetime.date(2024, 1, 1)
    rows = [(k, rng.randrange(5), rng.choice([None, -5, 3, 3, 2**62, -(2**63)]), rng.choice([None, nan, 1.5, -2.0]), rng.choice([None, "a", "b"]), rng.choice([None, datetime.datetime(2024, 1, 1), datetime.datetime(1960, 1, 1)]),
             rng.choice([None, day]), rng.choice([None, decimal.Decimal("1.5"), decimal.Decimal("-7")])) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, g int, i long, f double, s string, t timestamp, d date, m decimal(10,2)")
    got = {r.g: r.id for r in Query(View(df, {"id": "id"}, None, "rows")).order_by(key, desc=desc).distinct_by("g").df().collect()}
    order = F.col(key).desc_nulls_first() if desc else F.col(key).asc_nulls_last()
    want = {}
    for r in df.orderBy(order, "id").collect():
        want.setdefault(r.g, r.id)
    assert got == want


def test_services(spark, tmp_path):
    registry = schemes.SchemeRegistry()
    kind = T.StructType([T.StructField("Name", T.StringType()), T.StructField("Home", T.StructType([T.StructField("Rooms", T.ArrayType(T.LongType()))])), T.StructField("By", T.MapType(T.StringType(), T.StructType([T.StructField("X", T.LongType())])))])
    registry.sync("House", kind)
    registry.table(spark).write.parquet(str(tmp_path / "schemes"))
    back = schemes.SchemeRegistry.load(spark.read.parquet(str(tmp_path / "schemes")))
    assert back.schemes == registry.schemes
    assert [tuple(r) for r in back.structures(spark, "House").collect()] == [
        ("Name", None, "string", False, False), ("Home", None, "class", False, False), ("Home.Rooms", "Home", "bigint", True, False), ("By", None, "class", False, True), ("By.X", "By", "bigint", False, False)
    ]
    with pytest.raises(ValueError):
        back.delete("House", spark.createDataFrame([(1,)], "scheme_id long"))
    back.delete("House")
    assert not back.schemes
    found = schemes.validate(T.StructType([T.StructField("a b", T.LongType()), T.StructField("Name", T.LongType()), T.StructField("name", T.NullType())]), kind)
    assert {(x["severity"], x["field"]) for x in found} >= {("error", "a b"), ("error", "Name"), ("error", "name"), ("warning", "Home"), ("warning", "Name"), ("info", "a b")}
    items = spark.createDataFrame([(1, "a", None), (2, "b", None)], "id long, value string, alias string")
    with pytest.raises(ValueError):
        lists.delete_items(items, spark.createDataFrame([(2,)], "id long"), [(spark.createDataFrame([(2,)], "s long"), "s")])
    assert lists.by_value(items, "b").first().id == 2
    tables = {"object": spark.createDataFrame([(1, 10), (2, 20)], "id long, scheme_id long"), "value": spark.createDataFrame([(1, "x"), (2, "y")], "object_id long, v string"), "list": items}
    path = str(tmp_path / "some.jsonl")
    assert exchange.export(tables, path, schemes=[20]) == {"list": 2, "object": 1, "value": 1}
    loaded = exchange.load(spark, path, {"object": tables["object"].schema})
    merged = exchange.imported({"object": tables["object"].where("id = 1")}, loaded)
    assert sorted(r.id for r in merged["object"].collect()) == [1, 2]
    assert [r.id for r in exchange.imported(tables, loaded, clean=True)["object"].collect()] == [2]
    with pytest.raises(ValueError):
        Query(View(items, {"id": "id"}, None, "items")).where({"value": {"$fts": {"query": "x", "language": "english"}}}).df()
    assert "Aggregate" in Query(View(items, {"id": "id"}, None, "items")).explain_aggregate({"$count": "*", "alias": "n"})


def test_storage_and_schemes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "id long, v string")
    assert sorted(tuple(r) for r in storage.upsert(old, new, "id").collect()) == [(1, "a"), (2, "B"), (3, "c")]
    registry = schemes.SchemeRegistry()
    registry.sync("S", old.schema)
    report = registry.sync("S", T.StructType([T.StructField("id", T.StringType()), T.StructField("w", T.LongType())]))
    assert report == {"added": ["w"], "removed": ["v"], "changed": ["id"]}
    with pytest.raises(ValueError):
        schemes.check_names(T.StructType([T.StructField("not a name", T.LongType())]))
    evolved = schemes.evolve(old, T.StructType([T.StructField("v", T.LongType()), T.StructField("w", T.LongType())]))
    assert [tuple(r) for r in evolved.collect()] == [(None, None), (None, None)]
    df = spark.createDataFrame([("yes",), ("0",), ("x",), (None,)], "v string")
    assert [r.v for r in schemes.migrate(df, "v", T.BooleanType()).collect()] == [True, False, None, None]
    assert tuple(schemes.migration_report(df, "v", T.BooleanType()).first()) == (4, 3, 1)


def test_long_form_and_json(staff, spark):
    df = staff.view.df.select("id", "Age", "Rating", "Skills", "SkillLevels")
    back = objects.from_values(objects.to_values(df, "id"), "id", T.StructType([f for f in df.schema.fields if f.name != "id"]), df)
    key = lambda r: r.id
    assert sorted(back.select(df.columns).collect(), key=key) == sorted(df.collect(), key=key)
    text = objects.to_json(staff.view).where("id = 4").first().json
    assert json.loads(text)["properties"]["HomeAddress"]["Building"]["Floor"] == 5


def test_exchange(spark, tmp_path):
    a = spark.createDataFrame([(1, "x", None), (2, "é\n", 1.5)], "id long, name string, v double")
    b = spark.createDataFrame([(9,)], "id long")
    for name, zipped in (("plain.jsonl", False), ("packed.zip", True)):
        path = str(tmp_path / name)
        assert exchange.export({"object": a, "list": b}, path, zipped) == {"list": 1, "object": 2}
        got = exchange.load(spark, path, {"object": a.schema, "list": b.schema})
        assert sorted(got["object"].collect()) == sorted(a.collect()) and got["list"].collect() == b.collect()
    assert exchange.export({"object": a}, "/nowhere", dry_run=True) == {"object": 2}
    (tmp_path / "cut.jsonl").write_text('{"type": "header"}\n')
    with pytest.raises(ValueError):
        exchange.load(spark, str(tmp_path / "cut.jsonl"), {})


def test_lists(spark):
    items = spark.createDataFrame([(1, "Active", "A"), (2, "Gone", None)], "id long, value string, alias string")
    df = spark.createDataFrame([(1, 1, [2, 1]), (2, None, None), (3, 2, [])], "id long, Status long, Roles array<long>")
    both = lists.with_items(lists.with_items(df, "Status", items), "Roles", items)
    q = Query(View(both, {"id": "id"}, None, "Person"))
    assert ids(q.where({"Status.Value": "Active"})) == [1] and ids(q.where({"Status": 2})) == [3] and ids(q.where({"Roles[].Value": "Gone"})) == [1]
    assert {r.id: [x["Value"] for x in r.Roles] if r.Roles is not None else None for r in both.collect()} == {1: ["Gone", "Active"], 2: None, 3: []}
    assert [r.id for r in lists.used(items, [(df, "Status")]).orderBy("id").collect()] == [1, 2]


def test_stream_filters(spark, tmp_path):
    spark.createDataFrame([(datetime.datetime(2024, 1, 1, 0, 5 * k), k) for k in range(6)], "t timestamp, v int").write.parquet(str(tmp_path / "in"))
    stream = streams.where(spark.readStream.schema("t timestamp, v int").parquet(str(tmp_path / "in")), {"v": {"$gte": 2}})
    counts = streams.windowed_counts(stream, "t", "10 minutes")
    counts.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n for r in spark.table("counts").collect()) == [2, 2]


def test_reference_and_compiler_columns(staff):
    joined = objects.with_reference(staff.view.df, "CurrentProject", View(staff.view.df.select("id", "Age"), {"id": "id"}), "Project")
    q = Query(View(joined, {"id": "id"}, None, "Employee"))
    assert ids(q.where({"Project": {"$isNull": True}})) == list(range(0, 20, 2)) and ids(q.where({"Project.Age": {"$gt": 42}})) == [19]
    assert isinstance(Compiler(staff.view).filter({"Age": 1}), type(F.lit(1)))


def test_tree_operators_in_filters(spark):
    t = TreeQuery(forest(spark))
    found = lambda f: sorted(r.id for r in t.where(f).df().collect())
    assert found({"$or": [{"$isRoot": True}, {"$level": {"$gte": 3}}]}) == [1, 5, 6]
    assert found({"$isLeaf": False}) == [1, 2, 4] and found({"$not": {"$isRoot": True}}) == [2, 3, 4, 5, 7]
    assert found({"$descendantsOf": [2], "$isLeaf": True}) == [5] and found({"$childrenOf": 1, "name": "c"}) == [3]
    assert found({"$hasAncestor": {"name": "b"}}) == [4, 5] and found({"$hasDescendant": {"name": "d"}, "$level": 0}) == [1]
    with pytest.raises(ValueError):
        found({"$level": {"$like": 1}})


def test_command_line(spark, tmp_path, capsys):
    from orrery.__main__ import main

    table = "/root/testdata/sf0.001/nation.parquet"
    main(["query", table, '{"n_regionkey": 1}', "--select", "n_name", "--take", "3"])
    assert len([x for x in capsys.readouterr().out.splitlines() if "n_name" in x]) == 3
    main(["init", str(tmp_path / "store"), 'One={"type": "struct", "fields": [{"name": "a", "type": "long", "nullable": true, "metadata": {}}]}'])
    assert spark.read.parquet(str(tmp_path / "store/One")).columns == ["a"] and spark.read.parquet(str(tmp_path / "store/_schemes")).count() == 1
    main(["schema", table])
    schema = capsys.readouterr().out.strip().splitlines()[-1]
    main(["export", str(tmp_path / "n.zip"), f"object={table}", "--compress"])
    main(["import", str(tmp_path / "n.zip"), "object", schema, str(tmp_path / "out")])
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(spark.read.parquet(table).collect())


def parts(spark, rows, n=4):
    """Nodes as a union of several tables, as a forest of schemes is."""
    out = None
    for k in range(n):
        df = spark.createDataFrame(rows[k::n], "id long, parent_id long, name string")
        out = df if out is None else out.union(df)
    return View(out, {"id": "id", "parent_id": "parent_id", "name": "name"}, None, "nodes")


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_integrity_of_a_union(spark, monkeypatch):
    """No join for each table of the union, which would have all ids in a task of its own; against a plain count, in many tasks."""
    monkeypatch.setattr(stored, "TASK_ROWS", 50)
    rng = random.Random(8)
    rows = [(rng.choice([k, k, rng.randrange(400), None]), rng.choice([k, rng.randrange(500), None]), "x") for k in range(400)]
    found = tree.integrity_errors(parts(spark, rows))
    ids = [r[0] for r in rows]
    wanted = [(k, "duplicate id") for k in set(ids) if ids.count(k) > 1]
    wanted += [(k, "missing parent") for k, up, _ in rows if up is not None and up not in ids]
    wanted += [(k, "own parent") for k, up, _ in rows if k is not None and k == up]
    key = lambda t: (t[0] is not None, t)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(wanted, key=key)
    assert joins(found) == 1


def test_places_in_many_tasks(spark, monkeypatch):
    """Numbered by ranges of a few rows, with nodes that most of the others lead to; against a walk, and without a window over all rows."""
    monkeypatch.setattr(stored, "TASK_ROWS", 25)
    monkeypatch.setattr(tree, "CROWD", 20)
    rng = random.Random(3)
    up = {k: rng.choice([None, 0, 1, 1, 1, 2, rng.randrange(k), rng.randrange(k)]) if k > 2 else [None, 0, 1][k] for k in range(200)}
    up |= {k: 999 for k in range(300, 330)}  # many of a parent that isn't there
    v = parts(spark, [(k, p, "x") for k, p in up.items()])

    def path(k):
        return [*(path(up[k]) if up[k] in up else []), k]

    post = tree.places(v, "post_order")
    wanted = {k: n for n, k in enumerate(sorted(up, key=lambda k: [*path(k), 2**63]), 1)}
    assert {r.id: r.place for r in post.collect()} == wanted
    assert {r.id: r.place for r in tree.places(v, "breadth_first").collect()} == {k: n for n, k in enumerate(sorted(up, key=lambda k: (len(path(k)), k)), 1)}
    assert {(r.id, r.level, r.root) for r in tree.levels(v).collect()} == {(k, len(path(k)) - 1, path(k)[0]) for k in up}
    ordered = lists.items(spark.createDataFrame([(str(k % 90),) for k in range(300)], "s string"), "s")
    assert [(r.id, r.value) for r in ordered.orderBy("id").collect()] == list(enumerate(sorted({str(k % 90) for k in range(300)}), 1))


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_ancestors_in_a_union(spark, monkeypatch, most):
    """One join for all tables of the union, with ids broadcast or not, nodes that are there twice and parents that aren't; against a walk."""
    monkeypatch.setattr(tree, "BROADCAST_ROWS", most)
    rng = random.Random(5)
    up = {k: rng.choice([None, 900, *[rng.randrange(k)] * 9]) if k else None for k in range(120)}
    rows = [(k, p, "x" if k % 17 == 3 else "y") for k, p in up.items()] + [(7, up[7], "y")]
    t = TreeQuery(parts(spark, rows))
    wanted = set()
    for k in (r[0] for r in rows if r[2] == "x"):
        while k in up:
            wanted.add(k)
            k = up[k]
    found = t.where({"name": "x"}).with_ancestors()
    assert found.columns == ["id", "parent_id", "name"]
    assert sorted(tuple(r) for r in found.collect()) == sorted((r for r in rows if r[0] in wanted), key=lambda r: r[0])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parent_id") and "LeftSemi" not in plan.split("Union")[0] and plan[: plan.index("Union")].count("Join ") == 1


def test_used_items_are_counted_once(spark):
    """Uses are made distinct before the join, so that no task gets all uses of an item."""
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, value string")
    uses = spark.range(3000).selectExpr("case when id % 3 = 0 then null else 1 + id % 2 * 2 end as s")
    found = lists.used(items, [(uses, "s"), (spark.createDataFrame([(9,), (None,)], "s long"), "s")])
    assert sorted(tuple(r) for r in found.collect()) == [(1, "a"), (3, "c")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "Aggregate" in plan[plan.index("LeftSemi") :]
