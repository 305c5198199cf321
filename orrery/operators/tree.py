"""Trees of objects linked by parent: filters, walks and node properties.

Walks are made by pointer doubling: in each round a node's pointer goes twice as far up, so a
tree of depth d takes log2(d) rounds, a chain of thousands of levels about a dozen.  What is known
of a stretch (the nearest seed, sums, heights) is joined along.  Nodes whose pointer has left
the tree are not shuffled again, and what a loop carries is written between its rounds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..plans.compiler import _COMPARE, Compiler
from ..plans.nodes import tree_of
from ..plans.paths import View
from ..plans.stored import BROADCAST_ROWS, among, apart, numbered, small, stored, stored_with, tasks
from .query import Query

#: Tree operators that filters may hold.
_OPERATORS = {"$isroot", "$isleaf", "$level", "$childrenof", "$descendantsof", "$hasancestor", "$hasdescendant"}

#: Pointers to one node that a task may get at once.
CROWD = 100_000


def links(view: View) -> DataFrame:
    return view.df.select(F.col(view.id).alias("id"), F.col(view.parent).alias("parent_id"))


def _ids(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("id")).where("id is not null").distinct()


def _pointers(nodes: DataFrame) -> DataFrame:
    """id, up: the parent, which may not be there; then the next doubling finds nothing and makes it null."""
    return nodes.select("id", F.col("parent_id").alias("up"))


@dataclass
class Walk:
    """Nodes with a pointer ``up``; how many have one, and after how many doublings one still in use has gone more steps than there are nodes, so in a circle."""

    state: DataFrame
    live: int
    most: int


def _walk(state: DataFrame) -> Walk:
    state, n = stored_with(state, "walk", n=F.count("*"), live=F.count("up"))
    return Walk(state, n["live"], n["n"].bit_length() + 1)


def _along(walk: Walk, **made: Column) -> Walk:
    """A doubling: the columns of each node made of its own and those of the node that its pointer leads to, named ``up_...``."""
    state = walk.state
    above = state.select(F.col("id").alias("up"), *[F.col(c).alias(f"up_{c}") for c in state.columns if c != "id"])
    done = state.where("up is null")  # by far the most in the end, and all of one key
    moved = _led(state.where("up is not null"), above, walk.live)
    columns = {c: made.get(c, F.col(c)) for c in state.columns} | {"up": F.col("up_up")}
    state, n = stored_with(moved.select(*[x.alias(c) for c, x in columns.items()]).union(done), "walk", live=F.count("up"))
    return Walk(state, n["live"], walk.most)


def _led(moved: DataFrame, above: DataFrame, rows: int) -> DataFrame:
    """The pointers with what they lead to; nodes that very many lead to, as near a root, are broadcast, so that no task gets all their pointers."""
    if rows <= CROWD:
        return moved.join(above, "up", "left")
    crowded, n = stored_with(moved.groupBy("up").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("up"), "crowded", n=F.count("*"))
    if not n["n"]:
        return moved.join(above, "up", "left")
    found = stored(above.join(F.broadcast(crowded), "up"), "crowded")
    known = F.broadcast(crowded.join(found, "up", "left"))  # fewer than a row per CROWD pointers; some may not be there
    rest = moved.join(F.broadcast(crowded), "up", "left_anti").join(above, "up", "left")
    return moved.join(known, "up").unionByName(rest)


def descendants(view: View, seeds: DataFrame, max_depth: int | None = None, include_seeds: bool = False, through: View | None = None) -> DataFrame:
    """id, depth of everything below the ids in ``seeds`` (a column id); depth from the nearest seed. Seeds are in it only if asked, or below another.

    through: the objects that the walk may go through and end at, if not all.
    """
    nodes = links(view)
    seeds, n = stored_with(_ids(nodes.select("id").join(_ids(seeds, "id"), "id"), "id"), "seeds", n=F.count("*"))
    marked = seeds.select(F.col("id").alias("seed"))
    marked = F.broadcast(marked) if n["n"] <= BROADCAST_ROWS else marked
    walked = links(through) if through else nodes
    state = walked.select("id", F.col("parent_id").alias("up")).join(marked, F.col("up") == F.col("seed"), "left")
    walk = _walk(state.select("id", "up", F.when(F.col("seed").isNotNull(), 1).cast("long").alias("near")))
    span = 1  # near: the least number of steps, of the first `span`, up to a seed
    for _ in range(walk.most):
        if max_depth is not None and span >= max_depth or not walk.live:
            break
        walk = _along(walk, near=F.least("near", F.col("up_near") + span))
        span *= 2
    found = walk.state.where("near is not null").select("id", F.col("near").cast("int").alias("depth"))
    if max_depth is not None:
        found = found.where(F.col("depth") <= max_depth)
    if include_seeds:
        found = found.union(seeds.select("id", F.lit(0).alias("depth")))
    return found.groupBy("id").agg(F.min("depth").alias("depth"))


def ancestors(view: View, seeds: DataFrame, max_depth: int | None = None, include_seeds: bool = False, through: View | None = None) -> DataFrame:
    """id, depth of everything above the ids in ``seeds``; parents are at depth 1.

    through: the objects that the walk may go through and end at, if not all.
    """
    nodes = links(view)
    seeds, n = stored_with(_ids(nodes.select("id").join(_ids(seeds, "id"), "id"), "id"), "seeds", n=F.count("*"))
    # In each round the nodes found so far hand their depth on to where their pointers lead.
    found = seeds.select("id", F.lit(True).alias("seed"), F.lit(None).cast("long").alias("depth"))
    state = _pointers(nodes)
    if through:
        ends = links(through)
        known = ends.select(F.col("id").alias("known")).distinct()
        starts = ends.union(among(nodes, seeds, "id")).distinct()  # a seed may be any object
        state = starts.join(known, F.col("parent_id") == F.col("known"), "left").select("id", F.col("known").alias("up"))
    walk, span = _walk(state), 1
    for _ in range(walk.most):
        if max_depth is not None and span > max_depth or not walk.live:
            break
        known = found.select("id", F.when(F.col("seed"), 0).otherwise(F.col("depth")).alias("known"))
        if max_depth is not None:
            known = known.where(F.col("known") + span <= max_depth)
        steps = walk.state.where("up is not null").join(F.broadcast(known) if n["n"] <= BROADCAST_ROWS else known, "id")
        steps = steps.select(F.col("up").alias("id"), F.lit(False).alias("seed"), (F.col("known") + span).alias("depth"))
        found = found.union(steps).groupBy("id").agg(F.max("seed").alias("seed"), F.min("depth").alias("depth"))
        found, n = stored_with(found, "found", n=F.count("*"))
        walk = _along(walk)
        span *= 2
    out = found.where("depth is not null").select("id", F.col("depth").cast("int").alias("depth"))
    if include_seeds:
        out = found.select("id", F.when(F.col("seed"), 0).otherwise(F.col("depth")).cast("int").alias("depth"))
    if n["n"] <= BROADCAST_ROWS:  # a parent may not be there
        return nodes.select("id").join(F.broadcast(out), "id").distinct().select("id", "depth")
    return out.join(nodes.select("id"), "id", "left_semi")


def levels(view: View, with_path: bool = False) -> DataFrame:
    """id, level (ancestors; a root has 0), root, and the path of ids from the root if asked.

    A node whose parent isn't there is an orphan: its level counts from itself.
    """
    path = [F.array("id").alias("path")] if with_path else []
    known = F.col("up").isNotNull()
    # A level counts the steps to `up`, one less if that isn't there; the root is the last node on the way before it, itself at first.
    walk = _walk(_pointers(links(view)).select("id", "up", F.when(known, 1).otherwise(0).cast("long").alias("level"), F.col("id").alias("root"), *path))
    there = F.col("up_root").isNotNull()
    for _ in range(walk.most):
        if not walk.live:
            return walk.state.withColumn("level", F.col("level").cast("int")).drop("up")
        made = {"level": F.col("level") + F.coalesce("up_level", F.lit(-1)), "root": F.coalesce("up_root", "root")}
        walk = _along(walk, **made, **({"path": F.when(there, F.concat("up_path", "path")).otherwise(F.col("path"))} if with_path else {}))
    raise ValueError("the parent links have a cycle")


@dataclass(frozen=True)
class TreeQuery(Query):
    """A query whose filters may also be about the tree; all of them are required.

    ``forest`` is the view of all schemes that the links run through; by default the query's own.
    """

    forest: View | None = None
    tree: tuple[tuple[str, Any], ...] = ()
    most_depth: int | None = None

    def _and(self, kind: str, value: Any = None) -> TreeQuery:
        return replace(self, tree=(*self.tree, (kind, value)))

    def with_max_depth(self, n: int | None) -> TreeQuery:
        """Walks of this query's filters go n levels at most, or fewer where a filter says so."""
        return replace(self, most_depth=n)

    def _depth(self, own: int | None) -> int | None:
        return min([x for x in (own, self.most_depth) if x is not None], default=None)

    def where_roots(self) -> TreeQuery:
        return self._and("roots")

    def where_leaves(self) -> TreeQuery:
        """Nodes that no object of any scheme has as its parent."""
        return self._and("leaves")

    def where_level(self, condition: int | dict) -> TreeQuery:
        """A level, or conditions such as ``{"$gte": 1, "$lt": 3}``."""
        return self._and("level", condition)

    def where_children_of(self, *ids: Any) -> TreeQuery:
        return self._and("children", ids)

    def where_descendants_of(self, *ids: Any, max_depth: int | None = None, include_seeds: bool = False, polymorphic: bool = True) -> TreeQuery:
        """polymorphic: whether the walk goes through objects of all schemes, or only of the query's own."""
        return self._and("descendants", (ids, max_depth, include_seeds, polymorphic))

    def where_ancestors_of(self, *ids: Any, max_depth: int | None = None, polymorphic: bool = True) -> TreeQuery:
        return self._and("ancestors", (ids, max_depth, polymorphic))

    def where_has_ancestor(self, condition: Any, view: View | None = None, max_depth: int | None = None) -> TreeQuery:
        """A proper ancestor, of the scheme of ``view`` if given, that the condition holds for: found first, then walked down from."""
        return self._and("has_ancestor", (condition, view, max_depth))

    def where_has_descendant(self, condition: Any, view: View | None = None, max_depth: int | None = None) -> TreeQuery:
        return self._and("has_descendant", (condition, view, max_depth))

    def _forest(self) -> View:
        return self.forest or self.view

    def _matching(self, condition: Any, view: View | None) -> DataFrame:
        view = view or self._forest()
        return view.df.where(Compiler(view).filter(condition)).select(F.col(view.id).alias("id"))

    def _listed(self, ids: Sequence[Any]) -> DataFrame:
        forest = self._forest()
        ids = [i[self.view.id] if isinstance(i, Row) else i for i in ids]
        return forest.df.where(F.col(forest.id).isin(list(ids))).select(F.col(forest.id).alias("id"))

    def _with_flags(self) -> TreeQuery:
        """The query with a column for each tree operator that its filters hold, at whatever depth."""
        found: list[tuple[str, Any]] = []

        def look(x: Any) -> None:
            if isinstance(x, dict):
                found.extend((k.lower(), v) for k, v in x.items() if k.lower() in _OPERATORS)
            for y in x.values() if isinstance(x, dict) else x if isinstance(x, (list, tuple)) else ():
                look(y)

        look([tree_of(f) for f in self.filters])
        if not found:
            return self
        forest, key, df = self._forest(), self.view.id, self.view.df
        columns: list[tuple[str, Any, Column]] = []
        for k, (op, value) in enumerate(found):
            flag = f"_tree_{k}"
            if op == "$isroot":
                test = F.col(self.view.parent).isNull()
            elif op == "$childrenof":
                test = F.coalesce(F.col(self.view.parent).isin(value if isinstance(value, list) else [value]), F.lit(False))
            elif op == "$isleaf":
                inner = _ids(links(forest), "parent_id").select(F.col("id").alias(key), F.lit(True).alias(flag))
                df, test = df.join(inner, key, "left"), F.col(flag).isNull()
            elif op == "$level":
                level = levels(forest).select(F.col("id").alias(key), F.col("level").alias(flag))
                df, test = df.join(level, key, "left"), F.lit(True)
                for name, n in (value if isinstance(value, dict) else {"$eq": value}).items():
                    if name.lower() not in _COMPARE:
                        raise ValueError(f"unknown level condition {name}")
                    test = test & _COMPARE[name.lower()](F.col(flag), F.lit(n))
            else:
                if op == "$descendantsof":
                    ids = value if isinstance(value, list) else [value]
                    walk = self._walk("descendants", (ids, None, False, True))
                else:
                    walk = self._walk("has_ancestor" if op == "$hasancestor" else "has_descendant", (value, None, None))
                df = df.join(walk.select(F.col("id").alias(key), F.lit(True).alias(flag)), key, "left")
                test = F.coalesce(F.col(flag), F.lit(False))
            wanted = value if op in ("$isroot", "$isleaf") else True
            columns.append((op, value, test if wanted else ~test))

        def compiled(op: str) -> Any:
            return lambda value: next(c for o, v, c in columns if o == op and (v is value or v == value))

        return replace(self, view=self.view.with_df(df), extra={**self.extra, **{op: compiled(op) for op, _, _ in columns}})

    def filtered(self) -> DataFrame:
        df = Query.filtered(self._with_flags()).select(self.view.df.columns)
        forest, key = self._forest(), self.view.id
        for kind, value in self.tree:
            if kind == "roots":
                df = df.where(F.col(self.view.parent).isNull())
            elif kind == "children":
                df = df.where(F.col(self.view.parent).isin([i[key] if isinstance(i, Row) else i for i in value]))
            elif kind == "leaves":
                df = apart(df, _ids(links(forest), "parent_id").withColumnRenamed("id", key), key)
            elif kind == "level":
                value = value if isinstance(value, dict) else {"$eq": value}
                bad = [op for op in value if op.lower() not in _COMPARE]
                if bad:
                    raise ValueError(f"unknown level conditions {bad}")
                keep = F.lit(True)
                for op, n in value.items():
                    keep = keep & _COMPARE[op.lower()](F.col("level"), F.lit(n))
                df = among(df, levels(forest).where(keep).select(F.col("id").alias(key)).distinct(), key)
            else:
                df = among(df, self._walk(kind, value).select(F.col("id").alias(key)), key)
        return df

    def _walk(self, kind: str, value: Any) -> DataFrame:
        forest = self._forest()
        if kind == "descendants":
            ids, max_depth, include, polymorphic = value
            return descendants(forest, self._listed(ids), self._depth(max_depth), include, None if polymorphic else self.view)
        if kind == "ancestors":
            return ancestors(forest, self._listed(value[0]), self._depth(value[1]), through=None if value[2] else self.view)
        condition, view, max_depth = value
        walk = descendants if kind == "has_ancestor" else ancestors
        return walk(forest, self._matching(condition, view), self._depth(max_depth))

    def with_ancestors(self) -> DataFrame:
        """The matching objects and all objects above them, each once, of any scheme."""
        forest = self._forest()
        matched = stored(self.df().select(F.col(self.view.id).alias("id")), "matched")
        ids = ancestors(forest, matched, include_seeds=True).select(F.col("id").alias(forest.id))
        return among(forest.df, ids, forest.id)

    def root_list(self) -> DataFrame:
        """The roots above, or among, the matching objects."""
        return self.with_ancestors().where(F.col(self._forest().parent).isNull())


def path_to_root(view: View, node: Any) -> DataFrame:
    """The node and everything above it, from the root down."""
    walk = ancestors(view, view.df.where(F.col(view.id) == node).select(F.col(view.id).alias("id")), include_seeds=True)
    return view.df.join(F.broadcast(walk.withColumnRenamed("id", view.id)), view.id).orderBy(F.desc("depth")).drop("depth")


def load_tree(view: View, node: Any, max_depth: int | None = None, through: View | None = None) -> DataFrame:
    """The node (at depth 0) and everything below it, as far as max_depth, with depth and the ids of children that are there too."""
    seeds = view.df.where(F.col(view.id) == node).select(F.col(view.id).alias("id"))
    found = small(stored(descendants(view, seeds, max_depth, True, through), "tree").withColumnRenamed("id", view.id))
    rows = view.df.join(found, view.id)
    below = rows.where("depth > 0").groupBy(F.col(view.parent).alias("_up")).agg(F.array_sort(F.collect_list(view.id)).alias("children"))
    none = F.array().cast(below.schema["children"].dataType)
    return rows.join(below, F.col(view.id) == F.col("_up"), "left").drop("_up").withColumn("children", F.coalesce("children", none))


def _in_order(order: str, id: str) -> list[Column]:
    """What nodes with level and path are ordered by."""
    if order == "depth_first":
        return [F.col("path")]
    if order == "breadth_first":
        return [F.col("level"), F.col(id)]
    if order == "post_order":
        # A subtree's end comes behind all its descendants: a path is followed by something above all ids.
        return [F.concat("path", F.array(F.lit(2**63 - 1)))]
    raise ValueError(f"unknown order {order}")


def flattened(view: View, name: str | None = None, order: str = "depth_first") -> DataFrame:
    """All nodes with level, path of ids and, if a name column is given, breadcrumbs; in depth-first or breadth-first order."""
    keys = _in_order(order, view.id)
    found = levels(view, with_path=True).withColumnRenamed("id", view.id)
    df = view.df.join(found, view.id)
    if name:
        names = view.df.select(F.col(view.id).alias("step"), F.col(name).cast("string").alias("label"))
        steps = found.select(view.id, F.posexplode("path").alias("at", "step")).join(names, "step")
        crumbs = steps.groupBy(view.id).agg(F.array_sort(F.collect_list(F.struct("at", "label"))).alias("steps"))
        crumbs = crumbs.select(view.id, F.array_join(F.transform("steps", lambda s: s["label"]), " > ").alias("breadcrumbs"))
        df = df.join(crumbs, view.id, "left")
    return df.orderBy(*keys)


def places(view: View, order: str = "depth_first") -> DataFrame:
    """id, and the place of each node from 1 on when all are flattened; no task has all of them."""
    keys = {f"_key_{k}": c for k, c in enumerate(_in_order(order, "id"))}
    found = levels(view, with_path=True).select("id", *[c.alias(k) for k, c in keys.items()])
    return numbered(found, "place", *keys).select("id", "place")


def subtree_sizes(view: View) -> DataFrame:
    """id, subtree_size (itself included) and height (levels below it) of every node."""
    walk = _walk(_pointers(links(view)))
    sums = walk.state.select("id", F.lit(1).cast("long").alias("subtree_size"), F.lit(0).cast("long").alias("height"))
    span = 1  # the sums are of the nodes less than `span` steps below
    for _ in range(walk.most):
        linked = walk.state.where("up is not null")
        if not walk.live:
            return sums.select("id", "subtree_size", F.col("height").cast("int").alias("height"))
        below = linked.join(sums, "id").groupBy("up").agg(F.sum("subtree_size").alias("more"), (F.max("height") + span).alias("far"))
        sums = stored(
            sums.join(below.withColumnRenamed("up", "id"), "id", "left").select(
                "id", (F.col("subtree_size") + F.coalesce("more", F.lit(0))).alias("subtree_size"), F.greatest("height", "far").alias("height")
            ),
            "sums",
        )
        walk = _along(walk)
        span *= 2
    raise ValueError("the parent links have a cycle")


def unbalanced(view: View, most: int = 1) -> DataFrame:
    """id of the nodes whose children's subtrees differ in height by more than ``most``; a tree without any is balanced."""
    heights = subtree_sizes(view).select("id", "height")
    spread = links(view).join(heights, "id").where("parent_id is not null").groupBy("parent_id").agg((F.max("height") - F.min("height")).alias("spread"))
    return spread.where(F.col("spread") > most).select(F.col("parent_id").alias("id"))


def statistics(view: View) -> DataFrame:
    """One row: total, roots, leaves, orphans, max_depth and average children of nodes that have any."""
    nodes = links(view)
    found = levels(view)
    known = nodes.select(F.col("id").alias("parent_id"))
    children = stored(nodes.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("n")), "children")
    total = nodes.agg(F.count("*").alias("total"), F.count_if(F.col("parent_id").isNull()).alias("roots"))
    leaves = apart(nodes, _ids(nodes, "parent_id"), "id").agg(F.count("*").alias("leaves"))
    orphans = children.join(known, "parent_id", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans"))
    depth = found.agg(F.max("level").alias("max_depth"))
    fan = children.join(known, "parent_id", "left_semi").agg(F.avg("n").alias("avg_children"))
    out = total
    for one in (leaves, orphans, depth, fan):  # each has one row
        out = out.crossJoin(one)
    return out


def integrity_errors(view: View) -> DataFrame:
    """id, problem: ids that are there twice, parents that are not there, nodes that are their own parents."""
    nodes, n = stored_with(links(view), "links", n=F.count("*"))
    parents = nodes.where("parent_id is not null").groupBy("parent_id").agg(F.lit(0).alias("there"))
    # Each id and each parent meet in one shuffle; ids are hardly ever equal, so they are counted behind it only.
    met = nodes.select("id", F.lit(1).alias("there")).union(parents).repartition(tasks(n["n"]), "id")
    wrong, n = stored_with(met.groupBy("id").agg(F.sum("there").alias("n")).where("n <> 1"), "wrong", lost=F.count_if(F.col("n") == 0))
    twice = wrong.where("n > 1").select("id", F.lit("duplicate id").alias("problem"))
    missing = wrong.where("n = 0").select(F.col("id").alias("parent_id"))
    missing = F.broadcast(missing) if n["lost"] <= BROADCAST_ROWS else missing
    lost = nodes.join(missing, "parent_id").select("id", F.lit("missing parent").alias("problem"))
    own = nodes.where("id = parent_id").select("id", F.lit("own parent").alias("problem"))
    return twice.union(lost).union(own)


def move(view: View, node: Any, new_parent: Any) -> DataFrame:
    """All objects, one with another parent; the parent must be there and not below the node."""
    df = view.df
    if new_parent is not None:
        if df.where(F.col(view.id) == new_parent).isEmpty():
            raise ValueError(f"no object {new_parent}")
        below = descendants(view, df.where(F.col(view.id) == node).select(F.col(view.id).alias("id")), include_seeds=True)
        if not below.where(F.col("id") == new_parent).isEmpty():
            raise ValueError("the new parent is below the node")
    moved = F.when(F.col(view.id) == node, F.lit(new_parent)).otherwise(F.col(view.parent))
    return df.withColumn(view.parent, moved.cast(df.schema[view.parent].dataType))


def without_subtree(view: View, node: Any) -> DataFrame:
    """All objects but a node and everything below it."""
    seeds = view.df.where(F.col(view.id) == node).select(F.col(view.id).alias("id"))
    gone = descendants(view, seeds, include_seeds=True)
    return apart(view.df, small(gone.select(F.col("id").alias(view.id))), view.id)


def create_child(view: View, parent: Any, values: dict[str, Any]) -> DataFrame:
    """All objects and a new one below the parent, which must be there."""
    if view.df.where(F.col(view.id) == parent).isEmpty():
        raise ValueError(f"no object {parent}")
    row = {**dict.fromkeys(view.df.columns), **values, view.parent: parent}
    return view.df.unionByName(view.df.sparkSession.createDataFrame([row], view.df.schema))


def is_ancestor(view: View, upper: Any, lower: Any) -> bool:
    walk = ancestors(view, view.df.where(F.col(view.id) == lower).select(F.col(view.id).alias("id")))
    return not walk.where(F.col("id") == upper).isEmpty()

