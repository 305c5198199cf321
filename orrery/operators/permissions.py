"""Row permissions inherited along a tree.

A permission (id_ref, user_id or role_id, select, insert, update, delete) holds for an object
and everything below it, unless a nearer ancestor has one for the same user; id_ref 0 holds
for all objects that have no nearer one.  A user's own permission goes before a role's.  User 0
may do everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.paths import View
from ..plans.stored import among, small
from .tree import _along, _pointers, _walk, links

ACTIONS = ("select", "insert", "update", "delete")


def effective(view: View, permissions: DataFrame, user: int, user_roles: DataFrame | None = None) -> DataFrame:
    """id, and whether the user may do each action with it."""
    if user == 0:
        return view.df.select(F.col(view.id).alias("id"), *[F.lit(True).alias(a) for a in ACTIONS])
    mine = F.col("user_id") == user
    if user_roles is not None:
        roles = [r.role_id for r in user_roles.where(F.col("user_id") == user).select("role_id").distinct().collect()]  # of one user
        mine = mine | F.col("role_id").isin(roles)
    own = permissions.where(mine).select("id_ref", F.col("user_id").isNull().cast("int").alias("by_role"), *ACTIONS)
    best = own.groupBy("id_ref").agg(F.min_by(F.struct(*ACTIONS), "by_role").alias("granted"))
    known = small(best)
    # The nearest object with a permission, on the way up from each one, itself included.
    state = _pointers(links(view)).join(known.select(F.col("id_ref").alias("mark")), F.col("id") == F.col("mark"), "left").select("id", "up", "mark")
    found = _nearest(state).select("id", F.coalesce("mark", F.lit(0)).alias("id_ref")).join(known, "id_ref", "left")
    return found.select("id", *[F.coalesce(f"granted.{a}", F.lit(False)).alias(a) for a in ACTIONS])


def _nearest(state: DataFrame) -> DataFrame:
    """Each node's mark, or that of the nearest above it that has one."""
    walk = _walk(state)
    for _ in range(walk.most):
        if not walk.live:
            return walk.state
        walk = _along(walk, mark=F.coalesce("mark", "up_mark"))
    raise ValueError("the parent links have a cycle")


def allowed(view: View, permissions: DataFrame, user: int, action: str = "select", user_roles: DataFrame | None = None) -> DataFrame:
    """The objects that a user may read (or whatever the action is)."""
    if action not in ACTIONS:
        raise ValueError(f"unknown action {action}")
    ids = effective(view, permissions, user, user_roles).where(F.col(action)).select(F.col("id").alias(view.id))
    return among(view.df, ids.distinct(), view.id)


_SUBJECT = ("id_ref", "user_id", "role_id")


def grant(permissions: DataFrame, new: DataFrame) -> DataFrame:
    """The permissions and the new ones (all columns); one of the same object and user, or role, is replaced."""
    wrong = new.where(F.col("user_id").isNull() == F.col("role_id").isNull())
    if not wrong.isEmpty():
        raise ValueError("a permission is of a user or of a role")
    return _without(permissions, new).unionByName(new.select(permissions.columns))


def revoke(permissions: DataFrame, gone: DataFrame) -> DataFrame:
    """The permissions without those of these objects and users, or roles; without a column id_ref, of all objects."""
    return _without(permissions, gone)


def _without(permissions: DataFrame, others: DataFrame) -> DataFrame:
    names = [c for c in _SUBJECT if c in others.columns]
    keys = small(others.select([F.col(c).alias(f"_{c}") for c in names]).distinct())
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return permissions.join(keys, same, "left_anti")


def for_new_children(view: View, permissions: DataFrame, parents: DataFrame) -> DataFrame:
    """The permissions, and for each of ``parents`` (a column id; objects that got a child) without one a copy of the nearest above it, or of the global one.

    Of several of the nearest object a user's goes before a role's, and then that of the smallest id.
    """
    own = permissions.select(F.col("id_ref").alias("id")).distinct()
    bare = parents.select("id").distinct().join(own, "id", "left_anti")
    mark = F.col("id_ref").alias("mark")
    known = small(permissions.select(mark).distinct())
    state = _nearest(_pointers(links(view)).join(known, F.col("id") == F.col("mark"), "left").select("id", "up", "mark"))
    order = F.struct(F.col("user_id").isNull(), F.coalesce("user_id", "role_id"))
    best = permissions.groupBy("id_ref").agg(F.min_by(F.struct(*[c for c in permissions.columns if c != "id_ref"]), order).alias("_best"))
    copied = bare.join(state, "id").select("id", F.coalesce("mark", F.lit(0)).alias("id_ref")).join(small(best), "id_ref")
    copied = copied.select(F.col("id").cast(permissions.schema["id_ref"].dataType).alias("id_ref"), "_best.*")
    return permissions.unionByName(copied.select(permissions.columns))


def of_user(permissions: DataFrame, user: int) -> DataFrame:
    return permissions.where(F.col("user_id") == user)


def of_role(permissions: DataFrame, role: int) -> DataFrame:
    return permissions.where(F.col("role_id") == role)


def of_object(permissions: DataFrame, object_id: int) -> DataFrame:
    return permissions.where(F.col("id_ref") == object_id)
