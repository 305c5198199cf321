"""Expression trees as plain data, and operators to write them in Python.

A tree is JSON: ``{"$field": path}``, ``{"$const": value}`` or ``{"$name": argument(s)}``.
``field("Age") > 30`` builds the same data as a hand-written filter.
"""

from __future__ import annotations

from typing import Any


class Node:
    """A tree; operators give larger trees."""

    def __init__(self, tree: Any) -> None:
        self.tree = tree

    def __repr__(self) -> str:
        return f"Node({self.tree!r})"

    def _with(self, name: str, *others: Any) -> Node:
        return Node({name: [self.tree, *map(tree_of, others)]})

    def __eq__(self, other: Any) -> Node:  # type: ignore[override]
        return Node({"$isNull": self.tree}) if other is None else self._with("$eq", other)

    def __ne__(self, other: Any) -> Node:  # type: ignore[override]
        return Node({"$notNull": self.tree}) if other is None else self._with("$ne", other)

    __hash__ = None  # type: ignore[assignment]

    def __lt__(self, other: Any) -> Node:
        return self._with("$lt", other)

    def __le__(self, other: Any) -> Node:
        return self._with("$lte", other)

    def __gt__(self, other: Any) -> Node:
        return self._with("$gt", other)

    def __ge__(self, other: Any) -> Node:
        return self._with("$gte", other)

    def __and__(self, other: Any) -> Node:
        return self._with("$and", other)

    def __or__(self, other: Any) -> Node:
        return self._with("$or", other)

    def __invert__(self) -> Node:
        return Node({"$not": self.tree})

    def __add__(self, other: Any) -> Node:
        return self._with("$concat" if isinstance(other, str) else "$add", other)

    def __sub__(self, other: Any) -> Node:
        return self._with("$sub", other)

    def __mul__(self, other: Any) -> Node:
        return self._with("$mul", other)

    def __truediv__(self, other: Any) -> Node:
        return self._with("$div", other)

    def __mod__(self, other: Any) -> Node:
        return self._with("$mod", other)

    def __neg__(self) -> Node:
        return Node({"$neg": self.tree})

    def is_in(self, values: list) -> Node:
        return Node({"$in": [self.tree, list(values)]})

    def between(self, low: Any, high: Any) -> Node:
        return self._with("$between", low, high)

    def contains(self, text: str, ignore_case: bool = False) -> Node:
        return Node({"$containsIgnoreCase" if ignore_case else "$contains": [self.tree, text]})

    def starts_with(self, text: str, ignore_case: bool = False) -> Node:
        return Node({"$startsWithIgnoreCase" if ignore_case else "$startsWith": [self.tree, text]})

    def ends_with(self, text: str, ignore_case: bool = False) -> Node:
        return Node({"$endsWithIgnoreCase" if ignore_case else "$endsWith": [self.tree, text]})

    def matches(self, pattern: str) -> Node:
        return Node({"$regex": [self.tree, pattern]})

    def or_else(self, *others: Any) -> Node:
        return self._with("$coalesce", *others)


def tree_of(x: Any) -> Any:
    return x.tree if isinstance(x, Node) else x


def field(path: str) -> Node:
    return Node({"$field": path})


def const(value: Any) -> Node:
    return Node({"$const": value})


def call(name: str, *arguments: Any) -> Node:
    """Any function of the scalar table by name, with or without the leading ``$``."""
    name = name if name.startswith("$") else f"${name}"
    return Node({name: [tree_of(a) for a in arguments]})


def when(condition: Any, then: Any, otherwise: Any = None) -> Node:
    return Node({"$if": [tree_of(condition), tree_of(then), tree_of(otherwise)]})
