"""Functions stored as a table (scheme_id, name, parameters, returns, body), as SQL functions of the session.

A body is a SQL expression over the parameters (``x BIGINT, y STRING``), so it stays inside the
optimiser: a call is replaced by the expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"^[A-Za-z_]\w*$")


def register(functions: DataFrame, scheme_id: int | None = None) -> list[str]:
    """Makes the functions, of one scheme or of all, and returns their names; one of the same name is replaced."""
    rows = functions if scheme_id is None else functions.where(F.col("scheme_id") == scheme_id)
    names = []
    for r in rows.orderBy("name").collect():  # definitions, a row each
        if not _NAME.match(r.name):
            raise ValueError(f"{r.name} is no identifier")
        functions.sparkSession.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {r.name}({r.parameters}) RETURNS {r.returns} RETURN {r.body}")
        names.append(r.name)
    return names


def operators(names: list[str], scalar: Callable[[Any], Column]) -> dict[str, Callable[[Any], Column]]:
    """Extra operators of a compiler: ``{"$name": [arguments]}`` calls the function; scalar compiles an argument."""

    def of(name: str) -> Callable[[Any], Column]:
        return lambda args: F.call_function(name, *[scalar(x) for x in (args if isinstance(args, (list, tuple)) else [args])])

    return {f"${name.lower()}": of(name) for name in names}
