"""Query registry: a DataFrame plan and, where SQL can say it, an independent SQL statement of the same result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}  # views the statements build on, by name


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql.strip()


def with_views(body: str) -> str:
    """Prefix ``body`` with the definitions of the views it names, dependencies first."""
    found: list[str] = []

    def visit(sql: str) -> None:
        for name in re.findall(r"\bt_\w+", sql):
            if name in VIEWS and name not in found:
                visit(VIEWS[name])
                if name not in found:
                    found.append(name)

    visit(body)
    head = ",\n".join(f"{n} as ({VIEWS[n]})" for n in found)
    body = body.strip()
    if not head:
        return body
    if body[:15].lower().startswith("with recursive "):
        return f"with recursive {head},\n{body[15:]}"
    if body[:5].lower() == "with ":
        return f"with {head},\n{body[5:]}"
    return f"with {head}\n{body}"


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


def out(df: DataFrame, *cols: str, **exprs) -> DataFrame:
    """Select result columns; integers become BIGINT so that both engines report one type."""
    types = dict(df.dtypes)
    sel = [F.col(c).cast("long").alias(c) if types[c] in ("int", "smallint", "tinyint") else F.col(c) for c in cols]
    sel += [v.alias(k) for k, v in exprs.items()]
    res = df.select(*sel)
    return res.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in res.dtypes])
