"""Registry of named queries and their checking SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pressmill.plans.binding_sql import VIEWS
from pressmill.session import prepare
from pressmill.sources.bind import Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add


def with_views(sql: str) -> str:
    """Prefix the SQL with the bound views it mentions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for view in VIEWS:
            if view not in needed and re.search(rf"\b{view}\b", text):
                visit(VIEWS[view])
                if view not in needed:
                    needed.append(view)

    visit(sql)
    body = sql.strip()
    if not needed:
        return body
    head = "WITH " + ", ".join(f"{v} AS ({VIEWS[v].strip()})" for v in needed)
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head[5:]}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"{head}, {body[5:]}"
    return f"{head} {body}"


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return QUERIES[name](Tables(spark, sf_dir))

    run.__name__ = name
    return run
