"""Registry of queries over the given tables and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, tuple[str, tuple[str, ...]]] = {}
# named SQL fragments: name -> (body, names it needs)
FRAGMENTS: dict[str, tuple[str, tuple[str, ...]]] = {}


def fragment(name: str, body: str, *needs: str) -> None:
    FRAGMENTS[name] = (body, needs)


def sql(body: str, *needs: str) -> str:
    """Prefix a SELECT with the fragments it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in FRAGMENTS[name][1]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    parts = [f"{n} AS (\n{FRAGMENTS[n][0].strip()}\n)" for n in order]
    body = body.strip()
    head = "WITH " + ",\n".join(parts) if parts else ""
    if parts and body.startswith("WITH RECURSIVE "):
        head, body = head.replace("WITH ", "WITH RECURSIVE ", 1) + ",", body[len("WITH RECURSIVE "):]
    elif parts and body.startswith("WITH "):
        head, body = head + ",", body[len("WITH "):]
    return _lambdas(f"{head}\n{body}".strip())


def _lambdas(text: str) -> str:
    """Spell ``x -> expr`` the way the current SQL dialect wants it."""
    text = re.sub(r"\((\w+), (\w+)\) -> ", r"lambda \1, \2: ", text)
    return re.sub(r"\b(\w+) -> ", r"lambda \1: ", text)


def query(name: str, oracle: str | None = None, needs: tuple[str, ...] = ()):
    """Register a query; ``oracle`` is the SELECT that must give the same rows."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = (oracle, needs)
        return fn

    return wrap
