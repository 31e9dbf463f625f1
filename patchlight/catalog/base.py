"""Query registry and assembly of oracle SQL from named common tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CTES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def with_ctes(body: str) -> str:
    """Prefix the common tables a statement names, dependencies first."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bc_\w+", text):
            if name in CTES and name not in needed:
                visit(CTES[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS MATERIALIZED (\n{CTES[n]}\n)" for n in needed)
    return f"WITH RECURSIVE {ctes}\n{body}"


def oracle() -> dict[str, str]:
    return {name: with_ctes(body) for name, body in ORACLE.items()}
