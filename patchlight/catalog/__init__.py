"""Registered queries: each operator over the given tables, with a DuckDB twin where SQL can say it."""

from patchlight.catalog.base import QUERIES, oracle  # noqa: F401
from patchlight.catalog import ctes  # noqa: F401
from patchlight.catalog import (  # noqa: F401
    q_checks, q_diff, q_findings, q_graph, q_imports, q_names, q_scoring, q_sinks, q_sources, q_streams,
)
