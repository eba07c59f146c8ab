"""All queries of the engine's own operators, with their DuckDB twins."""

from __future__ import annotations

from . import evaluation, experiments, geometry, graph, labelling, matching, sequences, tracking, visibility  # noqa: F401  registers their queries
from .base import ORACLE, SPARK


def queries() -> dict:
    return dict(SPARK)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
