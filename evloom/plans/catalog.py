"""The query catalogue: name -> callable, and the same query as DuckDB SQL."""

from __future__ import annotations

from . import q_measure, q_temporal, q_text  # noqa: F401  (they register their queries)
from .registry import QUERIES, SQL

FLAGSHIP = "evidence_near_batch"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
