"""All queries of the analytics operators."""

from __future__ import annotations

from . import derived, features, matching, models, plots, relations, scores  # noqa: F401  they register queries
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
