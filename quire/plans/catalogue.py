"""All queries outside the subpackage for training data."""

from __future__ import annotations

from quire.plans import documents, files, planted, retrieval, rules, tables  # noqa: F401  they register their queries
from quire.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
