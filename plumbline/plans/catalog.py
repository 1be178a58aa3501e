"""The catalogue of queries of the reference's operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from plumbline.plans import q_aggregates, q_joins, q_ranking, q_records, q_repeat, q_rules, q_scalars, q_sources  # noqa: F401  (they register)
from plumbline.plans.registry import ORACLES, QUERIES


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
