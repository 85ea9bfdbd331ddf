"""The registered queries of the benchmark jobs and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from .plans import content, files, flags, posts, votes, work  # noqa: F401  registers their queries
from .plans.registry import ORACLES, QUERIES


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
