"""All registered queries of the library and their SQL."""

from __future__ import annotations

from .plans import curation, prompts, streams, visual  # noqa: F401
from .plans.registry import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
