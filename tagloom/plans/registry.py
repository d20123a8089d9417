"""A registry of queries: name -> function of (spark, sf_dir), and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from .views import cte

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, views: str = ""):
    """Register a query under its function's name; `views` names the adapter views that the SQL needs."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = cte(views.split()) + sql
        return f

    return add
