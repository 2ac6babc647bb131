"""Registered queries: one entry per operator of the inventory.

``register(name, sql)`` binds a Spark query ``(spark, sf_dir) -> DataFrame``
to the DuckDB SQL that must give the same rows. The SQL is written against
the banking views of ``plans.oracle`` (added as CTEs). Entries without SQL
are checked on row counts only (and by unit tests against brute force).

Parameters of the registered forms (dates, thresholds, search texts) are
the workload's own values where it has them, else ours, chosen once here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Bank
from .oracle import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}

# Clock of the registered forms: the test data ends 2001-08-01 (orders) and
# 2024-01-30 (events), so "today" is an argument, not CURRENT_DATE.
AS_OF_TXN = "2001-08-01"
AS_OF_EVENTS = "2024-01-30"


def register(name: str, sql: str | None = None, same_as: str | None = None):
    """``same_as`` names a query registered before, whose SQL must give the same rows."""
    def deco(fn: Callable[[Bank], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Bank(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        run.__wrapped__ = fn
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = with_views(sql)
        elif same_as is not None:
            _SQL[name] = _SQL[same_as]
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_SQL)


def _load_all() -> None:
    # Importing the catalog modules fills the registry.
    from . import catalog, catalog_jobs  # noqa: F401
