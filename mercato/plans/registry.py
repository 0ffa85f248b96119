"""Registered queries: one Spark callable and one DuckDB oracle text per op.

Every query reads the driver's source tables through the binding views, so
its work grows with them. Column names are aliased identically on both
sides. Nested outputs are compared through flat canonical columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mercato.sources.binding import Domain, bind, with_binding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_BODY: dict[str, tuple] = {}


def register(name: str, oracle: str | None = None, *extra_ctes: tuple[str, str]):
    """Decorator: ``fn(domain) -> DataFrame`` becomes ``queries()[name]``."""

    def deco(fn: Callable[[Domain], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(bind(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = with_binding(oracle, *extra_ctes)
            _BODY[name] = (oracle, *extra_ctes)
        return fn

    return deco


def stored_oracle(name: str) -> str:
    """The oracle text over stored domain tables (``d_*`` exist as tables or views)."""
    return with_binding(*_BODY[name], bound=False)


def load_all() -> None:
    """Import every module that registers queries."""
    from mercato.plans import (  # noqa: F401
        q_catalog, q_changes, q_joins, q_notify, q_orders, q_stats, q_streams,
    )
