"""Registry of the queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohort_ledger.plans.dataset import Model
from cohort_ledger.plans.sql_model import with_model

PLANS: dict[str, Callable[[Model], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan over the model, and the SQL that must give the same rows."""

    def add(plan: Callable[[Model], DataFrame]):
        if name in PLANS:
            raise ValueError(f"query {name!r} is registered twice")
        PLANS[name] = plan
        if sql is not None:
            SQL[name] = with_model(sql)
        return plan

    return add


def run(name: str, spark: SparkSession, folder: str, mapped: str | None = None) -> DataFrame:
    return PLANS[name](Model(spark, folder, mapped))


def load() -> None:
    """Import every module that registers queries."""
    from cohort_ledger.plans import (  # noqa: F401
        q_active,
        q_files,
        q_graph,
        q_ingest,
        q_qc,
        q_status,
        q_validate,
    )
