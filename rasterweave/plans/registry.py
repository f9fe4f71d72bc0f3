"""Registry of queries: a Spark plan, the survey entries it covers and its DuckDB check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from rasterweave.plans.views import Views, check_sql

Plan = Callable[[Views], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    plan: Plan
    check: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.plan(Views(spark, folder))


QUERIES: dict[str, Query] = {}


def query(covers: str, views: str = "", check: str | None = None) -> Callable[[Plan], Plan]:
    """Register the decorated plan under its function name.

    ``covers`` lists survey ids, ``views`` the views and tables the check reads.
    """

    def register(plan: Plan) -> Plan:
        name = plan.__name__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        text = check_sql(check, tuple(views.split())) if check else None
        QUERIES[name] = Query(name, tuple(covers.split()), plan, text)
        return plan

    return register
