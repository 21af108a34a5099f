"""Registry of named queries: a Spark plan over the fixture tables plus its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from shelfsight.plans.duck import with_views
from shelfsight.session import ensure_utc
from shelfsight.sources.fixtures import Fixtures


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[Fixtures], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_utc(spark)
        return self.plan(Fixtures(spark, sf_dir))


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(plan: Callable[[Fixtures], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, plan, with_views(sql) if sql else None)
        return plan

    return register
