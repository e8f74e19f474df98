"""Registry of runnable queries and, beside each, the same question as plain SQL over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crivo.session import ship
from crivo.sources.views import CORPUS_ALL_SQL, CORPUS_SQL, VECTORS_SQL, WEB_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_VIEWS = {"corpus": CORPUS_SQL, "corpus_all": CORPUS_ALL_SQL, "web": WEB_SQL, "vectors": VECTORS_SQL}


def query(name: str, sql: str | None = None, views: str = "", ctes: str = ""):
    """Register a query; `views` names the canonical views the SQL needs, `ctes` adds further ones."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            parts = [_VIEWS[v] for v in views.split()] + ([ctes] if ctes else [])
            ORACLE[name] = (f"WITH {', '.join(parts)} " if parts else "") + sql
        return fn

    return register


def pct(num: str, den: str, digits: int = 2) -> str:
    return f"round_even(CASE WHEN ({den})<>0 THEN 100*({num})::DOUBLE/({den})::DOUBLE ELSE 0::DOUBLE END, {digits})"


def div(num: str, den: str) -> str:
    return f"(CASE WHEN ({den})<>0 THEN ({num})::DOUBLE/({den})::DOUBLE ELSE 0::DOUBLE END)"


def head(key: str, seed: str, digits: int) -> str:
    """BIGINT of the first hex digits of md5('seed:key')."""
    return f"(('0x'||substr(md5('{seed}:'||{key}),1,{digits}))::BIGINT)"
