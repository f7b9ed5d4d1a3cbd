"""Where queries register themselves with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.sources.corpus import documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Queries whose result has no SQL form.
ROWS_ONLY = {
    "token_bucket", "consistency_tracker", "spell_suggestions", "rewrite_budgeted", "wordpiece_ids", "spell_decisions",
}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf)


long = lambda *names: [F.col(n).cast("long").alias(n) for n in names]
SPAN = ("start", "stop")
