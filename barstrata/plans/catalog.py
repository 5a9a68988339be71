"""Every query of the analytics engine by name, with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query (spark, sf_dir) and, where SQL expresses it, its oracle."""

    def register(plain: Query) -> Query:
        @wraps(plain)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Spark 4.1 can take a union as partitioned like its branches when they are
            # not and lose rows in the join after it; without this it shuffles again.
            spark.conf.set("spark.sql.unionOutputPartitioning", "false")
            return plain(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register
