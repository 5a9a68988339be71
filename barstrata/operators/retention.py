"""What may be forgotten: runs and superseded facts that nothing kept points at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prunable_runs(runs: DataFrame, referenced: DataFrame, before: Column) -> DataFrame:
    """The rows of ``runs`` (run_id, engine, run_at, status) that nothing needs.

    Kept are failed runs, each engine's last one, those from ``before`` on and those that
    ``referenced`` (run_id) names. One partial aggregation and a join by run.
    """
    last = runs.groupBy("engine").agg(F.max(F.struct("run_at", "run_id")).alias("__last"))
    old = runs.where((F.col("status") == "PASS") & (F.col("run_at") < before))
    spare = old.join(last, "engine").where(F.struct("run_at", "run_id") != F.col("__last")).select(*runs.columns)
    return spare.join(referenced.select("run_id").where("run_id is not null").distinct(), "run_id", "left_anti").select(*runs.columns)


def prunable_facts(facts: DataFrame, current: dict[str, str], before: Column, named: DataFrame, kind: str = "zone") -> DataFrame:
    """The rows of ``facts`` (kind, algo_version, confirmed_at, ref) of a derived kind that are of
    another version than the ``current`` one and older than ``before``.

    A fact of ``kind`` whose ref a lasting fact names (``named``: ref) stays in every version, as
    names carry none. A kind without a current version is never pruned. The few versions are a map.
    """
    live = F.create_map(*[F.lit(x) for pair in current.items() for x in pair])[F.col("kind")]
    old = facts.where((F.col("algo_version") != live) & (F.col("confirmed_at") < before))
    held = named.select(F.lit(kind).alias("kind"), "ref").distinct()
    return old.join(held, ["kind", "ref"], "left_anti").select(*facts.columns)
