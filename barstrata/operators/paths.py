"""Walks along successor pointers, by pointer doubling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.bars import written


def reachable(links: DataFrame, starts: DataFrame, key: Sequence[str] = ("symbol", "tf")) -> DataFrame:
    """(key, at) of every node that a walk along ``links`` (key, at, to) visits from ``starts`` (key, at).

    Each node has at most one successor, later than itself. Every round doubles the length
    of the pointers and so of the walks that are known: a walk of n nodes takes log2(n)
    rounds of two joins, and no series is one task's loop. A null successor ends a walk.
    """
    node = [*key, "at"]
    jump = written(links.where("to is not null").select(*node, "to"), "jumps")
    seen = written(starts.select(*node).distinct(), "walked")
    while not jump.isEmpty():
        ahead = seen.join(jump, node).select(*key, F.col("to").alias("at"))
        # The rows are dealt anew, as a union may be taken for partitioned when it is not.
        seen = written(seen.unionByName(ahead).repartition(*node).distinct(), "walked")
        far = jump.select(*key, F.col("at").alias("to"), F.col("to").alias("__far"))
        jump = written(jump.join(far, [*key, "to"]).select(*node, F.col("__far").alias("to")), "jumps")
    return seen
