"""One-to-one matching within tolerances: earlier rows choose first, each takes its first free partner."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.bars import written


def candidates(wanted: DataFrame, found: DataFrame, key: Sequence[str], price_share: float) -> DataFrame:
    """(key, w, f) pairs of ``wanted`` (key, w, time, price, tolerance) and ``found`` (key, f, time,
    price) within the time tolerance and ``price_share`` of the wanted price, by bins of time."""
    width = wanted.groupBy(*key).agg(F.greatest(F.max("tolerance"), F.lit(1)).alias("width"))
    bin_of = lambda c: F.floor(c / F.col("width"))
    left = wanted.join(width, list(key)).select(
        *key, "w", F.col("time").alias("wt"), F.col("price").alias("wp"), "tolerance",
        F.explode(F.sequence(bin_of(F.col("time") - F.col("tolerance")), bin_of(F.col("time") + F.col("tolerance")))).alias("bin"),
    )
    right = found.join(width, list(key)).select(*key, "f", F.col("time").alias("ft"), F.col("price").alias("fp"), bin_of(F.col("time")).alias("bin"))
    near = (F.abs(F.col("ft") - F.col("wt")) <= F.col("tolerance")) & (F.abs(F.col("fp") - F.col("wp")) / F.col("wp") <= price_share)
    return left.join(right, [*key, "bin"]).where(near).select(*key, "w", "f").distinct()


def greedy_match(pairs: DataFrame, key: Sequence[str]) -> DataFrame:
    """The pairs that are taken when the w of a key choose in their order, each the least f
    that is left.

    A pair is safe when each is the other's best of those left; all safe pairs are taken at
    once, and their rivals' pairs go. The first w of a key always has a safe pair, so this
    ends, and after as many rounds as the longest chain of rivals; the rounds' tables are
    written to the shared folder.
    """
    keys = list(key)
    left = written(pairs.select(*keys, "w", "f").distinct(), "match-pairs")
    taken = None
    while not left.isEmpty():
        best_f = left.groupBy(*keys, "w").agg(F.min("f").alias("f"))
        best_w = left.groupBy(*keys, "f").agg(F.min("w").alias("w"))
        safe = written(best_f.join(best_w, [*keys, "w", "f"]), "matched")
        taken = safe if taken is None else taken.unionByName(safe)
        left = written(left.join(safe.select(*keys, "w"), [*keys, "w"], "left_anti").join(safe.select(*keys, "f"), [*keys, "f"], "left_anti"), "match-pairs")
    return left if taken is None else written(taken, "matched-all")
