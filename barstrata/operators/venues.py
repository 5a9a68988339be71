"""One universe from several venues: one listing an underlying, refusals of thin rankings, shadow members, drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.trading import base_asset, venue_for
from .joins import asof

# Later venues win an underlying; the venue that is only watched; the share of the
# listed symbols that a ranking must know; the drift that is told and how old its reference may be.
PRECEDENCE = ("coinbase-spot", "phemex-perp", "kraken-perp")
SHADOW = "kraken-perp"
MIN_COVERAGE = 0.97
DRIFT, DRIFT_TF, DRIFT_BARS = 0.03, 900, 2


def one_per_base(listings: DataFrame, precedence: Sequence[str] = PRECEDENCE) -> DataFrame:
    """(look, base, symbol, volume): of the listings (symbol, look, volume) of an underlying the one of
    the last venue; on one venue the deeper. Venues that are not named have no part."""
    venue = venue_for(F.col("symbol"))
    place = F.array_position(F.array(*[F.lit(v) for v in precedence]), venue)
    known = listings.withColumns({"base": base_asset(F.col("symbol")), "__place": place}).where("__place > 0 and volume is not null")
    best = known.groupBy("look", "base").agg(F.max(F.struct("__place", "volume", "symbol")).alias("x"))
    return best.select("look", "base", "x.symbol", "x.volume")


def refreshes(listings: DataFrame, step: int, least: float = MIN_COVERAGE) -> DataFrame:
    """(look, listed, answered, coverage, taken, standing) of every look from the first to the last.

    A symbol is listed from its first row on and answers where it has a volume. A look that
    knows too few is not taken; ``standing`` is the last one taken, null before the first.
    Looks are one row each before they are ordered.
    """
    lives = listings.groupBy("symbol").agg(F.min("look").alias("a"))
    end = listings.agg(F.max("look").alias("b"))
    # One row of one number.
    grid = lives.join(F.broadcast(end)).select("symbol", F.explode(F.sequence("a", "b", F.lit(step).cast("long"))).alias("look"))
    told = (
        grid.join(listings.where("volume is not null").select("symbol", "look", F.lit(True).alias("__here")), ["symbol", "look"], "left")
        .groupBy("look")
        .agg(F.count("*").alias("listed"), F.count("__here").alias("answered"))
        .withColumn("coverage", F.col("answered") / F.col("listed"))
        .withColumn("taken", F.col("coverage") >= least)
    )
    order = Window.partitionBy(F.lit(0)).orderBy("look").rowsBetween(Window.unboundedPreceding, 0)
    return told.withColumn("standing", F.last(F.when(F.col("taken"), F.col("look")), ignorenulls=True).over(order))


def members(listings: DataFrame, seeds: Sequence[str], top_n: int, min_volume: float, min_history: int) -> DataFrame:
    """(look, symbol, base, rank, state, reason, n): every look's members.

    The traded venues' underlyings are ranked by volume, each once; those past the ranks go.
    A seed whose underlying is no member is an anchor without a rank. Listings of the shadow
    venue above the floor ride along as SHADOW and take no rank. ``n`` counts the looks so far.
    """
    so_far = Window.partitionBy("symbol").orderBy("look").rowsBetween(Window.unboundedPreceding, 0)
    counted = listings.withColumn("n", F.count("volume").over(so_far))
    own = counted.select("symbol", "look", "n")
    # A look's candidates are the listed underlyings.
    place = F.row_number().over(Window.partitionBy("look").orderBy(F.desc("volume"), "symbol")).cast("long")
    ranked = one_per_base(listings, [v for v in PRECEDENCE if v != SHADOW]).withColumn("rank", place).where(F.col("rank") <= top_n).join(own, ["symbol", "look"])
    seed, warm = F.col("symbol").isin(*seeds), F.col("n") >= min_history
    poor = (F.col("volume") < min_volume) & ~seed
    state = F.when(poor, "REJECTED").when(~warm, "WARMING").otherwise("ADMITTED")
    reason = F.when(poor, "below_liquidity_floor").when(~warm, "insufficient_history").otherwise("liquid_and_warm")
    columns = ["look", "symbol", "base", "rank", "state", "reason", "n"]
    ranked = ranked.withColumns({"state": state, "reason": reason}).select(*columns)
    anchors = listings.select("look").distinct().withColumn("symbol", F.explode(F.array(*[F.lit(s) for s in seeds])))
    anchors = anchors.withColumn("base", base_asset(F.col("symbol"))).join(ranked.select("look", "base"), ["look", "base"], "left_anti")
    # A seed has its looks so far, whether it answers this time or not.
    anchors = asof(anchors, own, ["symbol"], "look", "look", ["n"]).na.fill(0, ["n"])
    anchors = anchors.withColumns({"rank": F.lit(None).cast("long"), "state": F.when(warm, "ADMITTED").otherwise("WARMING"), "reason": F.lit("seed_anchor")})
    watched = one_per_base(listings, [SHADOW]).where(F.col("volume") >= min_volume).join(own, ["symbol", "look"])
    watched = watched.withColumns({"rank": F.lit(None).cast("long"), "state": F.lit("SHADOW"), "reason": F.lit("warming_for_venue_switch")})
    return ranked.unionByName(anchors.select(*columns)).unionByName(watched.select(*columns))


def drifts(ticks: DataFrame, bars: DataFrame, least: float = DRIFT, step: int = DRIFT_TF, age: int = DRIFT_BARS) -> DataFrame:
    """The first price of each bar (symbol, bucket) that is off the last closed bar's close by ``least``.

    ``ticks`` have symbol, look (seconds), seq and price; a reference that closed more than
    ``age`` bars before counts as none.
    """
    closed = bars.select("symbol", (F.col("open_ts") + step).alias("known"), "close")
    told = asof(ticks, closed, ["symbol"], "look", "known", ["close"], max_age=age * step)
    off = (F.col("price") - F.col("close")) / F.col("close")
    found = told.withColumns({"drift": off, "bucket": F.col("look") - F.col("look") % step}).where(F.abs("drift") >= least)
    first = F.min_by(F.struct("look", "price", "close", "drift"), F.struct("look", "seq"))
    return found.groupBy("symbol", "bucket").agg(first.alias("x")).select("symbol", "bucket", "x.*")
