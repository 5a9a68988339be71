"""Swing tiers: fractal pivots, reversals, alternation and promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.candles import TF_SECONDS
from .joins import first_beyond
from .series import by_time, rows

#: Reversal of a local swing in ATR; bars until a pivot's held window is censored.
LOCAL_ATR, HELD_BARS = 0.75, 90
# Score weights and the values that earn them in full, tier scores.
WEIGHTS = {"margin": (18, 0.05), "reversal": (24, 15.0), "held": (14, 90.0), "volume": (12, 6.0), "impact": (26, 2.0)}
LIQUIDITY_WEIGHT, DOMINANCE_WEIGHT = 8, 12
MAJOR_SCORE, INTERMEDIATE_SCORE = 55, 30
#: The one tier that structure reads in each timeframe, and the tiers of pools.
STRUCTURE_TIER = {tf: "INTERMEDIATE" for tf in ("5m", "15m", "1H", "4H", "1W")} | {"1D": "MAJOR"}
POOL_TIERS = ("INTERMEDIATE", "MAJOR")


def _pivots():
    return Window.partitionBy("symbol", "tf").orderBy("market_time", "kind")


def seconds(tf: str = "tf"):
    return F.create_map(*[x for k, v in TF_SECONDS.items() for x in (F.lit(k), F.lit(v))])[F.col(tf)].cast("long")


def micro(bars: DataFrame) -> DataFrame:
    """Strict five-bar fractals, known at the close of the second bar after."""
    near = [F.lag("high", 1), F.lag("high", 2), F.lead("high", 1), F.lead("high", 2)]
    low = [F.lag("low", 1), F.lag("low", 2), F.lead("low", 1), F.lead("low", 2)]
    full = (F.lag("i", 2).over(by_time()).isNotNull()) & (F.lead("i", 2).over(by_time()).isNotNull())
    top, bottom = full, full
    for x in near:
        top = top & (F.col("high") > x.over(by_time()))
    for x in low:
        bottom = bottom & (F.col("low") < x.over(by_time()))
    found = bars.withColumns({"top": top, "bottom": bottom, "known": F.lead("open_ts", 2).over(by_time()) + seconds()})
    side = lambda flag, kind, price: F.when(flag, F.struct(F.lit(kind).alias("kind"), F.col(price).alias("price")))
    sides = F.array_compact(F.array(side(F.col("top"), "HIGH", "high"), side(F.col("bottom"), "LOW", "low")))
    return found.withColumn("side", F.explode(sides)).select(
        "symbol", "tf", F.col("open_ts").alias("market_time"), F.col("known").alias("confirmed_at"), "side.kind", "side.price", "i", "atr", "volume",
    )


def local(micro_swings: DataFrame) -> DataFrame:
    """Micro swings whose next opposite one lies at least 0.75 ATR away."""
    after = _pivots().rowsBetween(1, Window.unboundedFollowing)
    item = F.struct("price", "confirmed_at")
    high = F.first(F.when(F.col("kind") == "HIGH", item), ignorenulls=True).over(after)
    low = F.first(F.when(F.col("kind") == "LOW", item), ignorenulls=True).over(after)
    return (
        micro_swings.withColumn("opposite", F.when(F.col("kind") == "HIGH", low).otherwise(high))
        .where(F.col("atr").isNotNull() & (F.abs(F.col("price") - F.col("opposite.price")) >= F.round(LOCAL_ATR * F.col("atr"), 8)))
        .withColumn("confirmed_at", F.col("opposite.confirmed_at"))
        .drop("opposite")
    )


def alternate(pivots: DataFrame) -> DataFrame:
    """Runs of one kind collapse to their most extreme pivot, ties to the earlier;
    the run's last confirmation counts."""
    turn = F.when(F.lag("kind").over(_pivots()) == F.col("kind"), 0).otherwise(1)
    run = F.sum("turn").over(_pivots().rowsBetween(Window.unboundedPreceding, 0))
    rest = [c for c in pivots.columns if c not in ("symbol", "tf", "kind", "confirmed_at")]
    score = F.struct(F.when(F.col("kind") == "HIGH", F.col("price")).otherwise(-F.col("price")), -F.col("market_time"))
    best = (
        pivots.withColumn("turn", turn)
        .withColumn("run", run)
        .groupBy("symbol", "tf", "run", "kind")
        .agg(F.max_by(F.struct(*rest), score).alias("x"), F.max("confirmed_at").alias("confirmed_at"))
    )
    return best.select("symbol", "tf", "kind", "confirmed_at", *[F.col(f"x.{c}").alias(c) for c in rest])


def promote(alternating: DataFrame) -> DataFrame:
    """Pivots more extreme than the same kind on either side; adds margin and next_opposite."""
    left, right = F.lag("price", 2).over(_pivots()), F.lead("price", 2).over(_pivots())
    high = F.col("kind") == "HIGH"
    beats = F.when(high, (F.col("price") > F.col("l")) & (F.col("price") > F.col("r"))).otherwise(
        (F.col("price") < F.col("l")) & (F.col("price") < F.col("r"))
    )
    known = F.greatest("confirmed_at", F.lead("confirmed_at", 1).over(_pivots()), F.lead("confirmed_at", 2).over(_pivots()))
    margin = F.least(F.abs(F.col("price") - F.col("l")) / F.col("l"), F.abs(F.col("price") - F.col("r")) / F.col("r"))
    return (
        alternating.drop("margin", "next_opposite")
        .withColumns({"l": left, "r": right, "next_opposite": F.lead("price", 1).over(_pivots()), "known": known})
        .where(beats)
        .withColumn("confirmed_at", F.col("known"))
        .withColumn("margin", margin)
        .drop("l", "r", "known")
    )


def scored(inter: DataFrame, bars: DataFrame) -> DataFrame:
    """Promoted swings with tier and score, once their held window is closed.

    Structure and pool evidence of the frozen earlier generation is absent, as on a
    fresh store, so those parts are 0.
    """
    major = promote(alternate(inter)).select(
        "symbol", "tf", "market_time", "kind", F.col("margin").alias("m2"), F.col("next_opposite").alias("o2"), F.lit(True).alias("dominant")
    )
    same = Window.partitionBy("symbol", "tf", "kind").orderBy("market_time")
    high = F.col("kind") == "HIGH"
    beyond = first_beyond(inter.withColumn("after", F.col("i")), bars, high, F.col("high"), "price", F.col("low"), "price")
    last = bars.groupBy("symbol", "tf").agg(F.max("i").alias("last_i"))
    ratio = bars.select("symbol", "tf", "i", F.when(F.col("i") >= 20, F.col("volume") / F.avg("volume").over(rows(-20, -1))).alias("vol_ratio"))
    closes = bars.select("symbol", "tf", F.col("i").alias("close_bar"), (F.col("open_ts") + seconds()).alias("closed"))
    part = lambda name, x: F.round(F.least(x / F.lit(WEIGHTS[name][1]), F.lit(1.0)) * WEIGHTS[name][0], 2)
    base = (
        beyond.join(major, ["symbol", "tf", "market_time", "kind"], "left")
        .join(last, ["symbol", "tf"])
        .withColumn("held", F.least(F.col("hit") - F.col("i"), F.lit(HELD_BARS)))
        .withColumn("held", F.when(F.col("held").isNull() & (F.col("last_i") - F.col("i") >= HELD_BARS), HELD_BARS).otherwise(F.col("held")))
        .where("held is not null")
        .join(ratio, ["symbol", "tf", "i"])
        .withColumn("close_bar", F.col("i") + F.col("held"))
        .join(closes, ["symbol", "tf", "close_bar"])
        .withColumn("prev", F.lag("price").over(same))
    )
    took = F.when(F.col("kind") == "HIGH", F.col("price") > F.col("prev")).otherwise(F.col("price") < F.col("prev"))
    parts = {
        "p_margin": part("margin", F.round(F.coalesce("m2", "margin") * 100, 2) / 100),
        "p_reversal": part("reversal", F.coalesce(F.round(F.abs(F.col("price") - F.coalesce("o2", "next_opposite")) / F.col("atr"), 2), F.lit(0.0))),
        "p_held": part("held", F.col("held").cast("double")),
        "p_volume": F.round(F.least(F.log2(F.round(F.coalesce("vol_ratio", F.lit(1.0)), 2) + 1) / F.log2(F.lit(7.0)), F.lit(1.0)) * 12, 2),
        "p_liquidity": F.coalesce(took, F.lit(False)).cast("double") * LIQUIDITY_WEIGHT / 2,
        "p_dominance": F.coalesce("dominant", F.lit(False)).cast("double") * DOMINANCE_WEIGHT,
    }
    total = sum((F.col(c) for c in parts), F.lit(0.0))
    return (
        base.withColumns(parts)
        .withColumn("score", F.round(total, 2))
        .withColumn("tier", F.when(F.col("score") >= MAJOR_SCORE, "MAJOR").when(F.col("score") >= INTERMEDIATE_SCORE, "INTERMEDIATE"))
        .where("tier is not null")
        .withColumn("confirmed_at", F.greatest("confirmed_at", "closed"))
        .select("symbol", "tf", "market_time", "confirmed_at", "kind", "price", "tier", "score", "held", "i", "atr", *parts)
    )
