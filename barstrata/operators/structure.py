"""Structure labels and breaks, regimes, zones, liquidity pools, ranges and gaps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof, first_beyond, fold_series, meeting_bars
from .swings import seconds

ZONE_ATR, POOL_ATR, POOL_BARS = 0.25, 0.10, 100
MAX_TOUCHES, MAX_TESTS = 10, 10
GAP_ATR = 0.25
_UP, _DOWN = "close_up", "close_down"


def with_break_metrics(bars: DataFrame) -> DataFrame:
    """Closes less and plus the tolerance: a break of a level is a compare with one."""
    tol = F.coalesce("tol", "tick")
    return bars.withColumns({_UP: F.col("close") - tol, _DOWN: F.col("close") + tol})


def labels(pivots: DataFrame) -> DataFrame:
    """HH, LH, HL or LL of each pivot against the last of its kind."""
    same = Window.partitionBy("symbol", "tf", "kind").orderBy("market_time")
    prev = F.lag("price").over(same)
    high = F.when(F.col("price") > prev, "HH").otherwise("LH")
    low = F.when(F.col("price") > prev, "HL").otherwise("LL")
    return pivots.withColumn("label", F.when(prev.isNotNull(), F.when(F.col("kind") == "HIGH", high).otherwise(low))).where("label is not null")


def _unspent(frame: pd.DataFrame) -> pd.DataFrame:
    """The crossings of swings that formed after the break before them."""
    frame = frame.sort_values("market_time")
    last, kept = -1, []
    for swing, at in zip(frame["level_swing_ts"], frame["market_time"], strict=True):
        kept.append(swing > last)
        last = at if kept[-1] else last
    return frame[kept]


def breaks(pivots: DataFrame, bars: DataFrame) -> DataFrame:
    """BOS and CHOCH events.

    A side's level is its latest swing known at a bar's close. Only the first close
    beyond each level can break it, and does unless a break of that side is as late
    as the swing itself; only these few crossings are folded. A break against the
    direction of the one before it, of either side, is a CHOCH.
    """
    key = ["symbol", "tf"]
    known = pivots.select(*key, F.col("confirmed_at").alias("known"), F.lit(0).alias("what"), "kind", F.struct("market_time", "price").alias("level"))
    closes = bars.select(*key, (F.col("open_ts") + seconds()).alias("known"), F.lit(1).alias("what"), "open_ts", "close", "tol")
    run = Window.partitionBy(*key).orderBy("known", "what").rowsBetween(Window.unboundedPreceding, 0)
    latest = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("level"))).over(run)
    told = known.unionByName(closes, allowMissingColumns=True).repartition(*key)
    told = told.withColumns({"HIGH": latest("HIGH"), "LOW": latest("LOW")}).where("what = 1")
    side = lambda kind, name, beyond: F.when(
        beyond, F.struct(F.lit(name).alias("direction"), F.col(f"{kind}.market_time").alias("level_swing_ts"), F.col(f"{kind}.price").alias("level"))
    )
    sides = F.array_compact(F.array(
        side("HIGH", "BULL", F.col("close") > F.col("HIGH.price") + F.col("tol")),
        side("LOW", "BEAR", F.col("close") < F.col("LOW.price") - F.col("tol")),
    ))
    crossings = (
        told.select(*key, "open_ts", F.explode(sides).alias("side")).groupBy(*key, "side.direction", "side.level_swing_ts")
        .agg(F.min("open_ts").alias("market_time"), F.max("side.level").alias("level"))
    )
    schema = "symbol string, tf string, direction string, level_swing_ts long, market_time long, level double"
    broken = fold_series(crossings.select("symbol", "tf", "direction", "level_swing_ts", "market_time", "level"), _unspent, schema, [*key, "direction"])
    before = F.lag("direction").over(Window.partitionBy(*key).orderBy("market_time", F.desc("direction")))
    event = F.when(before.isNull() | (before == F.col("direction")), "BOS").otherwise("CHOCH")
    return broken.withColumn("event", event).select(
        *key, "market_time", (F.col("market_time") + seconds()).alias("confirmed_at"), "event", "direction", "level", "level_swing_ts"
    )


def classify_regime(event: Column, direction: Column, high: Column, low: Column) -> Column:
    bull, bear = direction == "BULL", direction == "BEAR"
    both = lambda a, b: F.coalesce(high == a, F.lit(False)) & F.coalesce(low == b, F.lit(False))
    either = lambda a, b: F.coalesce(high == a, F.lit(False)) | F.coalesce(low == b, F.lit(False))
    return (
        F.when(event.isNull(), "RANGE")
        .when(event == "CHOCH", "TRANSITION")
        .when(bull & both("HH", "HL"), "BULL_TREND")
        .when(bull & either("HH", "HL"), "WEAKENING_BULL")
        .when(bear & both("LH", "LL"), "BEAR_TREND")
        .when(bear & either("LH", "LL"), "WEAKENING_BEAR")
        .otherwise("RANGE")
    )


def regimes(label_facts: DataFrame, break_facts: DataFrame) -> DataFrame:
    """Regime changes from the last break and the last labels, in order of knowledge."""
    facts = label_facts.select("symbol", "tf", "market_time", "confirmed_at", "kind", "label", F.lit(0).alias("what")).unionByName(
        break_facts.select("symbol", "tf", "market_time", "confirmed_at", "event", "direction", F.lit(1).alias("what")), allowMissingColumns=True
    ).repartition("symbol", "tf")
    order = Window.partitionBy("symbol", "tf").orderBy("confirmed_at", "market_time", "what", "kind", "direction")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(run)
    told = facts.withColumns(
        {
            "e": last(F.col("event")),
            "d": last(F.col("direction")),
            "h": last(F.when(F.col("kind") == "HIGH", F.col("label"))),
            "l": last(F.when(F.col("kind") == "LOW", F.col("label"))),
        }
    ).withColumn("regime", classify_regime(F.col("e"), F.col("d"), F.col("h"), F.col("l")))
    return (
        told.withColumn("prev", F.lag("regime").over(order))
        .where(F.col("prev").isNull() | (F.col("prev") != F.col("regime")))
        .select("symbol", "tf", "market_time", "confirmed_at", "regime", F.col("h").alias("high_label"), F.col("l").alias("low_label"))
    )


def zones(pivots: DataFrame, tf_weight: int = 0) -> DataFrame:
    """Demand and supply zones at pivots, with the anchors of their kind known by then
    inside the band and the qualities that follow."""
    high = F.col("kind") == "HIGH"
    base = pivots.where("atr is not null").withColumns(
        {
            "zone_type": F.when(high, "SUPPLY").otherwise("DEMAND"),
            "bottom": F.when(high, F.col("price") - ZONE_ATR * F.col("atr")).otherwise(F.col("price")),
            "top": F.when(high, F.col("price")).otherwise(F.col("price") + ZONE_ATR * F.col("atr")),
        }
    )
    base = base.withColumn("zone_id", F.concat_ws("|", "symbol", "tf", "zone_type", F.col("market_time").cast("string")))
    # Prices are binned by the series' largest zone, so that a zone reaches two bins at most.
    width = base.groupBy("symbol", "tf", "kind").agg(F.max(F.col("top") - F.col("bottom")).alias("width")).where("width > 0")
    wide = base.join(width, ["symbol", "tf", "kind"])
    at = lambda c: F.floor(F.col(c) / F.col("width"))
    z = wide.withColumn("bin", F.explode(F.sequence(at("bottom"), at("top")))).alias("z")
    o = wide.select("symbol", "tf", "kind", at("price").alias("bin"), "market_time", "price", "confirmed_at").alias("o")
    members = (
        z.join(o, ["symbol", "tf", "kind", "bin"])
        .where(
            (F.col("o.market_time") != F.col("z.market_time"))
            & F.col("o.price").between(F.col("z.bottom"), F.col("z.top"))
            & (F.col("o.confirmed_at") <= F.col("z.confirmed_at"))
        )
        .groupBy("zone_id")
        .agg(F.count("*").alias("cluster"))
    )
    quality = F.least(F.lit(100), 50 + F.least(F.lit(30), 10 * F.col("cluster")) + tf_weight)
    return (
        base.join(members, "zone_id", "left")
        .withColumn("cluster", F.coalesce("cluster", F.lit(0)))
        .withColumn("quality", quality.cast("long"))
        .withColumn("strength", F.floor((F.col("quality") + 100) / 2).cast("long"))
        .select("symbol", "tf", "zone_id", "zone_type", "market_time", "confirmed_at", "bottom", "top", "cluster", "quality", "strength", "i")
    )


def _from_known(facts: DataFrame, bars: DataFrame) -> DataFrame:
    """Adds ``after``: the last bar that closed when the fact became known."""
    closes = bars.select("symbol", "tf", F.col("i").alias("bar_i"), (F.col("open_ts") + seconds()).alias("closed"))
    return asof(facts, closes, ["symbol", "tf"], "confirmed_at", "closed", ["bar_i"]).withColumn("after", F.greatest("bar_i", "i")).drop("bar_i")


def _two_sided(facts: DataFrame, bars: DataFrame, up: Column, up_level: str, down_level: str, name: str) -> DataFrame:
    """First close beyond the level: up-side facts above it, others below."""
    return first_beyond(facts, bars, up, F.col(_UP), up_level, F.col(_DOWN), down_level, name=name)


def zone_events(zone_facts: DataFrame, bars: DataFrame) -> DataFrame:
    """TOUCH episodes and the BROKEN event of each zone: zone_id, i, event, state, episode."""
    bars = with_break_metrics(bars)
    known = _from_known(zone_facts, bars)
    done = _two_sided(known, bars, F.col("zone_type") == "SUPPLY", "top", "bottom", "broken_i")
    span = bars.select("symbol", "tf", F.col("i").alias("j"), F.col("open_ts").alias("at"), "high", "low")
    inside = meeting_bars(done, span, "bottom", "top", "after", "broken_i")
    order = Window.partitionBy("zone_id").orderBy("j")
    begun = inside.withColumn("prev", F.lag("j").over(order)).where(F.col("prev").isNull() | (F.col("prev") < F.col("j") - 1))
    touches = begun.withColumn("episode", F.row_number().over(order)).where(F.col("episode") <= MAX_TOUCHES)
    state = F.when(F.col("episode") == 1, "TOUCHED").when(F.col("episode") == 2, "TESTED").otherwise("WEAKENED")
    broken = done.where("broken_i is not null").select("symbol", "tf", "zone_id", F.col("broken_i").alias("j"))
    broken = broken.join(span.select("symbol", "tf", "j", "at"), ["symbol", "tf", "j"])
    return touches.select("symbol", "tf", "zone_id", F.col("at").alias("market_time"), F.lit("TOUCH").alias("event"), state.alias("state"), F.col("episode").cast("long").alias("episode")).unionByName(
        broken.select("symbol", "tf", "zone_id", F.col("at").alias("market_time"), F.lit("BROKEN").alias("event"), F.lit("BROKEN").alias("state"), F.lit(None).cast("long").alias("episode"))
    )


def _without_rivals(frame: pd.DataFrame) -> pd.DataFrame:
    """The clusters none of whose rivals has become a pool, in order of time."""
    frame = frame.sort_values("market_time")
    pools: set[int] = set()
    for at, rivals in zip(frame["market_time"], frame["rivals"], strict=True):
        if pools.isdisjoint(rivals):
            pools.add(at)
    return frame[frame["market_time"].isin(pools)].drop(columns="rivals")


def pools(pivots: DataFrame) -> DataFrame:
    """Liquidity pools of equal highs or lows.

    A swing and the earlier ones of its kind within ``POOL_BARS`` bars and
    ``POOL_ATR`` ATR are a cluster; an earlier cluster that has one of its swings is
    its rival. A cluster is a pool unless a rival is one. Clusters and rivals come
    from joins on bins of time and on swings, only the choice is folded.
    """
    key = ["symbol", "tf", "kind"]
    base = pivots.withColumn("span", POOL_BARS * seconds()).withColumn("bin", F.floor(F.col("market_time") / F.col("span")))
    other = base.select(*key, "bin", F.col("market_time").alias("member"), F.col("price").alias("member_price"))
    near = (
        base.where("atr is not null").withColumn("bin", F.explode(F.array(F.col("bin") - 1, "bin"))).join(other, [*key, "bin"])
        .where(
            (F.col("member") < F.col("market_time"))
            & (F.col("market_time") - F.col("member") <= F.col("span"))
            & (F.abs(F.col("member_price") - F.col("price")) <= POOL_ATR * F.col("atr"))
        )
    )
    extreme = F.when(F.col("kind") == "HIGH", F.greatest(F.max("member_price"), "price")).otherwise(F.least(F.min("member_price"), "price"))
    clusters = near.groupBy(*key, "market_time", "confirmed_at", "price", "i").agg(
        F.collect_set("member").alias("others"), extreme.alias("level")
    ).withColumn("members", F.array_append("others", F.col("market_time")))
    swings = clusters.select(*key, "market_time", F.explode("members").alias("member"))
    rivals = (
        swings.join(swings.withColumnRenamed("market_time", "rival"), [*key, "member"])
        .where("rival < market_time").groupBy(*key, "market_time").agg(F.collect_set("rival").alias("rivals"))
    )
    none = F.array().cast("array<bigint>")
    told = clusters.join(rivals, [*key, "market_time"], "left").select(
        "symbol", "tf", F.concat_ws("|", "symbol", "tf", F.concat(F.lit("EQ"), F.substring("kind", 1, 1)), F.col("market_time").cast("string")).alias("pool_id"),
        "kind", "market_time", "confirmed_at", "level", F.size("members").cast("long").alias("n_members"), "i", F.coalesce("rivals", none).alias("rivals"),
    )
    schema = "symbol string, tf string, pool_id string, kind string, market_time long, confirmed_at long, level double, n_members long, i long"
    return fold_series(told, _without_rivals, schema, key)


def pool_events(pool_facts: DataFrame, bars: DataFrame) -> DataFrame:
    """The first sweep before the break, and the break, of each pool."""
    bars = with_break_metrics(bars)
    known = _from_known(pool_facts, bars)
    done = _two_sided(known, bars, F.col("kind") == "HIGH", "level", "level", "broken_i")
    span = bars.select("symbol", "tf", F.col("i").alias("j"), F.col("open_ts").alias("at"), "high", "low", "close")
    wick = F.when(F.col("kind") == "HIGH", (F.col("high") > F.col("level")) & (F.col("close") <= F.col("level"))).otherwise(
        (F.col("low") < F.col("level")) & (F.col("close") >= F.col("level"))
    )
    swept = (
        meeting_bars(done, span, "level", "level", "after", "broken_i")
        .where(wick)
        .groupBy("symbol", "tf", "pool_id")
        .agg(F.min("at").alias("market_time"))
        .withColumn("event", F.lit("SWEEP"))
    )
    broken = (
        done.where("broken_i is not null")
        .select("symbol", "tf", "pool_id", F.col("broken_i").alias("j"))
        .join(span, ["symbol", "tf", "j"])
        .select("symbol", "tf", "pool_id", F.col("at").alias("market_time"), F.lit("BROKEN").alias("event"))
    )
    return swept.unionByName(broken)


def gap_bands(bars: DataFrame) -> DataFrame:
    """Three-bar value gaps of at least a quarter ATR."""
    order = Window.partitionBy("symbol", "tf").orderBy("open_ts")
    bull, bear = F.col("low") - F.lag("high", 2).over(order), F.lag("low", 2).over(order) - F.col("high")
    found = bars.withColumns({"bull": bull, "bear": bear, "h2": F.lag("high", 2).over(order), "l2": F.lag("low", 2).over(order)}).withColumn(
        "direction", F.when(F.col("bull") > 0, "BULL").when(F.col("bear") > 0, "BEAR")
    )
    sized = found.where("direction is not null and atr is not null").withColumns(
        {
            "bottom": F.when(F.col("direction") == "BULL", F.col("h2")).otherwise(F.col("high")),
            "top": F.when(F.col("direction") == "BULL", F.col("low")).otherwise(F.col("l2")),
        }
    ).where(F.col("top") - F.col("bottom") >= GAP_ATR * F.col("atr"))
    return sized.select("symbol", "tf", F.col("open_ts").alias("market_time"), "direction", "bottom", "top", "i")


def gaps(bars: DataFrame) -> DataFrame:
    """The value gaps with the bar that fills each."""
    gap = gap_bands(bars).withColumn("after", F.col("i"))
    bull = F.col("direction") == "BULL"
    filled = first_beyond(gap, bars, ~bull, F.col("high"), "top", F.col("low"), "bottom", name="filled_i", reach=True)
    return filled.withColumn("fill_lag", F.col("filled_i") - F.col("i")).drop("after")
