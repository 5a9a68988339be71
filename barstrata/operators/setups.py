"""Trade setups at zones: a race of events over bars for each zone.

A zone that price nears may arm an order (FORMING); the first touch opens a short window
(CONFIRMING) in which a bar must close back out of the zone before it breaks, or the setup
is CANCELLED; a confirmed one that passes its gates is VALIDATED, and EXPIRED when the zone
breaks later. Each step is bounded by the one before, found by joins on bins of bars or
as-of joins, and never by a product of zones and bars.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.trading import confirms, playbook, round_trip_cost, size_order
from ..streaming.bars import written
from .joins import asof, first_beyond, held_window, meeting_bars, nearest_active
from .swings import seconds

# Fixed values of the rules: bars to confirm in, looks back in bars, factors of ATR, R limits.
CONFIRM_BARS, SWEEP_BARS, CHOCH_BARS, VOLUME_RATIO = 3, 10, 20, 1.3
NEAR_ATR, FORMING_STOP_ATR, STOP_ATR, NARROW_ATR = 1.0, 0.25, 0.15, 0.15
MIN_RR, GOOD_RR, MAX_R, COST_MULTIPLE, HOT_VOLUME = 1.5, 2.5, 3.0, 2.0, 1.5
MAKER_OFFSET_R, START_EQUITY = 0.10, 10_000.0
# Bars and ATR of a retest, ATR through a level that end it; reach and ratio of a draft.
RETEST_BARS, RETEST_ATR, THROUGH_ATR, DRAFT_ATR, DRAFT_RR = 12, 0.35, 0.75, 3.0, 2.0
#: Timeframes that arm orders before a touch.
FORMING_TFS = ("4H", "1D", "1W")
VERSION = "v1"

_KEY = ["symbol", "tf"]
_STATE = [
    "symbol", "tf", "setup_id", "zone_id", "state", "strategy", "direction", "regime", "market_time", "confirmed_at",
    "entry", "sl", "tp", "rr", "rank", "maker_limit", "reason", "inherited", "units", "fill_i",
]
_REJECTED = ["symbol", "tf", "zone_id", "reason", "market_time", "confirmed_at"]


@dataclass(frozen=True)
class Facts:
    """What the setups read, each as a table: analysed bars, zones and their events, regimes,
    structure breaks, pools and their events, and swings of the pools' tiers."""

    bars: DataFrame
    zones: DataFrame
    zone_events: DataFrame
    regimes: DataFrame
    breaks: DataFrame
    pools: DataFrame
    pool_events: DataFrame
    swings: DataFrame


def _step() -> Column:
    return seconds()


def targets(wanted: DataFrame, facts: Facts, name: str = "target") -> DataFrame:
    """The nearest pool level beyond the price that is known and unbroken then, or without
    one the nearest swing of the pools' tiers that is known."""
    broken = facts.pool_events.where("event = 'BROKEN'").select("symbol", "tf", "pool_id", (F.col("market_time") + _step()).alias("gone"))
    pools = facts.pools.join(broken, [*_KEY, "pool_id"], "left").select(*_KEY, "kind", "level", F.col("confirmed_at").alias("known"), "gone")
    swings = facts.swings.select(*_KEY, "kind", F.col("price").alias("level"), F.col("confirmed_at").alias("known"), F.lit(None).cast("long").alias("gone"))
    near = nearest_active(wanted, pools, _step(), "__pool")
    near = nearest_active(near, swings, _step(), "__swing")
    return near.withColumn(name, F.coalesce("__pool", "__swing")).drop("__pool", "__swing")


def _sweeps(facts: Facts) -> DataFrame:
    events = facts.pool_events.where("event = 'SWEEP'")
    side = facts.pools.select(*_KEY, "pool_id", F.col("kind").alias("swept_side"))
    return events.join(side, [*_KEY, "pool_id"]).select(*_KEY, "swept_side", F.col("market_time").alias("swept_at"))


def _recent(rows: DataFrame, events: DataFrame, key: list[str], time: str, event_time: str, bars: int, name: str) -> DataFrame:
    """Whether an event lies in the ``bars`` bars up to the row's own, by one as-of join."""
    last = asof(rows, events, key, time, event_time, [event_time])
    return last.withColumn(name, F.coalesce(F.col(time) - F.col(event_time) <= bars * _step(), F.lit(False))).drop(event_time)


def _with_regime(rows: DataFrame, facts: Facts, time: str) -> DataFrame:
    return asof(rows, facts.regimes.select(*_KEY, "confirmed_at", "regime").withColumnRenamed("confirmed_at", "regime_at"), _KEY, time, "regime_at", ["regime"])


def _volume_ratio(bars: DataFrame) -> DataFrame:
    before = Window.partitionBy(*_KEY).orderBy("open_ts").rowsBetween(-20, -1)
    mean = F.avg("volume").over(before)
    return bars.withColumn("volume_ratio", F.when((F.col("i") >= 20) & (mean > 0), F.bround(F.col("volume") / mean, 2)))


def _r(entry: Column, sl: Column, tp: Column, long: Column) -> tuple[Column, Column, Column]:
    """Risk, reward and their ratio to two places."""
    risk = F.when(long, entry - sl).otherwise(sl - entry)
    reward = F.when(long, tp - entry).otherwise(entry - tp)
    return risk, reward, F.bround(reward / risk, 2)


def _cost(entry: Column, atr: Column) -> Column:
    return round_trip_cost(F.col("symbol"), entry, atr, _step())


def _setup_id() -> Column:
    return F.concat_ws("|", "symbol", "tf", "strategy", "zone_id", F.lit(VERSION))


def gated(rows: DataFrame, swings: DataFrame) -> DataFrame:
    """Proven trades (open_ts, high, low, atr and tick of the proving bar; long, entry, sl) with
    target, ratio, passive limit and the gate that refuses each as ``reason``, null if none.

    The target is the nearest swing known at the proving bar's close, at most ``MAX_R`` away.
    """
    long = F.col("long")
    levels = swings.select(*_KEY, "kind", F.col("price").alias("level"), F.col("confirmed_at").alias("known"), F.lit(None).cast("long").alias("gone"))
    asked = rows.withColumns({"price": F.col("entry"), "as_of": F.col("open_ts") + _step()})
    aimed = nearest_active(asked, levels, _step(), "far")
    risk = F.when(long, F.col("entry") - F.col("sl")).otherwise(F.col("sl") - F.col("entry"))
    aimed = aimed.withColumn("risk", risk)
    capped = F.when(long, F.least("far", F.col("entry") + MAX_R * F.col("risk"))).otherwise(F.greatest("far", F.col("entry") - MAX_R * F.col("risk")))
    aimed = aimed.withColumn("tp", F.when(F.col("far").isNotNull(), capped))
    aimed = aimed.withColumn("rr", _r(F.col("entry"), F.col("sl"), F.col("tp"), long)[2])
    refusal = (
        F.when(F.col("risk") <= 0, "INVALID_BRACKET")
        .when((F.col("high") - F.col("low") < NARROW_ATR * F.col("atr")) | (F.col("risk") < 2 * F.col("tick")), "VETOED")
        .when(F.col("far").isNull(), "NO_CAUSAL_TARGET")
        .when(F.col("rr") < MIN_RR, "RR_BELOW_MINIMUM")
        .when(F.col("risk") < COST_MULTIPLE * _cost(F.col("entry"), F.col("atr")), "UNECONOMIC_AFTER_COSTS")
    )
    limit = F.when(long, F.col("entry") - MAKER_OFFSET_R * F.col("risk")).otherwise(F.col("entry") + MAKER_OFFSET_R * F.col("risk"))
    return aimed.withColumns({"reason": refusal, "maker_limit": limit})


def breakout_retests(facts: Facts) -> DataFrame:
    """Breaks of structure whose level price comes back to within twelve bars and holds.

    A race in the bars after the break: one that trades far through the level ends it, the
    first one that reaches the level and closes back out of it proves it.
    """
    at = facts.bars.select(*_KEY, F.col("open_ts").alias("market_time"), F.col("i").alias("break_i"), F.col("atr").alias("break_atr"))
    breaks = facts.breaks.where("event = 'BOS'").join(at, [*_KEY, "market_time"]).where("break_atr is not null")
    breaks = breaks.select(*_KEY, F.col("market_time").alias("break_ts"), "break_i", (F.col("direction") == "BULL").alias("long"), "level", (F.col("break_i") + 1).alias("from_i"))
    bars = facts.bars.withColumn("next_open", F.lead("open").over(Window.partitionBy(*_KEY).orderBy("open_ts")))
    held = held_window(breaks, bars, "from_i", RETEST_BARS, ["open_ts", "high", "low", "open", "close", "atr", "tick", "next_open"]).where("atr is not null")
    long, level, atr = F.col("long"), F.col("level"), F.col("atr")
    reached = F.when(long, F.col("low") <= level + RETEST_ATR * atr).otherwise(F.col("high") >= level - RETEST_ATR * atr)
    failed = F.when(long, F.col("low") < level - THROUGH_ATR * atr).otherwise(F.col("high") > level + THROUGH_ATR * atr)
    held = held.withColumns({"upper": level + F.col("tick"), "lower": level - F.col("tick")})
    proves = reached & ~failed & confirms(long, F.col("upper"), F.col("lower"))
    bar = F.struct("i", "open_ts", "high", "low", "atr", "tick", "next_open")
    raced = held.groupBy(*_KEY, "break_ts", "break_i", "long", "level").agg(F.min(F.when(proves, bar)).alias("bar"), F.min(F.when(failed, F.col("i"))).alias("failed_i"))
    shown = raced.where("bar is not null and (failed_i is null or bar.i < failed_i) and bar.next_open is not null").select(
        *_KEY, "break_ts", "break_i", "long", "level", "bar.*"
    )
    sl = F.when(long, F.least("low", "level") - STOP_ATR * atr).otherwise(F.greatest("high", "level") + STOP_ATR * atr)
    told = gated(shown.withColumns({"entry": F.col("next_open"), "sl": sl}), facts.swings)
    return told.select(
        *_KEY, F.when(long, "LONG").otherwise("SHORT").alias("direction"), "break_ts", "level", F.col("open_ts").alias("market_time"), F.col("as_of").alias("confirmed_at"),
        "entry", "sl", "tp", "rr", "maker_limit", (F.col("i") - F.col("break_i")).alias("retest_bars"), "reason", (F.col("i") + 1).alias("fill_i"),
    )


def draft_brackets(facts: Facts, shorts: Column) -> DataFrame:
    """A bracket at the nearest live zone within three ATR of each series' last close, if any.

    The target is the nearest unbroken pool beyond the entry, else two risks away. ``shorts``
    says by symbol whether supply zones count. Of zones equally far the earlier known counts.
    """
    closing = facts.bars.groupBy(*_KEY).agg(F.max_by("close", "i").alias("price"), F.max_by("atr", F.when(F.col("atr").isNotNull(), F.col("i"))).alias("atr"))
    broken = facts.zone_events.where("event = 'BROKEN'").select(*_KEY, "zone_id")
    live = facts.zones.join(broken, [*_KEY, "zone_id"], "left_anti").join(closing.where("atr > 0 and price > 0"), _KEY)
    demand = (F.col("zone_type") == "DEMAND") & (F.col("price") >= F.col("bottom"))
    supply = (F.col("zone_type") == "SUPPLY") & (F.col("price") <= F.col("top")) & shorts
    away = F.greatest(F.lit(0.0), F.when(demand, F.col("price") - F.col("top")).when(supply, F.col("bottom") - F.col("price")))
    near = live.where(demand | supply).withColumn("distance", away).where(F.col("distance") <= DRAFT_ATR * F.col("atr"))
    rest = [c for c in near.columns if c not in _KEY]
    best = near.groupBy(*_KEY).agg(F.min_by(F.struct(*rest), F.struct("distance", "confirmed_at", "zone_id")).alias("x")).select(*_KEY, "x.*")
    long = F.col("zone_type") == "DEMAND"
    sl = F.when(long, F.col("bottom") - FORMING_STOP_ATR * F.col("atr")).otherwise(F.col("top") + FORMING_STOP_ATR * F.col("atr"))
    best = best.withColumns({"long": long, "entry": F.when(long, F.col("top")).otherwise(F.col("bottom")), "sl": sl})
    gone = facts.pool_events.where("event = 'BROKEN'").select(*_KEY, "pool_id")
    pools = facts.pools.join(gone, [*_KEY, "pool_id"], "left_anti").select(*_KEY, "pool_id", F.col("kind").alias("side"), "level")
    fits = F.when(long, (F.col("side") == "HIGH") & (F.col("level") > F.col("entry"))).otherwise((F.col("side") == "LOW") & (F.col("level") < F.col("entry")))
    # One bracket a series meets its own pools: as many rows as there are pools.
    aims = best.select(*_KEY, "zone_type", "entry").join(pools, _KEY).where(fits).groupBy(*_KEY).agg(
        F.min_by(F.struct("level", "pool_id"), F.struct(F.abs(F.col("level") - F.col("entry")), "pool_id")).alias("aim")
    )
    risk = F.abs(F.col("entry") - F.col("sl"))
    other = F.when(long, F.col("entry") + DRAFT_RR * risk).otherwise(F.col("entry") - DRAFT_RR * risk)
    return best.join(aims, _KEY, "left").select(
        *_KEY, F.when(long, "LONG").otherwise("SHORT").alias("direction"), "zone_id", "entry", "sl", F.coalesce("aim.level", other).alias("tp"), "aim.pool_id",
        F.bround(F.col("distance") / F.col("atr"), 2).alias("distance_atr"),
    )


def _events(facts: Facts) -> DataFrame:
    """Each zone with its first touch and its break: bar numbers and open times."""
    at = facts.bars.select(*_KEY, F.col("open_ts").alias("market_time"), F.col("i").alias("event_i"))
    happened = facts.zone_events.where("event = 'BROKEN' or episode = 1").join(at, [*_KEY, "market_time"])
    item = F.struct(F.col("event_i").alias("i"), F.col("market_time").alias("ts"))
    both = happened.groupBy(*_KEY, "zone_id").agg(
        F.max(F.when(F.col("event") == "TOUCH", item)).alias("touch"), F.max(F.when(F.col("event") == "BROKEN", item)).alias("broken")
    )
    out = facts.zones.join(both, [*_KEY, "zone_id"], "left")
    return out.select(
        *_KEY, "zone_id", "zone_type", (F.col("zone_type") == "DEMAND").alias("long"), "bottom", "top", "i", "confirmed_at",
        F.col("touch.i").alias("touch_i"), F.col("touch.ts").alias("touch_ts"), F.col("broken.i").alias("broken_i"), F.col("broken.ts").alias("broken_ts"),
    )


def forming(facts: Facts, tfs: tuple[str, ...] = FORMING_TFS) -> DataFrame:
    """The first bar that comes within an ATR of an untouched zone and would pass every gate.

    A zone's bars end where price reaches its near edge, touches or breaks it. Bars close
    to it are found by bins of bars, so that a zone meets only those.
    """
    zones = _events(facts).where(F.col("tf").isin(*tfs))
    bars = facts.bars.where(F.col("tf").isin(*tfs))
    closes = bars.select(*_KEY, F.col("i").alias("bar_i"), (F.col("open_ts") + _step()).alias("closed"))
    known = asof(zones, closes, _KEY, "confirmed_at", "closed", ["bar_i"]).withColumn("after", F.greatest("bar_i", "i")).drop("bar_i")
    # The near edge is reached by a low at or below a demand zone's top, a high at a supply zone's bottom.
    reached = first_beyond(known, bars, ~F.col("long"), F.col("high"), "bottom", F.col("low"), "top", name="reach_i", reach=True)
    ends = reached.withColumn("until", F.least("reach_i", "touch_i", "broken_i")).withColumn("edge", F.when(F.col("long"), F.col("top")).otherwise(F.col("bottom")))
    # A bar is near if the edge lies between its own extreme and that an ATR nearer.
    sides = F.array(
        F.struct(F.lit(True).alias("long"), (F.col("low") - NEAR_ATR * F.col("atr")).alias("low"), F.col("low").alias("high")),
        F.struct(F.lit(False).alias("long"), F.col("high").alias("low"), (F.col("high") + NEAR_ATR * F.col("atr")).alias("high")),
    )
    name = lambda c: F.concat_ws("|", c, F.col("long").cast("string"))
    reach = bars.where("atr is not null").select("symbol", "tf", "i", "open_ts", "atr", F.explode(sides).alias("s")).select(
        "symbol", "tf", F.col("i").alias("j"), "open_ts", F.col("atr").alias("bar_atr"), F.col("s.long").alias("long"), "s.low", "s.high"
    ).withColumn("symbol", name("symbol")).drop("long")
    asked = ends.withColumn("plain", F.col("symbol")).withColumn("symbol", name("symbol")).withColumn("low_edge", F.col("edge"))
    near = meeting_bars(asked, reach, "low_edge", "edge", "after", "until").drop("low", "high", "low_edge")
    near = near.withColumn("symbol", F.col("plain")).drop("plain").withColumn("seen_at", F.col("open_ts") + _step())
    told = _with_regime(near, facts, "seen_at")
    told = told.withColumn("swept_side", F.when(F.col("long"), "LOW").otherwise("HIGH"))
    told = _recent(told, _sweeps(facts), [*_KEY, "swept_side"], "open_ts", "swept_at", SWEEP_BARS, "swept")
    told = told.withColumn("play", playbook(F.col("zone_type"), F.col("regime"), F.col("swept"))).where("play is not null")
    stop = F.when(F.col("long"), F.col("bottom") - FORMING_STOP_ATR * F.col("bar_atr")).otherwise(F.col("top") + FORMING_STOP_ATR * F.col("bar_atr"))
    told = told.withColumns({"price": F.col("edge"), "as_of": F.col("seen_at"), "entry": F.col("edge"), "sl": stop})
    aimed = targets(told, facts, "tp")
    risk, reward, rr = _r(F.col("entry"), F.col("sl"), F.col("tp"), F.col("long"))
    fine = (risk > 0) & (reward > 0) & (rr >= MIN_RR) & (risk >= COST_MULTIPLE * _cost(F.col("entry"), F.col("bar_atr")))
    passed = aimed.withColumn("rr", rr).where(fine)
    rest = [c for c in passed.columns if c not in (*_KEY, "zone_id")]
    first = passed.groupBy(*_KEY, "zone_id").agg(F.min_by(F.struct(*rest), "j").alias("x")).select(*_KEY, "zone_id", "x.*")
    sized = first.withColumns({"strategy": F.col("play.strategy"), "direction": F.col("play.direction")}).withColumn(
        "order", size_order(F.lit(START_EQUITY), F.col("entry"), F.col("sl"), F.col("symbol"), F.col("long"), F.lit(0.0))
    )
    return sized.withColumns(
        {
            "setup_id": _setup_id(), "units": F.col("order.units"), "armed": F.col("order.decision") != "REJECTED",
            "market_time": F.col("open_ts"), "armed_at": F.col("seen_at"),
        }
    )


def touched(facts: Facts) -> DataFrame:
    """Zones at their first touch with regime, evidence and play; ``play`` is null without one."""
    zones = _events(facts).where("touch_i is not null").withColumn("touch_known", F.col("touch_ts") + _step())
    zones = _with_regime(zones, facts, "touch_known")
    zones = zones.withColumn("swept_side", F.when(F.col("long"), "LOW").otherwise("HIGH"))
    zones = _recent(zones, _sweeps(facts), [*_KEY, "swept_side"], "touch_ts", "swept_at", SWEEP_BARS, "swept")
    choch = facts.breaks.where("event = 'CHOCH'").select(*_KEY, F.col("market_time").alias("choch_at"))
    zones = _recent(zones, choch, _KEY, "touch_ts", "choch_at", CHOCH_BARS, "choch")
    volume = _volume_ratio(facts.bars).select(*_KEY, F.col("i").alias("touch_i"), F.col("volume_ratio").alias("touch_volume"))
    zones = zones.join(volume, [*_KEY, "touch_i"])
    evidence = F.col("swept") | F.col("choch") | F.coalesce(F.col("touch_volume") >= VOLUME_RATIO, F.lit(False))
    return zones.withColumn("play", playbook(F.col("zone_type"), F.col("regime"), evidence))


def setups(facts: Facts, tfs: tuple[str, ...] = FORMING_TFS) -> tuple[DataFrame, DataFrame]:
    """All states of the setups, and the rejections of touched zones. The steps of the race
    are written to the shared folder, as several states come from each.

    A VALIDATED setup whose zone armed an order takes over its entry, stop and target.
    ``fill_i`` is the bar after the confirmation. Rank is recorded and decides nothing.
    """
    long = F.col("long")
    told = written(touched(facts), "touched").withColumns({"strategy": F.col("play.strategy"), "direction": F.col("play.direction")}).withColumn("setup_id", _setup_id())
    eligible = told.where("play is not null")
    bars = _volume_ratio(facts.bars).withColumn("next_open", F.lead("open").over(Window.partitionBy(*_KEY).orderBy("open_ts")))
    last = bars.groupBy(*_KEY).agg(F.max("i").alias("last_i"))
    held = held_window(
        eligible.select(*_KEY, "zone_id", "long", "bottom", "top", "touch_i", "broken_i"), bars, "touch_i", CONFIRM_BARS + 1,
        ["open_ts", "high", "low", "open", "close", "atr", "tick", "volume_ratio", "next_open"],
    )
    shown = confirms(long, F.col("top"), F.col("bottom")) & (F.col("broken_i").isNull() | (F.col("i") < F.col("broken_i")))
    bar = F.struct("i", "open_ts", "high", "low", "atr", "tick", "volume_ratio", "next_open")
    proof = held.where(shown).groupBy(*_KEY, "zone_id").agg(F.min(bar).alias("bar"))
    raced = written(eligible.join(proof, [*_KEY, "zone_id"], "left").join(last, _KEY), "raced")
    blank = {"rr": "double", "rank": "int", "maker_limit": "double", "reason": "string", "inherited": "boolean", "units": "double", "fill_i": "long", "entry": "double", "sl": "double", "tp": "double"}

    def state(rows: DataFrame, name: str, at: Column, known: Column) -> DataFrame:
        missing = {c: F.lit(0 if c == "rank" else None).cast(t) for c, t in blank.items() if c not in rows.columns}
        return rows.withColumns({**missing, "state": F.lit(name), "market_time": at, "confirmed_at": known}).select(*_STATE)

    confirming = state(raced, "CONFIRMING", F.col("touch_ts"), F.col("touch_known"))
    # Without a proof the window's last bar, or the data's, ends the setup.
    end_i = F.least(F.col("touch_i") + CONFIRM_BARS, "last_i")
    ends = raced.where("bar is null").withColumn("end_i", end_i).join(bars.select(*_KEY, F.col("i").alias("end_i"), F.col("open_ts").alias("end_ts")), [*_KEY, "end_i"])
    broke = F.coalesce(F.col("broken_i") <= F.col("end_i"), F.lit(False))
    ends = ends.withColumn("reason", F.when(broke, "ZONE_BROKE_UNCONFIRMED").otherwise("CONFIRMATION_TIMEOUT"))
    cancelled = state(ends, "CANCELLED", F.col("end_ts"), F.col("end_ts") + _step())

    shown = raced.where("bar.next_open is not null").withColumns({"known": F.col("bar.open_ts") + _step(), "entry": F.col("bar.next_open")})
    sl = F.when(long, F.least("bar.low", "bottom") - STOP_ATR * F.col("bar.atr")).otherwise(F.greatest("bar.high", "top") + STOP_ATR * F.col("bar.atr"))
    shown = shown.withColumn("sl", sl).withColumns({"price": F.col("entry"), "as_of": F.col("known")})
    aimed = targets(shown, facts, "far")
    risk = F.when(long, F.col("entry") - F.col("sl")).otherwise(F.col("sl") - F.col("entry"))
    aimed = aimed.withColumn("risk", risk)
    capped = F.when(long, F.least("far", F.col("entry") + MAX_R * F.col("risk"))).otherwise(F.greatest("far", F.col("entry") - MAX_R * F.col("risk")))
    aimed = aimed.withColumn("tp", F.when(F.col("far").isNotNull(), capped))
    aimed = aimed.withColumn("rr", _r(F.col("entry"), F.col("sl"), F.col("tp"), long)[2])
    narrow = F.col("bar.high") - F.col("bar.low") < NARROW_ATR * F.col("bar.atr")
    reason = (
        F.when(F.col("bar.atr").isNull(), "ATR_UNAVAILABLE")
        .when(F.col("risk") <= 0, "INVALID_BRACKET")
        .when(narrow | (F.col("risk") < 2 * F.col("bar.tick")), "VETOED")
        .when(F.col("far").isNull(), "NO_CAUSAL_TARGET")
        .when(F.col("rr") < MIN_RR, "RR_BELOW_MINIMUM")
        .when(F.col("risk") < COST_MULTIPLE * _cost(F.col("entry"), F.col("bar.atr")), "UNECONOMIC_AFTER_COSTS")
    )
    judged = written(aimed.withColumn("refusal", reason), "judged")
    out = lambda rows, why: rows.withColumns({"reason": why, "market_time": F.col("touch_ts"), "confirmed_at": F.col("touch_known")}).select(*_REJECTED)
    refused = out(told.where("play is null"), F.lit("NO_ELIGIBLE_PLAYBOOK")).unionByName(out(judged.where("refusal is not null"), F.col("refusal")))

    armed = written(forming(facts, tfs), "armed")
    bracket = armed.select(
        *_KEY, "setup_id", F.struct(F.col("entry"), F.col("sl"), F.col("tp"), "units").alias("order"),
    )
    valid = judged.where("refusal is null").join(bracket, [*_KEY, "setup_id"], "left")
    taken = lambda c: F.coalesce(F.col(f"order.{c}"), F.col(c)).alias(c)
    rank = (
        F.col("play.rank") + F.when(F.col("swept"), 20).otherwise(0) + F.when(F.col("bar.volume_ratio") > HOT_VOLUME, 15).otherwise(0)
        + F.when(F.col("rr") >= GOOD_RR, 15).otherwise(0)
    )
    keep = [c for c in valid.columns if c not in ("entry", "sl", "tp", "rr", "order")]
    valid = valid.withColumn("rank", rank.cast("int")).select(
        *keep, "rank", taken("entry"), taken("sl"), taken("tp"), F.col("order").isNotNull().alias("inherited"), F.col("order.units").alias("units"),
    )
    risk, _, rr = _r(F.col("entry"), F.col("sl"), F.col("tp"), long)
    limit = F.when(long, F.col("entry") - MAKER_OFFSET_R * risk).otherwise(F.col("entry") + MAKER_OFFSET_R * risk)
    valid = valid.withColumns({"rr": rr, "maker_limit": limit, "fill_i": F.col("bar.i") + 1})
    valid = written(valid, "validated")
    validated = state(valid, "VALIDATED", F.col("bar.open_ts"), F.col("known"))
    late = valid.where(F.col("broken_ts") + _step() > F.col("known"))
    expired = state(late, "EXPIRED", F.col("broken_ts"), F.col("broken_ts") + _step())

    waiting = state(armed, "FORMING", F.col("market_time"), F.col("armed_at"))
    missed = armed.where("broken_ts is not null and touch_i is null")
    missed = state(missed, "CANCELLED", F.col("broken_ts"), F.col("broken_ts") + _step())
    every = waiting.unionByName(missed).unionByName(confirming).unionByName(cancelled).unionByName(validated).unionByName(expired)
    return every, refused
