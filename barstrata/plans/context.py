"""What was known at a time: rungs of timeframes, the market's state, and the life of setups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import trading as T
from ..operators import execution as E
from ..operators import lifecycle as L
from ..operators import series as S
from ..operators import setups as U
from ..operators.joins import asof, asof_many
from ..sources import candles as C
from ..streaming.bars import written
from .catalog import query
from .market import _BB, _PCT, ATR_BANDS, TF, _arms, _schmitt_sql, _sql_arms
from .evidence import _NAMES
from .setups import _SETUPS, named_facts, setup_facts, structure_facts
from .sql import with_tables

#: The rungs that one reading folds, and the bars in which a break counts as evidence.
RUNGS, EVIDENCE_BARS = ("15m", "1H", "4H", "1D", "1W"), 5

_RUNG_SQL = ", ".join(f"('{tf}', {C.TF_SECONDS[tf]}, {C.MONDAY if tf == '1W' else 0})" for tf in RUNGS)
_LADDER = f"""
, rg(tf, size, shift) AS (VALUES {_RUNG_SQL}),
tk AS (SELECT symbol, epoch_us(ts) AS us, price, open_ts FROM t),
rr AS (
  SELECT tk.symbol, rg.tf, rg.size, (us // 1000000 - rg.shift) // rg.size * rg.size + rg.shift AS ts, arg_min(price, us) AS o, arg_max(price, us) AS c, min(price) AS lo
  FROM tk, rg GROUP BY ALL),
rs AS (SELECT symbol, tf, ts + size AS known, CASE WHEN c > o THEN 'UP' WHEN c < o THEN 'DOWN' ELSE 'FLAT' END AS side FROM rr WHERE lo > 0),
rl AS (
  SELECT c.symbol, c.open_ts, {', '.join(f"(SELECT max((s.known, s.side)) FROM rs s WHERE s.symbol = c.symbol AND s.tf = '{tf}' AND s.known <= c.open_ts + 3600)[2] AS r{k}" for k, tf in enumerate(RUNGS))}
  FROM c),
rv AS (SELECT *, list_filter([r0, r1, r2, r3, r4], lambda x: x IS NOT NULL) AS v FROM rl),
rf AS (
  SELECT *, CASE WHEN len(v) = 0 THEN 'UNKNOWN' WHEN list_contains(v, 'UP') AND list_contains(v, 'DOWN') THEN 'MIXED' WHEN list_contains(v, 'UP') THEN 'UP' WHEN list_contains(v, 'DOWN') THEN 'DOWN' ELSE 'FLAT' END AS side FROM rv)
"""


def rung_sides(spark: SparkSession, d: str) -> DataFrame:
    """(symbol, tf, known, side) of every closed bar of every rung."""
    ticks = C.event_ticks(spark, d)
    one = lambda tf: C.bars_from_ticks(ticks, tf).where(C.is_sound()).select(
        "symbol", "tf", (F.col("open_ts") + C.TF_SECONDS[tf]).alias("known"),
        F.when(F.col("close") > F.col("open"), "UP").when(F.col("close") < F.col("open"), "DOWN").otherwise("FLAT").alias("side"),
    )
    return reduce(DataFrame.unionByName, [one(tf) for tf in RUNGS])


@query("bias_ladder", with_tables(_LADDER + """
SELECT symbol, open_ts + 3600 AS as_of, r0 AS rung_15m, r1 AS rung_1h, r2 AS rung_4h, r3 AS rung_1d, r4 AS rung_1w, side AS composite,
  CASE side WHEN 'UP' THEN 'WITH' WHEN 'DOWN' THEN 'AGAINST' ELSE side END AS long_alignment FROM rf""", "c"))
def bias_ladder(spark, d):
    """Five rungs as of each bar's close and the one side that they make, in one shuffle of all."""
    sides = rung_sides(spark, d)
    wanted = C.candles(spark, d, TF).select("symbol", (F.col("open_ts") + C.TF_SECONDS[TF]).alias("as_of"))
    facts = {f"rung_{tf.lower()}": (sides.where(F.col("tf") == tf), "known", ["side"]) for tf in RUNGS}
    told = asof_many(wanted, facts, ["symbol"], "as_of")
    told = told.select("symbol", "as_of", *[F.col(f"{name}.side").alias(name) for name in facts])
    told = told.withColumn("composite", T.composite(F.array(*facts)))
    return told.withColumn("long_alignment", T.alignment(F.col("composite"), F.lit("LONG")))


@query("break_evidence", with_tables("""
, w AS (SELECT symbol, open_ts + 3600 AS as_of, direction FROM ba, (VALUES ('LONG'), ('SHORT')) l(direction)),
e AS (
  SELECT w.*, (SELECT max(b.confirmed_at) FROM brk b WHERE b.symbol = w.symbol AND b.direction = CASE w.direction WHEN 'LONG' THEN 'BULL' ELSE 'BEAR' END
    AND b.confirmed_at <= as_of AND as_of - b.confirmed_at <= 5 * 3600) AS at_ts FROM w)
SELECT symbol, as_of, direction, at_ts IS NOT NULL AS ok, at_ts, (as_of - at_ts) // 3600 AS bars_ago FROM e""", "brk"))
def break_evidence(spark, d):
    """Whether structure broke in a direction within five bars before each close."""
    facts = structure_facts(spark, d)
    way = F.explode(F.array(F.lit("LONG"), F.lit("SHORT")))
    wanted = facts.bars.select("symbol", "tf", (F.col("open_ts") + 3600).alias("as_of"), way.alias("direction"))
    side = F.when(F.col("direction") == "BULL", "LONG").otherwise("SHORT")
    broken = facts.breaks.select("symbol", "tf", side.alias("direction"), F.col("confirmed_at").alias("at_ts"))
    told = asof(wanted, broken, ["symbol", "tf", "direction"], "as_of", "at_ts", ["at_ts"], max_age=EVIDENCE_BARS * 3600)
    return told.select("symbol", "as_of", "direction", F.col("at_ts").isNotNull().alias("ok"), "at_ts", F.floor((F.col("as_of") - F.col("at_ts")) / 3600).alias("bars_ago"))


_SQUEEZE = _BB + """
, sq AS (SELECT symbol, open_ts, CASE WHEN bu < ku AND bl > kl THEN 'ON' ELSE 'OFF' END AS state FROM k WHERE ku IS NOT NULL)"""
_CONTEXT = _SQUEEZE + _PCT + _schmitt_sql("p", "pct", _sql_arms(ATR_BANDS), "NORMAL") + """
, ar AS (SELECT ch.symbol, ba.open_ts, ch.state FROM ch JOIN ba USING (symbol, i)),
sf AS (SELECT symbol, confirmed_at, event AS name, direction AS what FROM brk UNION ALL SELECT symbol, confirmed_at, 'LABEL', label FROM lab WHERE label IS NOT NULL),
lf AS (SELECT symbol, confirmed_at, 'POOL' AS event FROM poo UNION ALL SELECT symbol, swept_at + 3600, 'SWEEP' FROM pev WHERE swept_at IS NOT NULL
  UNION ALL SELECT symbol, broken_at + 3600, 'BROKEN' FROM pev WHERE broken_at IS NOT NULL),
hr AS (SELECT symbol, unnest(generate_series(min(open_ts) + 3600, max(open_ts) + 5 * 3600, 3600)) AS as_of FROM ba GROUP BY symbol),
sn AS (
  SELECT symbol, as_of, (SELECT max(x.open_ts + 3600) FROM ba x WHERE x.symbol = h.symbol AND x.open_ts + 3600 <= as_of) AS bar_at,
    (SELECT max((r.confirmed_at, r.regime)) FROM reg r WHERE r.symbol = h.symbol AND r.confirmed_at <= as_of)[2] AS base,
    (SELECT max((s.confirmed_at, s.name, s.what)) FROM sf s WHERE s.symbol = h.symbol AND s.confirmed_at <= as_of) AS st,
    (SELECT max((s.open_ts, s.state)) FROM sq s WHERE s.symbol = h.symbol AND s.open_ts + 3600 <= as_of)[2] AS squeeze,
    (SELECT max((a.open_ts, a.state)) FROM ar a WHERE a.symbol = h.symbol AND a.open_ts + 3600 <= as_of)[2] AS atr_state,
    (SELECT max((l.confirmed_at, l.event)) FROM lf l WHERE l.symbol = h.symbol AND l.confirmed_at <= as_of)[2] AS liquidity
  FROM hr h)
SELECT symbol, as_of, CASE WHEN as_of - bar_at > 7200 THEN 'DEGRADED' ELSE 'HEALTHY' END AS data_status,
  CASE WHEN as_of - bar_at > 7200 THEN 'UNSTABLE' WHEN squeeze = 'ON' THEN 'COMPRESSION' WHEN atr_state = 'HIGH' AND st[2] IN ('BOS', 'CHOCH') AND as_of - st[1] <= 3 * 3600 THEN 'EXPANSION'
    ELSE coalesce(base, 'UNKNOWN') END AS regime,
  st[2] || '/' || st[3] AS structure, nullif(concat_ws('/', squeeze, atr_state), '') AS volatility, liquidity FROM sn"""


@query("market_context", with_tables(_CONTEXT, "reg", "pev"))
def market_context(spark, d):
    """The market's state at every hour, gaps included: six kinds of facts carried on one timeline."""
    facts = structure_facts(spark, d)
    key, step = ["symbol", "tf"], C.TF_SECONDS[TF]
    from ..operators import structure as X
    from ..operators import swings as W

    tiered = facts.swings.where(F.col("tier") == W.STRUCTURE_TIER[TF])
    closed = (F.col("open_ts") + step).alias("known")
    bands = facts.bars.withColumns(S.bollinger() | S.keltner())
    on = (F.col("bb_upper") < F.col("kc_upper")) & (F.col("bb_lower") > F.col("kc_lower"))
    squeeze = bands.where("kc_upper is not null and bb_upper is not null").select(*key, closed, F.when(on, "ON").otherwise("OFF").alias("state"))
    ranked = facts.bars.withColumn("pct", S.midrank("atr"))
    atr = S.changes(ranked.withColumn("state", S.schmitt(F.col("pct"), _arms("pct", ATR_BANDS), "NORMAL")), "state").select(*key, closed, "state")
    labelled = X.labels(tiered).select(*key, "confirmed_at", F.lit("LABEL").alias("name"), F.col("label").alias("what"))
    shape = facts.breaks.select(*key, "confirmed_at", F.col("event").alias("name"), F.col("direction").alias("what")).unionByName(labelled)
    pooled = facts.pools.select(*key, "confirmed_at", F.lit("POOL").alias("event"))
    liquidity = facts.pool_events.select(*key, (F.col("market_time") + step).alias("confirmed_at"), "event").unionByName(pooled)
    hours = facts.bars.groupBy(*key).agg(F.min("open_ts").alias("a"), F.max("open_ts").alias("b")).select(
        *key, F.explode(F.sequence(F.col("a") + step, F.col("b") + 5 * step, F.lit(step).cast("long"))).alias("as_of")
    )
    told = asof_many(
        hours,
        {
            "bar": (facts.bars.select(*key, closed), "known", []),
            "base": (facts.regimes, "confirmed_at", ["regime"]),
            "shape": (shape, "confirmed_at", ["name", "what"]),
            "squeeze": (squeeze, "known", ["state"]),
            "atr_state": (atr, "known", ["state"]),
            "liquidity": (liquidity, "confirmed_at", ["event"]),
        },
        key, "as_of",
    )
    stale = F.col("as_of") - F.col("bar.at") > 2 * step
    broke = F.col("shape.name").isin("BOS", "CHOCH") & (F.col("as_of") - F.col("shape.at") <= 3 * step)
    regime = (
        F.when(stale, "UNSTABLE").when(F.col("squeeze.state") == "ON", "COMPRESSION").when((F.col("atr_state.state") == "HIGH") & broke, "EXPANSION")
        .otherwise(F.coalesce("base.regime", F.lit("UNKNOWN")))
    )
    volatility = F.concat_ws("/", "squeeze.state", "atr_state.state")
    return told.select(
        "symbol", "as_of", F.when(stale, "DEGRADED").otherwise("HEALTHY").alias("data_status"), regime.alias("regime"),
        F.when(F.col("shape").isNotNull(), F.concat_ws("/", "shape.name", "shape.what")).alias("structure"), F.nullif(volatility, F.lit("")).alias("volatility"),
        F.col("liquidity.event").alias("liquidity"),
    )


_LIFE = """
, po AS (
  SELECT v.*, n.base, n.leverage AS cap, n.maker, n.taker, n.settlements, ci + 1 AS order_i, CASE WHEN long THEN entry - 0.1 * risk ELSE entry + 0.1 * risk END AS maker_limit
  FROM vg v JOIN nm n ON n.symbol = v.symbol),
sz AS (SELECT *, least(200.0 / risk * entry / 10000.0, cap) AS lev, CASE WHEN 200.0 / risk * entry / 10000.0 > cap THEN round_even(200.0 * cap / (200.0 / risk * entry / 10000.0), 2) ELSE 200.0 END AS usd FROM po),
sz2 AS (
  SELECT *, CASE WHEN lev > 1 AND CASE WHEN 1 / lev - 0.005 <= 0 THEN CASE WHEN long THEN sl <= entry ELSE sl >= entry END
      WHEN long THEN sl <= entry * (1 - (1 / lev - 0.005)) ELSE sl >= entry * (1 + (1 / lev - 0.005)) END THEN 'REJECTED'
    WHEN usd / risk * entry < 1 THEN 'REJECTED' WHEN 200.0 / risk * entry / 10000.0 > cap THEN 'REDUCED' ELSE 'APPROVED' END AS decision FROM sz),
fi AS (
  SELECT s.*, (SELECT min(x.i) FROM ba x WHERE x.symbol = s.base AND x.i BETWEEN order_i AND order_i + 1 AND maker_limit BETWEEN x.low AND x.high) AS rest_i, x.open AS cross_open, x.atr AS cross_atr
  FROM sz2 s LEFT JOIN ba x ON x.symbol = s.base AND x.i = s.order_i + 2),
fj AS (
  SELECT *, CASE WHEN rest_i IS NOT NULL THEN maker_limit WHEN cross_open IS NOT NULL THEN CASE WHEN long THEN cross_open + 0.05 * coalesce(cross_atr, 0) ELSE cross_open - 0.05 * coalesce(cross_atr, 0) END END AS fill FROM fi),
fk AS (
  SELECT *, CASE WHEN fill IS NOT NULL AND CASE WHEN long THEN fill > sl ELSE fill < sl END THEN 'FILLED' ELSE 'PENDING' END AS status FROM fj),
fl AS (
  SELECT *, CASE WHEN status = 'FILLED' THEN coalesce(rest_i, order_i + 2) END AS fill_i, CASE WHEN status = 'FILLED' AND rest_i IS NULL THEN 'TAKER' ELSE 'MAKER' END AS entry_role FROM fk),
lh AS (
  SELECT f.setup_id, f.fill_i, x.i, x.close, x.atr AS xatr, CASE WHEN long THEN x.low <= sl ELSE x.high >= sl END AS hs, CASE WHEN long THEN x.high >= tp ELSE x.low <= tp END AS ht
  FROM fl f JOIN ba x ON x.symbol = f.base AND x.i >= f.fill_i AND x.i < f.fill_i + 100),
le AS (SELECT setup_id, coalesce(min(i) FILTER (hs OR ht), CASE WHEN max(i) = any_value(fill_i) + 99 THEN max(i) END) AS exit_i FROM lh GROUP BY setup_id),
lx AS (
  SELECT f.*, lh.i - f.fill_i AS bars_held, CASE WHEN hs THEN 'SL' WHEN ht THEN 'TP' ELSE 'TIMEOUT' END AS outcome, CASE WHEN hs THEN sl WHEN ht THEN tp ELSE lh.close END AS exit_price,
    CASE WHEN NOT hs AND ht THEN 0 ELSE 0.05 * coalesce(xatr, 0) END AS slip
  FROM fl f JOIN le ON le.setup_id = f.setup_id JOIN lh ON lh.setup_id = f.setup_id AND lh.i = le.exit_i),
ly AS (SELECT *, CASE WHEN long THEN exit_price - slip ELSE exit_price + slip END AS eff FROM lx),
lz AS (
  SELECT setup_id, outcome, bars_held, round_even((CASE WHEN long THEN eff - fill ELSE fill - eff END - (CASE entry_role WHEN 'TAKER' THEN taker ELSE maker END * fill + CASE outcome WHEN 'TP' THEN maker ELSE taker END * eff)
    - 1e-4 * bars_held * settlements / 24 * fill) / abs(fill - sl), 2) AS r_multiple FROM ly),
tr AS (
  SELECT f.symbol, f.setup_id, f.decision, CASE WHEN f.decision = 'REJECTED' THEN 0.0 ELSE f.usd END AS risk_usd, f.status, f.entry_role, f.fill_i, CASE WHEN f.status = 'FILLED' THEN f.fill END AS fill_price,
    z.outcome, z.bars_held, z.r_multiple, CASE WHEN z.outcome IS NOT NULL THEN 'CLOSED' WHEN f.status = 'FILLED' THEN 'OPEN' ELSE f.status END AS stage
  FROM fl f LEFT JOIN lz z USING (setup_id))
"""


def _on_life(final: str) -> str:
    return with_tables(_NAMES + _SETUPS + _LIFE + final, "zbr", "reg", "pev")


def lifecycle(spark: SparkSession, d: str, buckets: int = 8) -> DataFrame:
    """The validated setups' plans, sizes, orders and exits as tables that lie together, traced."""
    facts = named_facts(spark, d)
    valid = setup_facts(spark, d)[0].where("state = 'VALIDATED'")
    plans = written(valid.select("symbol", "tf", "setup_id", "direction", "entry", "sl", "tp", "maker_limit", F.col("fill_i").alias("order_i")), "plans")
    size = T.size_order(F.lit(U.START_EQUITY), F.col("entry"), F.col("sl"), F.col("symbol"), F.col("direction") == "LONG", F.lit(0.0))
    risk = plans.select("setup_id", size.alias("o")).select("setup_id", "o.decision", "o.risk_usd", "o.units")
    orders = written(E.simulate_entries(plans, facts.bars), "orders")
    filled = orders.where("status = 'FILLED'")
    execs = E.settle(E.walk_exits(filled, facts.bars), C.TF_SECONDS[TF])
    tables = L.colocated(
        {
            "plans": plans.select("symbol", "setup_id", "direction", F.col("entry").alias("planned_entry"), "sl", "tp"), "risk": risk,
            "orders": orders.select("setup_id", "status", "entry_role", "fill_i", F.when(F.col("status") == "FILLED", F.col("entry")).alias("fill_price")),
            "execs": execs.select("setup_id", "outcome", "bars_held", "r_multiple"),
        },
        buckets=buckets,
    )
    return L.trace(**tables)


@query("setup_trace", _on_life("""
SELECT symbol, setup_id, decision, round(risk_usd, 2) AS risk_usd, status, entry_role, fill_i, round(fill_price, 6) AS fill_price, outcome, bars_held, r_multiple, stage FROM tr"""))
def setup_trace(spark, d):
    return lifecycle(spark, d).select(
        "symbol", "setup_id", "decision", F.round("risk_usd", 2).alias("risk_usd"), "status", "entry_role", "fill_i", F.round("fill_price", 6).alias("fill_price"),
        "outcome", "bars_held", "r_multiple", "stage",
    )


@query("setup_outcomes", _on_life("""
SELECT symbol, count(*) AS planned, count(*) FILTER (decision <> 'REJECTED') AS sized, count(*) FILTER (stage IN ('OPEN', 'CLOSED')) AS filled, count(*) FILTER (stage = 'CLOSED') AS closed,
  count(*) FILTER (r_multiple > 0) AS winners, coalesce(round(sum(r_multiple), 6), 0) AS net_r FROM tr GROUP BY symbol"""))
def setup_outcomes(spark, d):
    """The funnel of the setups from plan to exit."""
    return L.funnel(lifecycle(spark, d), ["symbol"])
