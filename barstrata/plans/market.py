"""Market queries over the events table: bars, indicators, swings, structure, events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import series as S
from ..operators import structure as X
from ..operators import swings as W
from ..sources import candles as C
from ..streaming.bars import written
from .catalog import query
from .sql import ema_cte, with_tables

TF = "1H"


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return S.indexed(C.candles(spark, d, TF))


def _analysed(spark: SparkSession, d: str) -> DataFrame:
    return S.analysed(C.candles(spark, d, TF))


def _shared(spark: SparkSession, d: str) -> DataFrame:
    """The analysed bars as a table, for queries that read them several times."""
    return written(_analysed(spark, d), "analysed-bars")


def _pivots(bars: DataFrame) -> DataFrame:
    return W.promote(W.alternate(W.local(W.micro(bars))))


def _tiered(bars: DataFrame, *tiers: str) -> DataFrame:
    """Scored swings of the tiers, known once their held window is closed."""
    return W.scored(W.promote(W.alternate(W.local(W.micro(bars)))), bars).where(F.col("tier").isin(*tiers))


def squeeze_changes(bars: DataFrame) -> DataFrame:
    """The bars where the bands come inside the channels, or out of them."""
    out = bars.withColumns(S.bollinger() | S.keltner())
    on = (F.col("bb_upper") < F.col("kc_upper")) & (F.col("bb_lower") > F.col("kc_lower"))
    told = out.withColumn("state", F.when(F.col("kc_upper").isNotNull() & F.col("bb_upper").isNotNull(), F.when(on, "ON").otherwise("OFF")))
    return S.changes(told, "state")


def atr_changes(bars: DataFrame) -> DataFrame:
    """The bars where the band of ATR's percentile changes."""
    out = bars.withColumn("pct", S.midrank("atr"))
    return S.changes(out.withColumn("state", S.schmitt(F.col("pct"), _arms("pct", ATR_BANDS), "NORMAL")), "state")


def rvol_changes(bars: DataFrame) -> DataFrame:
    """The bars where the relative volume gets hot or dry."""
    out = bars.withColumn("rvol", S.relative_volume())
    return S.changes(out.withColumn("state", S.schmitt(F.col("rvol"), _arms("rvol", RVOL_BANDS), "NORMAL")), "state").where("state <> 'NORMAL'")


def vwap_changes(bars: DataFrame) -> DataFrame:
    """The bars whose close changes its ``side`` of the session's VWAP."""
    out = S.session_vwap(bars, TF).where("vwap is not null and atr is not null")
    side = F.when(F.col("close") > F.col("vwap") + F.col("tol"), "ABOVE").when(F.col("close") < F.col("vwap") - F.col("tol"), "BELOW")
    prev = F.lag("side").over(Window.partitionBy("symbol", "tf", "session").orderBy("open_ts"))
    return out.withColumn("side", side).where("side is not null").withColumn("prev", prev).where("prev <> side")


def divergences(bars: DataFrame) -> DataFrame:
    """(symbol, tf, market_time, confirmed_at, direction, lag_bars): swings beyond the last of their kind that rsi does not follow."""
    pivots = W.alternate(W.local(W.micro(bars))).join(bars.select("symbol", "tf", "i", "rsi"), ["symbol", "tf", "i"])
    order = Window.partitionBy("symbol", "tf").orderBy("market_time", "kind")
    two = {n: F.lag(c, 2).over(order) for n, c in (("p2", "price"), ("r2", "rsi"), ("i2", "i"), ("k2", "confirmed_at"))}
    out = pivots.withColumns(two).where(F.col("i") - F.col("i2") <= 100)
    hit = F.when(F.col("kind") == "HIGH", (F.col("price") > F.col("p2")) & (F.col("rsi") < F.col("r2"))).otherwise(
        (F.col("price") < F.col("p2")) & (F.col("rsi") > F.col("r2"))
    )
    return out.where(hit).select(
        "symbol",
        "tf",
        "market_time",
        F.greatest("confirmed_at", "k2", F.col("market_time") + 3600).alias("confirmed_at"),
        F.when(F.col("kind") == "HIGH", "BEARISH").otherwise("BULLISH").alias("direction"),
        (F.col("i") - F.col("i2")).alias("lag_bars"),
    )


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


@query("candles_1h", with_tables("SELECT symbol, open_ts, open, high, low, close, volume FROM c", "c"))
def candles_1h(spark, d):
    return C.candles(spark, d, TF).select("symbol", "open_ts", "open", "high", "low", "close", "volume")


@query("ohlc_integrity", with_tables(
    "SELECT symbol, count(*) AS bars, count(*) FILTER (NOT (high >= greatest(open, close, low) AND low <= least(open, close) AND low > 0)) AS bad FROM raw GROUP BY symbol", "raw"))
def ohlc_integrity(spark, d):
    bars = C.bars_from_ticks(C.event_ticks(spark, d), TF)
    return bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.count_if(~C.is_sound()).alias("bad"))


@query("candles_4h_complete", with_tables("""
SELECT symbol, open_ts // 14400 * 14400 AS open_ts, arg_min(open, open_ts) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, open_ts) AS close, sum(volume) AS volume
FROM c GROUP BY symbol, open_ts // 14400 HAVING count(*) = 4""", "c"))
def candles_4h(spark, d):
    return C.resample(C.candles(spark, d, TF), "4H").drop("tf")


@query("candles_1w_complete", with_tables("""
, d1 AS (SELECT event_type AS symbol, floor(epoch(ts) / 86400)::BIGINT * 86400 AS open_ts, ts, round(value, 2) AS price FROM events WHERE value IS NOT NULL),
d2 AS (SELECT symbol, open_ts, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, count(*)::DOUBLE AS volume FROM d1 GROUP BY symbol, open_ts)
SELECT symbol, (open_ts - 345600) // 604800 * 604800 + 345600 AS open_ts, arg_min(open, open_ts) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, open_ts) AS close, sum(volume) AS volume
FROM d2 WHERE low > 0 GROUP BY symbol, (open_ts - 345600) // 604800 HAVING count(*) = 7""", "t"))
def candles_1w(spark, d):
    return C.resample(C.candles(spark, d, "1D"), "1W").drop("tf")


@query("candle_gaps", with_tables("""
, s AS (SELECT symbol, unnest(range(min(open_ts), max(open_ts) + 1, 3600)) AS open_ts FROM c GROUP BY symbol)
SELECT s.symbol, s.open_ts FROM s ANTI JOIN c ON s.symbol = c.symbol AND s.open_ts = c.open_ts""", "c"))
def candle_gaps(spark, d):
    return C.gaps(C.candles(spark, d, TF)).select("symbol", "open_ts")


@query("true_range", with_tables("SELECT symbol, i, round(tr, 6) AS tr FROM b", "b"))
def true_range(spark, d):
    return _bars(spark, d).select("symbol", "i", *r6("tr"))


@query("atr14", with_tables("SELECT symbol, i, round(atr, 6) AS atr FROM ba", "ba"))
def atr14(spark, d):
    return _analysed(spark, d).select("symbol", "i", *r6("atr"))


@query("ema20", with_tables(f", {ema_cte('e', 20)} SELECT symbol, i, round(v, 6) AS ema20 FROM e", "b"))
def ema20(spark, d):
    return _analysed(spark, d).where("ema20 is not null").select("symbol", "i", *r6("ema20"))


@query("sma_ribbon", with_tables("""
SELECT symbol, i,
  CASE WHEN i >= 19 THEN round(avg(close) OVER (PARTITION BY symbol ORDER BY i ROWS 19 PRECEDING), 6) END AS sma20,
  CASE WHEN i >= 199 THEN round(avg(close) OVER (PARTITION BY symbol ORDER BY i ROWS 199 PRECEDING), 6) END AS sma200
FROM b""", "b"))
def sma_ribbon(spark, d):
    return _bars(spark, d).select("symbol", "i", F.round(S.sma("close", 20), 6).alias("sma20"), F.round(S.sma("close", 200), 6).alias("sma200"))


_RSI = """
, m AS (SELECT symbol, i, greatest(close - pc, 0) AS gain, greatest(pc - close, 0) AS loss FROM b WHERE i > 0),
r AS (
  SELECT symbol, 14::BIGINT AS i, sum(gain) / 14 AS g, sum(loss) / 14 AS l FROM m WHERE i <= 14 GROUP BY symbol HAVING count(*) = 14
  UNION ALL
  SELECT m.symbol, m.i, (r.g * 13 + m.gain) / 14, (r.l * 13 + m.loss) / 14 FROM r JOIN m ON m.symbol = r.symbol AND m.i = r.i + 1),
rsi AS (SELECT symbol, i, CASE WHEN g = 0 AND l = 0 THEN NULL WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END AS rsi FROM r)"""


@query("rsi14", with_tables(_RSI + " SELECT symbol, i, round(rsi, 6) AS rsi FROM rsi", "b"))
def rsi14(spark, d):
    return _analysed(spark, d).where("i >= 14").select("symbol", "i", *r6("rsi"))


_MACD = f"""
, {ema_cte('e12', 12)}, {ema_cte('e26', 26)},
m AS (SELECT e12.symbol, e12.i, e12.v - e26.v AS macd FROM e12 JOIN e26 USING (symbol, i)),
{ema_cte('sg', 9, 'm', 'macd', 25)},
mac AS (SELECT m.symbol, m.i, macd, sg.v AS signal FROM m LEFT JOIN sg USING (symbol, i))"""


@query("macd", with_tables(_MACD + " SELECT symbol, i, round(macd, 6) AS macd, round(signal, 6) AS signal FROM mac", "b"))
def macd(spark, d):
    return _analysed(spark, d).where("macd is not null").select("symbol", "i", *r6("macd", "signal"))


_BB = f"""
, {ema_cte('e', 20)},
bb AS (
  SELECT symbol, i, open_ts, avg(close) OVER w AS mid, 2 * stddev_pop(close) OVER w AS spread, atr
  FROM ba WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 19 PRECEDING)),
k AS (SELECT bb.*, mid + spread AS bu, mid - spread AS bl, e.v + 1.5 * atr AS ku, e.v - 1.5 * atr AS kl FROM bb JOIN e USING (symbol, i))"""


@query("bollinger_keltner", with_tables(_BB + " SELECT symbol, i, round(mid, 6) AS bb_mid, round(bu, 6) AS bb_upper, round(bl, 6) AS bb_lower, round(ku, 6) AS kc_upper, round(kl, 6) AS kc_lower FROM k", "ba"))
def bollinger_keltner(spark, d):
    out = _analysed(spark, d).withColumns(S.bollinger() | S.keltner()).where("i >= 19")
    return out.select("symbol", "i", *r6("bb_mid", "bb_upper", "bb_lower", "kc_upper", "kc_lower"))


@query("squeeze_events", with_tables(_BB + """
, s AS (SELECT *, CASE WHEN bu < ku AND bl > kl THEN 'ON' ELSE 'OFF' END AS state FROM k WHERE ku IS NOT NULL)
SELECT symbol, i, state, prev AS "from", i - pi AS bars_in_prev
FROM (SELECT symbol, i, state, prev, lag(i) OVER (PARTITION BY symbol ORDER BY i) AS pi
  FROM (SELECT *, lag(state) OVER (PARTITION BY symbol ORDER BY i) AS prev FROM s) WHERE prev IS DISTINCT FROM state)""", "ba"))
def squeeze_events(spark, d):
    return squeeze_changes(_analysed(spark, d)).select("symbol", "i", "state", "from", "bars_in_prev")


_PCT = """
, p AS (
  SELECT symbol, i, open_ts, atr, CASE WHEN atr IS NOT NULL AND len(xs) = 100
    THEN 100.0 * (len(list_filter(xs, lambda x: x < atr)) + len(list_filter(xs, lambda x: x <= atr))) / 200 END AS pct
  FROM (SELECT *, list(atr) FILTER (atr IS NOT NULL) OVER (PARTITION BY symbol ORDER BY i ROWS 99 PRECEDING) AS xs FROM ba))"""


@query("atr_percentile", with_tables(_PCT + " SELECT symbol, i, round(pct, 6) AS pct FROM p WHERE pct IS NOT NULL", "ba"))
def atr_percentile(spark, d):
    return _analysed(spark, d).withColumn("pct", S.midrank("atr")).where("pct is not null").select("symbol", "i", *r6("pct"))


def _schmitt_sql(source: str, value: str, arms: dict[str, tuple[str, str]], rest: str) -> str:
    """Tables ``st`` (states) and ``ch`` (changes), by an explicit fold over bars."""
    def arm(state: str) -> str:
        return " ".join(
            [f"WHEN {enter} THEN '{name}'" for name, (enter, _) in arms.items()]
            + [f"WHEN {state} = '{name}' AND {hold} THEN '{name}'" for name, (_, hold) in arms.items()]
        )
    return f"""
, q AS (SELECT symbol, i, {value} AS v, row_number() OVER (PARTITION BY symbol ORDER BY i) AS n FROM {source} WHERE {value} IS NOT NULL),
st AS (
  SELECT symbol, i, n, v, CASE {arm("''")} ELSE '{rest}' END AS state FROM q WHERE n = 1
  UNION ALL
  SELECT q.symbol, q.i, q.n, q.v, CASE {arm('st.state').replace('v ', 'q.v ')} ELSE '{rest}' END
  FROM st JOIN q ON q.symbol = st.symbol AND q.n = st.n + 1),
ch AS (
  SELECT symbol, i, state, prev AS "from", i - lag(i) OVER (PARTITION BY symbol ORDER BY i) AS bars_in_prev
  FROM (SELECT *, lag(state) OVER (PARTITION BY symbol ORDER BY i) AS prev FROM st) WHERE prev IS DISTINCT FROM state)"""


def _arms(column: str, bands: dict[str, tuple[str, float, float]]) -> dict:
    """Arms of ``S.schmitt``: state -> (side, enter, hold)."""
    value = F.col(column)
    side = {">": lambda x: value >= x, "<": lambda x: value <= x}
    return {name: (side[s](enter), side[s](hold)) for name, (s, enter, hold) in bands.items()}


def _sql_arms(bands: dict[str, tuple[str, float, float]]) -> dict[str, tuple[str, str]]:
    return {name: (f"v {s}= {enter}", f"v {s}= {hold}") for name, (s, enter, hold) in bands.items()}


RSI_BANDS = {"OVERBOUGHT": (">", 70, 65), "OVERSOLD": ("<", 30, 35)}
ATR_BANDS = {"COMPRESSED": ("<", 20, 30), "EXPANDED": (">", 80, 70)}
RVOL_BANDS = {"HOT": (">", 2.0, 1.5), "DRY": ("<", 0.5, 0.7)}


@query("rsi_band_events", with_tables(_RSI + _schmitt_sql("rsi", "rsi", _sql_arms(RSI_BANDS), "NEUTRAL") + " SELECT * FROM ch", "b"))
def rsi_band_events(spark, d):
    out = _analysed(spark, d).withColumn("state", S.schmitt(F.col("rsi"), _arms("rsi", RSI_BANDS), "NEUTRAL"))
    return S.changes(out, "state").select("symbol", "i", "state", "from", "bars_in_prev")


@query("atr_regime_events", with_tables(_PCT + _schmitt_sql("p", "pct", _sql_arms(ATR_BANDS), "NORMAL") + " SELECT * FROM ch", "ba"))
def atr_regime_events(spark, d):
    return atr_changes(_analysed(spark, d)).select("symbol", "i", "state", "from", "bars_in_prev")


_RVOL = """
, rv AS (
  SELECT symbol, i, CASE WHEN i >= 20 AND base > 0 THEN volume / base END AS rvol
  FROM (SELECT *, avg(volume) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS base FROM b))"""


@query("rvol_events", with_tables(_RVOL + _schmitt_sql("rv", "rvol", _sql_arms(RVOL_BANDS), "NORMAL") + " SELECT * FROM ch WHERE state <> 'NORMAL'", "b"))
def rvol_events(spark, d):
    return rvol_changes(_bars(spark, d)).select("symbol", "i", "state", "from", "bars_in_prev")


@query("macd_events", with_tables(_MACD + """
, g AS (
  SELECT symbol, i, 'MACD_SIGNAL' AS event, CASE WHEN macd > signal THEN 'UP' WHEN macd < signal THEN 'DOWN' END AS side FROM mac WHERE signal IS NOT NULL
  UNION ALL SELECT symbol, i, 'MACD_ZERO', CASE WHEN macd > 0 THEN 'UP' WHEN macd < 0 THEN 'DOWN' END FROM mac)
SELECT symbol, i, event, side FROM (SELECT *, lag(side) OVER (PARTITION BY symbol, event ORDER BY i) AS prev FROM g WHERE side IS NOT NULL)
WHERE prev IS NOT NULL AND prev <> side""", "b"))
def macd_events(spark, d):
    sign = lambda x: F.when(x > 0, "UP").when(x < 0, "DOWN")
    out = _analysed(spark, d)
    both = [
        out.select("symbol", "tf", "i", "open_ts", F.lit("MACD_SIGNAL").alias("event"), sign(F.col("macd") - F.col("signal")).alias("side")),
        out.select("symbol", "tf", "i", "open_ts", F.lit("MACD_ZERO").alias("event"), sign(F.col("macd")).alias("side")),
    ]
    prev = F.lag("side").over(Window.partitionBy("symbol", "tf", "event").orderBy("open_ts"))
    told = reduce(DataFrame.unionByName, both).where("side is not null").withColumn("prev", prev)
    return told.where("prev is not null and prev <> side").select("symbol", "i", "event", "side")


_VWAP = """
, v AS (
  SELECT *, open_ts // 86400 * 86400 AS session, (high + low + close) / 3 AS tp FROM ba),
vw AS (
  SELECT *, count(*) OVER w AS n, sum(tp * volume) OVER w / sum(volume) OVER w AS vwap
  FROM v WINDOW w AS (PARTITION BY symbol, session ORDER BY open_ts))"""


@query("session_vwap", with_tables(_VWAP + " SELECT symbol, i, round(vwap, 6) AS vwap FROM vw WHERE n >= 3", "ba"))
def session_vwap(spark, d):
    return S.session_vwap(_bars(spark, d), TF).where("vwap is not null").select("symbol", "i", *r6("vwap"))


@query("vwap_cross", with_tables(_VWAP + """
, s AS (
  SELECT symbol, i, session, CASE WHEN close > vwap + tol THEN 'ABOVE' WHEN close < vwap - tol THEN 'BELOW' END AS side
  FROM vw WHERE n >= 3 AND tol IS NOT NULL AND atr IS NOT NULL)
SELECT symbol, i, side FROM (SELECT *, lag(side) OVER (PARTITION BY symbol, session ORDER BY i) AS prev FROM s WHERE side IS NOT NULL)
WHERE prev IS NOT NULL AND prev <> side""", "ba"))
def vwap_cross(spark, d):
    return vwap_changes(_analysed(spark, d)).select("symbol", "i", "side")


@query("poc", with_tables("""
, pb AS (
  SELECT symbol, i, volume, pw * 9000 + floor(tp * pow(10, 3 - pw) + 1e-9) - 1000 AS bin
  FROM (SELECT *, floor(log10(tp) + 1e-12) AS pw FROM (SELECT *, (high + low + close) / 3 AS tp FROM b))),
w AS (SELECT x.symbol, x.i, y.bin, sum(y.volume) AS v FROM pb x JOIN pb y ON x.symbol = y.symbol AND y.i BETWEEN x.i - 99 AND x.i WHERE x.i >= 99 GROUP BY ALL)
SELECT symbol, i, arg_max(bin, (v, bin))::BIGINT AS poc_bin, round(max(v) / sum(v), 6) AS share FROM w GROUP BY symbol, i""", "b"))
def poc(spark, d):
    return S.rolling_poc(_bars(spark, d)).select("symbol", "i", "poc_bin", *r6("share"))


@query("micro_swings", with_tables("SELECT symbol, market_time, confirmed_at, kind, price FROM mic", "mic"))
def micro_swings(spark, d):
    return W.micro(_analysed(spark, d)).select("symbol", "market_time", "confirmed_at", "kind", "price")


@query("local_swings", with_tables("SELECT symbol, market_time, confirmed_at, kind, price FROM loc", "loc"))
def local_swings(spark, d):
    return W.local(W.micro(_analysed(spark, d))).select("symbol", "market_time", "confirmed_at", "kind", "price")


@query("alternate_swings", with_tables("SELECT symbol, market_time, confirmed_at, kind, price FROM alt", "alt"))
def alternate_swings(spark, d):
    return W.alternate(W.local(W.micro(_analysed(spark, d)))).select("symbol", "market_time", "confirmed_at", "kind", "price")


@query("promoted_swings", with_tables("SELECT symbol, market_time, confirmed_at, kind, price, round(margin, 6) AS margin FROM pro", "pro"))
def promoted_swings(spark, d):
    return _pivots(_analysed(spark, d)).select("symbol", "market_time", "confirmed_at", "kind", "price", *r6("margin"))


@query("scored_swings", with_tables("""
SELECT symbol, market_time, confirmed_at, kind, price, tier, round(score, 2) AS score, held, i, p_margin, p_reversal, p_held, p_volume, p_liquidity, p_dominance FROM sco""", "sco"))
def scored_swings(spark, d):
    bars = _shared(spark, d)
    return W.scored(_pivots(bars), bars).drop("tf", "atr").withColumn("held", F.col("held").cast("long"))


@query("structure_labels", with_tables("SELECT symbol, market_time, confirmed_at, kind, price, label FROM lab WHERE label IS NOT NULL", "lab"))
def structure_labels(spark, d):
    return X.labels(_tiered(_shared(spark, d), W.STRUCTURE_TIER[TF])).select("symbol", "market_time", "confirmed_at", "kind", "price", "label")


@query("structure_breaks", with_tables("SELECT symbol, market_time, confirmed_at, event, direction, level, level_swing_ts FROM brk", "brk"))
def structure_breaks(spark, d):
    bars = _shared(spark, d)
    return X.breaks(_tiered(bars, W.STRUCTURE_TIER[TF]), bars).drop("tf")


@query("regime_changes", with_tables("SELECT symbol, market_time, confirmed_at, regime, hl AS high_label, ll AS low_label FROM reg", "reg"))
def regime_changes(spark, d):
    bars = _shared(spark, d)
    pivots = written(_tiered(bars, W.STRUCTURE_TIER[TF]), "swings")
    return X.regimes(X.labels(pivots), X.breaks(pivots, bars)).drop("tf")


@query("zones_created", with_tables("""
SELECT symbol, zone_id, zone_type, confirmed_at, round(bottom, 6) AS bottom, round(top, 6) AS top, cluster,
  least(100, 50 + least(30, 10 * cluster))::BIGINT AS quality FROM zon""", "zon"))
def zones_created(spark, d):
    return X.zones(written(_tiered(_shared(spark, d), *W.POOL_TIERS), "swings")).select("symbol", "zone_id", "zone_type", "confirmed_at", *r6("bottom", "top"), "cluster", "quality")


@query("zone_events", with_tables("""
, o AS (
  SELECT z.symbol, z.zone_id, x.i, x.open_ts, lag(x.i) OVER (PARTITION BY z.zone_id ORDER BY x.i) AS pi
  FROM zbr z JOIN ba x ON x.symbol = z.symbol AND x.i > z.i AND x.open_ts + 3600 > z.confirmed_at AND (z.broken_i IS NULL OR x.i < z.broken_i)
    AND x.low <= z.top AND x.high >= z.bottom),
e AS (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY i) AS episode FROM o WHERE pi IS NULL OR pi < i - 1)
SELECT symbol, zone_id, open_ts AS market_time, 'TOUCH' AS event, CASE episode WHEN 1 THEN 'TOUCHED' WHEN 2 THEN 'TESTED' ELSE 'WEAKENED' END AS state, episode
FROM e WHERE episode <= 10
UNION ALL
SELECT z.symbol, z.zone_id, x.open_ts, 'BROKEN', 'BROKEN', NULL FROM zbr z JOIN ba x ON x.symbol = z.symbol AND x.i = z.broken_i""", "zbr"))
def zone_events(spark, d):
    bars = _shared(spark, d)
    zones = written(X.zones(written(_tiered(bars, *W.POOL_TIERS), "swings")), "zones")
    return X.zone_events(zones, bars).drop("tf")


@query("liquidity_pools", with_tables("SELECT symbol, pool_id, kind, market_time, confirmed_at, level, n_members, i FROM poo", "poo"))
def liquidity_pools(spark, d):
    return X.pools(written(_tiered(_shared(spark, d), *W.POOL_TIERS), "swings")).drop("tf")


@query("liquidity_events", with_tables("""
SELECT symbol, pool_id, swept_at AS market_time, 'SWEEP' AS event FROM pev WHERE swept_at IS NOT NULL
UNION ALL SELECT symbol, pool_id, broken_at, 'BROKEN' FROM pev WHERE broken_at IS NOT NULL""", "pev"))
def liquidity_events(spark, d):
    bars = _shared(spark, d)
    pools = written(X.pools(written(_tiered(bars, *W.POOL_TIERS), "swings")), "pools")
    return X.pool_events(pools, bars).drop("tf")


_FVG = with_tables("""
SELECT symbol, open_ts AS market_time, direction, bottom, top, f - i AS fill_lag
FROM (
  SELECT g.*, (SELECT min(x.i) FROM ba x WHERE x.symbol = g.symbol AND x.i > g.i AND CASE WHEN g.direction = 'BULL' THEN x.low <= g.bottom ELSE x.high >= g.top END) AS f
  FROM gap g WHERE top - bottom >= 0.25 * atr)""", "gap")


@query("fvg", _FVG)
def fvg(spark, d):
    return X.gaps(_analysed(spark, d)).select("symbol", "market_time", "direction", "bottom", "top", "fill_lag")


@query("divergence", with_tables(_RSI + """
, a AS (
  SELECT alt.*, rsi.rsi, lag(price, 2) OVER w AS p2, lag(rsi.rsi, 2) OVER w AS r2, lag(alt.i, 2) OVER w AS i2, lag(alt.confirmed_at, 2) OVER w AS k2
  FROM alt LEFT JOIN rsi ON rsi.symbol = alt.symbol AND rsi.i = alt.i WINDOW w AS (PARTITION BY alt.symbol ORDER BY market_time, kind))
SELECT symbol, market_time, greatest(confirmed_at, k2, market_time + 3600) AS confirmed_at,
  CASE WHEN kind = 'HIGH' THEN 'BEARISH' ELSE 'BULLISH' END AS direction, i - i2 AS lag_bars
FROM a WHERE i - i2 <= 100 AND CASE WHEN kind = 'HIGH' THEN price > p2 AND rsi < r2 ELSE price < p2 AND rsi > r2 END""", "alt"))
def divergence(spark, d):
    return divergences(_analysed(spark, d)).drop("tf")
