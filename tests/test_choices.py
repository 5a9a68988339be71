"""Setups, targets, ranges, cycles and trends: by SQL on trending prices, and by definition."""

import bisect
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from trending import write_events

DAY = 86400


@pytest.fixture(scope="module")
def trending(tmp_path_factory):
    return write_events(str(tmp_path_factory.mktemp("trending")))


def both(spark, name, folder):
    """The query's rows and its SQL's, as comparable tuples in one order of columns."""
    from barstrata.plans.catalog import ORACLES, QUERIES

    frame = QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
    told = con.execute(ORACLES[name])
    columns = [c[0] for c in told.description]
    assert sorted(columns) == sorted(frame.columns)
    plain = lambda v: round(float(v), 6) if isinstance(v, float) or hasattr(v, "quantize") else v
    rows = lambda found: sorted((tuple(map(plain, r)) for r in found), key=str)
    return [dict(zip(columns, r, strict=True)) for r in rows(frame.select(*columns).collect())], [dict(zip(columns, r, strict=True)) for r in rows(told.fetchall())]


def test_setups_reach_every_state_as_in_sql(spark, trending):
    got, want = both(spark, "setups", trending)
    assert got == want
    states = {(r["state"], r["direction"]) for r in got}
    assert {s for s, _ in states} == {"FORMING", "CONFIRMING", "VALIDATED", "CANCELLED", "EXPIRED"}
    assert {r["strategy"] for r in got} == {"PULLBACK", "REVERSAL"}
    assert {r["reason"] for r in got} >= {"ZONE_BROKE_UNCONFIRMED", "CONFIRMATION_TIMEOUT", None}


@pytest.mark.parametrize("name", ["setup_rejections", "range_events", "trend_continuations", "breakout_retests", "structure_breaks", "regime_changes", "liquidity_events", "zone_events", "managed_exits", "open_gap_side", "factor_cohorts", "divergence_audition", "scale_ins", "prunable_facts"])
def test_choices_equal_their_sql_on_trending_prices(spark, trending, name):
    got, want = both(spark, name, trending)
    assert got == want and got
    if name == "trend_continuations":
        assert {r["direction"] for r in got} == {"LONG", "SHORT"} and {r["reason"] for r in got} >= {None, "NO_CAUSAL_TARGET"}


def test_nearest_active_by_definition(spark):
    from barstrata.operators.joins import nearest_active

    rng = np.random.default_rng(3)
    step = 3600
    levels = []
    for _ in range(400):
        known = int(rng.integers(0, 300)) * step + 7
        gone = None if rng.random() < 0.3 else known + int(rng.integers(0, 200)) * step
        levels.append((str(rng.choice(["A", "B"])), "1H", str(rng.choice(["HIGH", "LOW"])), float(rng.integers(90, 110)), known, gone))
    wanted = [(k, str(rng.choice(["A", "B", "C"])), "1H", bool(rng.integers(2)), float(rng.integers(88, 112)), int(rng.integers(0, 300)) * step + 7) for k in range(500)]
    left = spark.createDataFrame(wanted + wanted[:5], "k int, symbol string, tf string, long boolean, price double, as_of long")
    right = spark.createDataFrame(levels, "symbol string, tf string, kind string, level double, known long, gone long")
    got = nearest_active(left, right, F.lit(step)).collect()

    def nearest(symbol, long, price, as_of):
        found = [v for s, _, kind, v, known, gone in levels if s == symbol and kind == ("HIGH" if long else "LOW") and known <= as_of and (gone is None or gone > as_of)]
        beyond = [v for v in found if (v > price if long else v < price)]
        return (min if long else max)(beyond, default=None)

    assert len(got) == 505 and sum(r.target is None for r in got) > 20
    assert all(r.target == nearest(r.symbol, r.long, r.price, r.as_of) for r in got)
    empty = spark.createDataFrame([], right.schema)
    assert [r.target for r in nearest_active(left.limit(3), empty, F.lit(step)).collect()] == [None] * 3


def test_dyadic_blocks_cover_an_interval_once(spark):
    from barstrata.operators.joins import active_blocks

    spans = [(a, b) for a in range(0, 20) for b in range(a, 33)]
    rows = spark.createDataFrame(spans, "a long, b long").select("a", "b", active_blocks(F.col("a"), F.col("b"), F.lit(6)).alias("x")).collect()
    for r in rows:
        covered = sorted(n for x in r.x for n in range(x.block << x.k, (x.block + 1) << x.k))
        assert covered == list(range(r.a, r.b))
        assert len(r.x) <= 2 * math.ceil(math.log2(r.b - r.a + 1) + 1)


def test_reachable_by_definition(spark):
    from barstrata.operators.paths import reachable

    rng = np.random.default_rng(6)
    links = {(s, n): None if rng.random() < 0.001 else n + int(rng.integers(1, 4)) for s in "AB" for n in range(600) if rng.random() < 0.995}
    frame = spark.createDataFrame([(s, "1H", n, to) for (s, n), to in links.items()], "symbol string, tf string, at long, to long")
    starts = [("A", 0), ("A", 301), ("B", 5)]
    want = set()
    for s, n in starts:
        while n is not None and (s, n) not in want:
            want.add((s, n))
            n = links.get((s, n))
    got = reachable(frame, spark.createDataFrame([(s, "1H", n) for s, n in starts], "symbol string, tf string, at long"))
    assert sorted((r.symbol, r["at"]) for r in got.collect()) == sorted(want) and len(want) > 100


def cycles_by_definition(days, seed, band):
    """Accepted lows with their lateness, and the bands without one; ``days`` are (ts, low) in order."""
    pool = [t for k, (t, low) in enumerate(days) if 2 <= k < len(days) - 2 and all(low < days[k + o][1] for o in (-2, -1, 1, 2))]
    return walk_lows(pool, dict(days), seed, band, days[-1][0])


def walk_lows(pool, low, seed, band, end):
    lows, inversions, last = [(seed, False)], [], seed
    while True:
        first, stop = last + band[0] * DAY, last + band[1] * DAY
        inside = [t for t in pool if first <= t <= stop]
        if inside:
            last = min(inside, key=lambda t: (low[t], t))
            lows.append((last, False))
            continue
        if stop + 2 * DAY > end:
            return lows, inversions
        inversions.append(last)
        at = bisect.bisect_right(pool, stop)
        if at == len(pool):
            return lows, inversions
        last = pool[at]
        lows.append((last, True))


def test_cycle_lows_and_inversions_by_definition(spark):
    from barstrata.operators import cycles as Y

    rng = np.random.default_rng(12)
    series = {}
    for symbol in ("A", "B"):
        n, t, days = 900, 0, []
        while len(days) < n:
            t += DAY * (int(rng.integers(20, 60)) if rng.random() < 0.02 else 1)
            # Lows come in stretches: where prices fall for weeks there is no fractal low.
            days.append((t, float(np.round(500 + 60 * np.sin(len(days) / 25) + (rng.normal(0, 3) if (len(days) // 90) % 2 else 0), 2))))
        series[symbol] = days
    rows = [(s, "1D", t, low, low + 5, low + 1, k) for s, days in series.items() for k, (t, low) in enumerate(days)]
    bars = spark.createDataFrame(rows, "symbol string, tf string, open_ts long, low double, high double, close double, i long")
    pool = Y.fractal_lows(bars)
    seeds = pool.groupBy("symbol", "tf").agg(F.min("at").alias("at"))
    lows, turned = Y.cycle_lows(pool, seeds, bars, Y.DAILY_DAYS, "DCL")
    got = {s: sorted((r["at"], r.late) for r in lows.where(F.col("symbol") == s).collect()) for s in series}
    gaps = {s: sorted(r.after_low for r in turned.where(F.col("symbol") == s).collect()) for s in series}
    start = {r.symbol: r["at"] for r in seeds.collect()}
    want = {s: cycles_by_definition(days, start[s], Y.DAILY_DAYS) for s, days in series.items()}
    assert got == {s: w[0] for s, w in want.items()} and gaps == {s: w[1] for s, w in want.items()}
    assert sum(len(g) for g in gaps.values()) > 3 and any(late for x in got.values() for _, late in x)
    # A seed that is no bar gives no cycle.
    assert Y.cycle_lows(pool, seeds.withColumn("at", F.col("at") + 1), bars, Y.DAILY_DAYS, "DCL")[0].count() == 0


def test_operators_lose_no_rows_under_sparks_default_for_unions(spark, trending):
    """The same rows with and without partitionings taken from unions, outside registered queries."""
    from barstrata.operators import structure as X
    from barstrata.operators import swings as W
    from barstrata.plans import market

    def told():
        bars = market._analysed(spark, trending)
        swings = W.scored(market._pivots(bars), bars)
        tier = swings.where("tier = 'INTERMEDIATE'")
        zones, pools = X.zones(swings), X.pools(swings)
        frames = [swings, X.breaks(tier, bars), X.regimes(X.labels(tier), X.breaks(tier, bars)), X.zone_events(zones, bars), X.pool_events(pools, bars), X.gaps(bars)]
        return [sorted(map(str, f.collect())) for f in frames]

    held = spark.conf.get("spark.sql.unionOutputPartitioning")
    try:
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
        want = told()
        spark.conf.set("spark.sql.unionOutputPartitioning", "true")
        assert told() == want and all(want)
    finally:
        spark.conf.set("spark.sql.unionOutputPartitioning", held)
