"""Every query of the analytics engine against its DuckDB oracle, or for a stable result without one."""

from __future__ import annotations

from pathlib import Path

import pytest

from barstrata.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck():
    import duckdb

    path = Path("/root/testdata/sf0.001")
    if not path.is_dir():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in path.glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, sf_dir, duck, name):
    ours = QUERIES[name](spark, sf_dir)
    theirs = duck.execute(ORACLES[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    got = [tuple(r[c] for c in sorted(columns)) for r in ours.collect()]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    want = [tuple(r[k] for k in order) for r in theirs.fetchall()]
    assert key(got) == key(want)


def key(found: list[tuple]) -> list[str]:
    """Rows as text, floats to nine digits, sorted."""

    def plain(x):
        return f"{float(x) + 0.0:.9g}" if isinstance(x, float) or type(x).__name__ == "Decimal" else repr(x)

    return sorted(str([plain(x) for x in r]) for r in found)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_is_repeatable(spark, sf_dir, name):
    once, again = (key([tuple(r) for r in QUERIES[name](spark, sf_dir).collect()]) for _ in range(2))
    assert once == again


def breaks_by_definition(swings, rows, tol):
    """Every bar against the latest swing that its side knows and that formed after its last break."""
    found, last, direction = set(), {"HIGH": -1, "LOW": -1}, None
    for _, _, ts, _, _, _, close, _ in rows:
        for kind, side, sign in (("HIGH", "BULL", 1), ("LOW", "BEAR", -1)):
            known = [r for r in swings if r.kind == kind and r.confirmed_at <= ts + 3600 and r.market_time > last[kind]]
            level = max(known, key=lambda r: r.market_time, default=None)
            if level and tol[ts] is not None and sign * (close - level.price) > tol[ts]:
                found.add((ts, "BOS" if direction in (None, side) else "CHOCH", side, level.market_time, level.price))
                last[kind], direction = ts, side
    return found


def pools_by_definition(swings, atr):
    """Clusters in order of time; one that holds a swing of an earlier pool is none."""
    found = set()
    for kind, extreme in (("HIGH", max), ("LOW", min)):
        own, taken = sorted((r for r in swings if r.kind == kind), key=lambda r: r.market_time), set()
        for r in own:
            near = [x for x in own if 0 < r.market_time - x.market_time <= 360_000 and abs(x.price - r.price) <= 0.1 * atr[r.market_time]]
            cluster = {x.market_time for x in [*near, r]}
            if near and not cluster & taken:
                taken |= cluster
                found.add((kind, r.market_time, extreme(x.price for x in [*near, r]), len(cluster)))
    return found


def test_pools_and_their_events_by_definition(spark):
    import numpy as np

    from barstrata.operators import structure as X

    rng = np.random.default_rng(8)
    columns = "symbol string, tf string, kind string, market_time long, confirmed_at long, price double, atr double, i long"
    rows = [("A", "1H", kind, 3600 * i, 3600 * (i + 3), float(np.round(100 + rng.normal(0, 1), 2)), 3.0, i) for kind in ("HIGH", "LOW") for i in range(0, 900, 7)]
    swings = spark.createDataFrame(rows, columns)
    pools = X.pools(swings).collect()
    assert len(pools) > 20
    assert {(r.kind, r.market_time, r.level, r.n_members) for r in pools} == pools_by_definition(swings.collect(), {r[3]: r[6] for r in rows})
    close = np.round(100 + np.cumsum(rng.normal(0, 0.4, 1000)), 2)
    bars = [("A", "1H", 3600 * i, i, float(c + a), float(c - b), float(c), 0.01, 0.01) for i, (c, a, b) in enumerate(zip(close, *np.round(rng.uniform(0, 1, (2, 1000)), 2), strict=True))]
    told = X.pool_events(spark.createDataFrame(pools), spark.createDataFrame(bars, "symbol string, tf string, open_ts long, i long, high double, low double, close double, tol double, tick double"))
    want = set()
    for p in pools:
        sign = 1 if p.kind == "HIGH" else -1
        swept = False
        for _, _, ts, i, high, low, c, tol, _ in bars:
            if i <= p.i or ts + 3600 <= p.confirmed_at:
                continue
            if c - tol > p.level if sign > 0 else c + tol < p.level:
                want.add((p.pool_id, "BROKEN", ts))
                break
            if not swept and (high > p.level >= c if sign > 0 else low < p.level <= c):
                swept = True
                want.add((p.pool_id, "SWEEP", ts))
    assert {(r.pool_id, r.event, r.market_time) for r in told.collect()} == want and len(want) > 20


def test_structure_reads_scored_swings(spark, monkeypatch):
    import numpy as np

    from barstrata.operators import series as S
    from barstrata.plans import market

    rng = np.random.default_rng(5)
    close = np.round(200 + np.cumsum(rng.normal(0, 1, 700)) + 6 * np.sin(np.arange(700) / 9), 2)
    rows = [("A", "1H", 3600 * k, float(c), float(c + a), float(c - b), float(c), float(v)) for k, (c, a, b, v) in enumerate(zip(close, *np.round(rng.uniform(0.1, 1.5, (2, 700)), 2), rng.integers(1, 50, 700), strict=True))]
    bars = spark.createDataFrame(rows, "symbol string, tf string, open_ts long, open double, high double, low double, close double, volume double")
    monkeypatch.setattr(market.C, "candles", lambda *_: bars)
    scored = market.scored_swings(spark, "").collect()
    tier = {(r.market_time, r.kind): r for r in scored}
    assert {r.tier for r in scored} == {"INTERMEDIATE", "MAJOR"}
    breaks = market.structure_breaks(spark, "").collect()
    assert breaks
    for r in breaks:
        swing = tier[r.level_swing_ts, "HIGH" if r.direction == "BULL" else "LOW"]
        assert swing.tier == "INTERMEDIATE" and swing.confirmed_at <= r.confirmed_at
    swings = [r for r in scored if r.tier == "INTERMEDIATE"]
    tol = {r.open_ts: r.tol for r in S.analysed(bars).collect()}
    assert {(r.market_time, r.event, r.direction, r.level_swing_ts, r.level) for r in breaks} == breaks_by_definition(swings, rows, tol)
    known = {r.confirmed_at for r in scored if r.tier == "INTERMEDIATE"} | {r.confirmed_at for r in breaks}
    from barstrata.plans import universe

    want = {}
    for k, row in enumerate(rows):
        side = {kind: sorted((r for r in scored if r.kind == kind and r.confirmed_at <= row[2] + 3600), key=lambda r: r.market_time)[-6:] for kind in ("HIGH", "LOW")}
        if all(side.values()) and (hi := max(r.price for r in side["HIGH"])) > (lo := min(r.price for r in side["LOW"])):
            want[k] = int(min(100, max(0, 100 * (row[6] - lo) / (hi - lo))))
    assert len(want) > 100 and {r.i: r.pct for r in universe.premium_discount(spark, "").collect()} == want
    regimes = market.regime_changes(spark, "").collect()
    assert regimes and {r.confirmed_at for r in regimes} <= known


def test_append_is_idempotent(spark):
    from barstrata.operators.facts import append, as_facts, superseded

    swings = spark.createDataFrame([("A", "1H", 0, 7200, "HIGH", "9"), ("A", "1H", 0, 7200, "HIGH", "9")], "symbol string, tf string, market_time long, confirmed_at long, type string, price string")
    facts = as_facts(swings, "swing", "v1", ["type", "price"])
    held = append(facts.limit(0), facts)
    assert held.count() == 1 and held.first()["payload"] == '{"price":"9","type":"HIGH"}'
    assert append(held, facts).count() == 0
    both = held.unionByName(as_facts(swings, "swing", "v2", ["type", "price"]))
    assert {r["algo_version"] for r in superseded(both, ["symbol", "tf", "kind", "market_time"]).collect()} == {"v1"}


def test_resample_needs_every_bar(spark):
    from barstrata.sources.candles import gaps, resample

    bars = lambda hours: spark.createDataFrame(
        [("A", "1H", 3600 * h, 100.0 + h, 102.0 + h, 98.0 + h, 101.0 + h, 1.0) for h in hours],
        "symbol string, tf string, open_ts long, open double, high double, low double, close double, volume double",
    )
    whole = resample(bars(range(4)), "4H").collect()
    assert [tuple(r) for r in whole] == [("A", 0, 100.0, 105.0, 98.0, 104.0, 4.0, "4H")]
    assert resample(bars([0, 1, 3]), "4H").isEmpty()
    assert [r["open_ts"] for r in gaps(bars([0, 1, 3])).collect()] == [7200]


def test_stream_emits_closed_bars_once(spark, tmp_path):
    from barstrata.streaming.bars import closed_bars, run_to_end, stream_files

    schema = "symbol string, ts timestamp, seq long, price double"
    ticks = lambda *x: spark.createDataFrame([("A", t, k, p) for k, (t, p) in enumerate(x)], "symbol string, ts string, seq long, price double").selectExpr("symbol", "cast(ts as timestamp) ts", "seq", "price")
    source, folder = str(tmp_path / "ticks"), str(tmp_path / "live")
    ticks(("2024-01-01 00:10:00", 5.0), ("2024-01-01 00:50:00", 7.0), ("2024-01-01 01:10:00", 6.0)).coalesce(1).write.parquet(source)
    wanted = spark.read.parquet(source).schema
    assert wanted.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    first = run_to_end(closed_bars(stream_files(spark, source, wanted), "1H"), folder)
    assert [(r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in first.collect()] == [(5.0, 7.0, 5.0, 7.0, 2.0)]
    # A late tick of the closed bar is dropped; the next bar closes.
    ticks(("2024-01-01 00:20:00", 1.0), ("2024-01-01 02:30:00", 8.0)).coalesce(1).write.mode("append").parquet(source)
    later = run_to_end(closed_bars(stream_files(spark, source, wanted), "1H"), folder)
    assert sorted((r["open_ts"] % 86400, r["low"]) for r in later.collect()) == [(0, 5.0), (3600, 6.0)]


def test_fact_sink_appends_each_fact_once(spark, tmp_path):
    from barstrata.streaming.bars import fact_sink

    path = str(tmp_path / "facts")
    batch = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "fact_hash string, n int")
    write = fact_sink(path)
    write(batch, 0)
    write(batch, 0)  # run again after a failure
    write(spark.createDataFrame([("b", 2), ("c", 3)], "fact_hash string, n int"), 1)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_upsert_and_earliest(spark):
    from barstrata.operators.joins import earliest
    from barstrata.sources.candles import upsert

    bars = lambda *x: spark.createDataFrame([("A", "1H", t, c) for t, c in x], "symbol string, tf string, open_ts long, close double")
    assert sorted((r.open_ts, r.close) for r in upsert(bars((0, 1.0), (3600, 2.0)), bars((3600, 5.0), (7200, 6.0))).collect()) == [(0, 1.0), (3600, 5.0), (7200, 6.0)]
    assert [r.close for r in earliest(bars((7200, 6.0), (3600, 5.0)), ["symbol", "tf"], ["open_ts"]).collect()] == [5.0]


def test_spread_ratio_by_definition(spark):
    import numpy as np

    from barstrata.operators.profile import spread_ratio

    rng = np.random.default_rng(3)
    close = np.round(50 + np.cumsum(rng.normal(0, 0.3, 120)), 2)
    rows = [("A", "1H", 3600 * k, k, float(c + a), float(c - b), float(c), float(v)) for k, (c, a, b, v) in enumerate(zip(close, *np.round(rng.uniform(0, 1, (2, 120)), 2), rng.integers(1, 90, 120), strict=True))]
    bars = spark.createDataFrame(rows, "symbol string, tf string, open_ts long, i long, high double, low double, close double, volume double")
    step, want, median = round(0.0025 * rows[0][6], 8), {}, None
    for i in range(24, 120):
        volume = {}
        for _, _, _, _, high, low, _, v in rows[i - 23 : i + 1]:
            bins = range(int(low // step), int(high // step) + 1)
            for b in bins:
                volume[b] = volume.get(b, 0.0) + v / len(bins)
        if (i - 24) % 5 == 0:
            median = sorted(volume.values())[len(volume) // 2]
        want[i] = volume[int(rows[i][6] // step)] / median
    got = {r.i: r.ratio for r in spread_ratio(bars, 24, 5).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-8 for i in want)
