"""Bars that the stream has told and then takes back."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest


def test_stream_takes_back_bars_that_are_not_sound_as_in_sql(spark, tmp_path):
    from barstrata.plans.catalog import ORACLES, QUERIES

    # A zero in the second half of an hour makes its bar unsound; parts are longer than 400 bars.
    rng, hours, ticks = np.random.default_rng(6), 2000, 4
    n = hours * ticks
    price = {s: np.round(50 + np.cumsum(rng.normal(0, 0.1, n)) % 20, 2) for s in "ab"}
    for k in (3, 37, 700, 701, 1999):
        price["a"][k * ticks + 3] = 0.0
    at = np.datetime64("2024-01-01", "us") + (np.arange(n) * 3600 // ticks * 1_000_000).astype("timedelta64[us]")
    at = np.concatenate([at, at[: n - 8]])  # b ends two bars before a
    values, types = np.concatenate([price["a"], price["b"][: n - 8]]), ["a"] * n + ["b"] * (n - 8)
    pq.write_table(pa.table({"event_id": pa.array(range(len(at)), pa.int64()), "ts": pa.array(at), "event_type": types, "value": values}), tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    theirs = con.execute(ORACLES["trailing_stream"])
    columns = [c[0] for c in theirs.description]
    want = sorted(theirs.fetchall())
    got = sorted(tuple(r) for r in QUERIES["trailing_stream"](spark, str(tmp_path)).select(*columns).collect())
    assert len(got) == 2 * hours - 2 - 5
    assert [(r[0], r[1], *r[4:]) for r in got] == [(r[0], r[1], *r[4:]) for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[2:4] == pytest.approx(w[2:4], abs=2e-6)


def test_withdrawn_bars_come_back_and_leave_the_ring(spark, tmp_path):
    from barstrata.streaming.trailing import WINDOW, run_trailing

    schema = "symbol string, open_ts long, high double, low double, close double, volume double, version int, imported_at long"
    bar = lambda k, c, v: ("A", 3600 * k, c and c + 1, c and c - 1, c, c and 5.0 + k % 3, v, 3600 * 61 + v)
    close = {k: 100.0 + (7 * k) % 11 for k in range(60)}
    first = [bar(k, c, 0) for k, c in close.items()]
    second = [bar(k, None, 1) for k in (30, 45, 46, 59, 61)]  # the last of the series, and one that never was
    third = [bar(45, 90.0, 2), bar(35, 111.0, 2), bar(34, 1.0, 2)]  # back; the oldest still taken; one too late
    told = None
    for rows in (first, second, third):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        told = run_trailing(stream, "1H", str(tmp_path / "run"), late=25)
    got = {r.open_ts // 3600: r for r in told.collect()}
    # The ring of 25 starts at bar 35, so the 31st was too late to be withdrawn.
    values = {k: c for k, c in close.items() if k not in (46, 59)} | {45: 90.0, 35: 111.0}
    held = sorted(values)
    assert sorted(got) == held
    for n, k in enumerate(held):
        sides = [values[held[n + o]] for o in (-2, -1, 1, 2)] if 2 <= n < len(held) - 2 else None
        want = sides and ("HIGH" if values[k] > max(sides) else "LOW" if values[k] < min(sides) else None)
        assert (got[k].close, got[k].pivot) == (values[k], want)
        mean = np.mean([values[x] for x in held[n - WINDOW + 1 : n + 1]]) if n >= WINDOW - 1 else None
        assert got[k].sma == (mean if mean is None else pytest.approx(mean))
    assert got[45].revision == 3
