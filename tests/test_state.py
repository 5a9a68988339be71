"""Matching, groups, findings, k-way as-of, co-located tables, entries and the stateful stream, by definition."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_greedy_match_by_definition(spark):
    from barstrata.operators.matching import candidates, greedy_match

    rng = np.random.default_rng(7)
    wanted = [(s, w, int(rng.integers(0, 300)), float(rng.integers(90, 110)), int(rng.integers(1, 12))) for s in "AB" for w in range(60)]
    found = [(s, f, int(rng.integers(0, 300)), float(rng.integers(90, 110))) for s in "AB" for f in range(50)]
    left = spark.createDataFrame(wanted, "symbol string, w long, time long, price double, tolerance long")
    right = spark.createDataFrame(found, "symbol string, f long, time long, price double")
    want = set()
    for s in "AB":
        used = set()
        for _, w, t, p, tol in (x for x in wanted if x[0] == s):
            free = [f for z, f, ft, fp in found if z == s and f not in used and abs(ft - t) <= tol and abs(fp - p) / p <= 0.05]
            if free:
                used.add(min(free))
                want.add((s, w, min(free)))
    got = greedy_match(candidates(left, right, ["symbol"], 0.05), ["symbol"]).collect()
    assert {(r.symbol, r.w, r.f) for r in got} == want and len(got) == len(want) > 20
    assert greedy_match(candidates(left.where("w < 0"), right, ["symbol"], 0.05), ["symbol"]).count() == 0


def test_greedy_match_of_a_chain_of_rivals(spark):
    from barstrata.operators.matching import greedy_match

    pairs = spark.createDataFrame([("A", w, f) for w in range(8) for f in (max(w - 1, 0), w)], "symbol string, w long, f long")
    assert sorted((r.w, r.f) for r in greedy_match(pairs, ["symbol"]).collect()) == [(w, w) for w in range(8)]


def test_groups_are_transitive(spark):
    from barstrata.operators.factors import components

    edges = spark.createDataFrame([("d", "c"), ("c", "b"), ("b", "a"), ("x", "y")], "a string, b string")
    nodes = spark.createDataFrame([(n,) for n in "abcdxyz"], "a string")
    assert {(r.a, r.group) for r in components(edges, nodes).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x"), ("z", "z")}


def test_echoes_of_a_stronger_factor_are_redundant(spark):
    from barstrata.operators.factors import grades

    rng = np.random.default_rng(2)
    a, b, r = rng.normal(0, 1, (3, 200))
    rows = [(float(x), float(x + 0.1 * y), float(y), float(k % 25 == 0), 1.0, None, float(x + 0.5 * z)) for k, (x, y, z) in enumerate(zip(a, b, r, strict=True))]
    frame = spark.createDataFrame(rows, "pays double, echo double, other double, seldom double, same double, never double, r double")
    told = {x.factor: x for x in grades(frame, frame.columns[:-1], "r").collect()}
    assert {f: x.verdict for f, x in told.items()} == {
        "pays": "EDGE", "echo": "REDUNDANT", "other": "NOISE", "seldom": "RARE", "same": "ZERO_DISPERSION", "never": "ABSENT",
    }
    assert told["echo"].group == told["pays"].group == "echo"
    few = {x.factor: x.verdict for x in grades(frame.limit(20), ["pays"], "r").collect()}
    assert few == {"pays": "UNPROVEN"}


def test_looks_keep_first_times_close_and_reopen(spark, tmp_path):
    from barstrata.operators.findings import look

    path = str(tmp_path / "found")

    def see(at, *keys):
        seen = spark.createDataFrame(list(keys), "symbol string, what long")
        return {(r.symbol, r.what): (r.first_seen, r.last_seen, r.closed_at) for r in look(spark, path, seen, ["symbol", "what"], at, "symbol").collect()}

    def files(symbol):
        return {p.name for p in (tmp_path / "found" / f"symbol={symbol}").glob("*.parquet")}

    assert see(10, ("A", 1), ("A", 2), ("B", 1), ("C", 9), ("C", 9)) == {("A", 1): (10, 10, None), ("A", 2): (10, 10, None), ("B", 1): (10, 10, None), ("C", 9): (10, 10, None)}
    told = see(20, ("A", 1), ("C", 9))
    assert told == {("A", 1): (10, 20, None), ("A", 2): (10, 10, 20), ("B", 1): (10, 10, 20), ("C", 9): (10, 20, None)}
    quiet = files("B")
    told = see(30, ("A", 1), ("A", 2))
    assert told == {("A", 1): (10, 30, None), ("A", 2): (30, 30, None), ("B", 1): (10, 10, 20), ("C", 9): (10, 20, 30)}
    assert files("B") == quiet  # nothing open or seen there: not rewritten
    assert see(30, ("A", 7)) == told  # the same look again


def test_high_water_marks_pass_later_bars_only(spark):
    from barstrata.operators.findings import beyond, high_water

    held = spark.createDataFrame([("A", "1H", 0), ("A", "1H", 3600)], "symbol string, tf string, open_ts long")
    new = spark.createDataFrame([("A", "1H", 3600), ("A", "1H", 7200), ("B", "1H", 0)], "symbol string, tf string, open_ts long")
    assert sorted((r.symbol, r.open_ts) for r in beyond(new, high_water(held)).collect()) == [("A", 7200), ("B", 0)]


def test_many_asof_joins_take_one_shuffle(spark):
    from barstrata.operators.joins import asof_many

    rng = np.random.default_rng(9)
    series = {name: [(str(rng.choice(["A", "B"])), int(rng.integers(0, 200)), int(v)) for v in range(n)] for name, n in (("x", 80), ("y", 5), ("z", 0))}
    left = [(k, str(rng.choice(["A", "B", "C"])), int(rng.integers(0, 200))) for k in range(150)]
    facts = {name: (spark.createDataFrame(rows, "symbol string, t long, v long"), "t", ["v"]) for name, rows in series.items()}
    told = asof_many(spark.createDataFrame(left, "k int, symbol string, as_of long"), facts, ["symbol"], "as_of")
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    got = {r.k: [None if r[name] is None else (r[name]["at"], r[name].v) for name in series] for r in told.collect()}
    for k, symbol, as_of in left:
        assert got[k] == [max(((t, v) for s, t, v in rows if s == symbol and t <= as_of), default=None) for rows in series.values()]
    assert len(got) == 150


def test_colocated_tables_join_without_a_shuffle(spark):
    from barstrata.operators.lifecycle import colocated, funnel, trace

    ids = [f"s{k}" for k in range(50)]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        tables = colocated(
            {
                "plans": make([(i, "A" if k % 2 else "B") for k, i in enumerate(ids)], "setup_id string, symbol string"),
                "risk": make([(i, "REJECTED" if k % 10 == 0 else "APPROVED") for k, i in enumerate(ids[:40])], "setup_id string, decision string"),
                "orders": make([(i, ("FILLED", "MISSED", "PENDING")[k % 3]) for k, i in enumerate(ids[:30])], "setup_id string, status string"),
                "execs": make([(i, "TP", 1.5) for i in ids[:30:6]], "setup_id string, outcome string, r_multiple double"),
            },
            buckets=4,
        )
        told = trace(**tables)
        assert "Exchange" not in told._jdf.queryExecution().executedPlan().toString()
        stages = {r.setup_id: r.stage for r in told.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert len(stages) == 50
    assert [stages[f"s{k}"] for k in (0, 3, 1, 2, 30, 45)] == ["CLOSED", "OPEN", "MISSED", "PENDING", "REFUSED", "PLANNED"]
    counted = {r.symbol: r for r in funnel(told, ["symbol"]).collect()}
    assert sum(r.planned for r in counted.values()) == 50 and sum(r.closed for r in counted.values()) == 5


@pytest.mark.parametrize("cross", [True, False])
def test_entries_rest_cross_or_miss(spark, cross):
    from barstrata.operators.execution import simulate_entries

    # Bars of one price each, so that every fill is plain; the last bars leave plans undecided.
    closes = [100, 99, 98, 101, 103, 104, 104, 104]
    bars = spark.createDataFrame([("AUSDT", "1H", i, float(c), float(c), float(c), 2.0) for i, c in enumerate(closes)], "symbol string, tf string, i long, open double, high double, low double, atr double")
    plans = [
        ("rest", 1, 100.0, 90.0, 98.0, "LONG"), ("cross", 3, 101.0, 90.0, 100.0, "LONG"), ("beyond", 3, 101.0, 103.0, 102.0, "SHORT"), ("end", 6, 104.0, 90.0, 100.0, "LONG"), ("edge", 7, 104.0, 90.0, 100.0, "LONG"),
    ]
    frame = spark.createDataFrame([("AUSDT", "1H", *p) for p in plans], "symbol string, tf string, setup_id string, order_i long, entry double, sl double, maker_limit double, direction string")
    got = {r.setup_id: (r.status, r.fill_i, r.entry, r.entry_role) for r in simulate_entries(frame, bars, cross=cross).collect()}
    assert got["rest"] == ("FILLED", 2, 98.0, "MAKER")
    assert got["cross"] == (("FILLED", 5, 104.1, "TAKER") if cross else ("MISSED", None, 101.0, "MAKER"))
    assert got["beyond"][0] == ("PENDING" if cross else "MISSED")
    assert got["end"][0] == ("PENDING" if cross else "MISSED") and got["edge"][0] == "PENDING"


def test_stream_takes_late_and_revised_bars_over_a_restart(spark, tmp_path):
    from barstrata.streaming.trailing import WINDOW, run_trailing

    rng = np.random.default_rng(4)
    schema = "symbol string, open_ts long, high double, low double, close double, volume double, version int, imported_at long"
    close = np.round(100 + np.cumsum(rng.normal(0, 1, 120)), 2)
    bar = lambda s, k, c, at, v=1: (s, 3600 * k, float(c + 1), float(c - 1), float(c), 5.0 + k % 3, v, at)
    at = lambda k: 3600 * (k + 1)
    hour = [k for k in range(120) if k not in (50, 51, 90)]
    first = [bar("A", k, close[k], at(59)) for k in hour if k < 60 and k not in (20, 40)] + [bar("A", 40, 1.0, at(59), 0)] + [bar("B", k, 7.0, at(59)) for k in range(30)]
    # The 21st bar comes late, the 41st is revised, B has stopped.
    second = [bar("A", k, close[k], at(119)) for k in hour if k >= 60] + [bar("A", 20, close[20], at(119)), bar("A", 40, close[40], at(119))]
    far = [bar("A", 2, 1.0, at(120)), bar("A", 120, 100.0, at(120))]  # more than 60 bars late: not taken
    told = None
    for rows in (first, second, far):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        told = run_trailing(stream, "1H", str(tmp_path / "run"), late=110)
    got = {(r.symbol, r.open_ts // 3600): r for r in told.collect()}
    held = [*hour, 120]
    values = {k: close[k] for k in hour} | {120: 100.0}
    values[2] = 1.0  # still within 110 bars
    for n, k in enumerate(held):
        r = got["A", k]
        assert r.close == values[k]
        want = np.mean([values[x] for x in held[n - WINDOW + 1 : n + 1]]) if n >= WINDOW - 1 else None
        assert r.sma == pytest.approx(want) if want is not None else r.sma is None
        assert r.stale == (k == 49)
    assert got["B", 29].stale and got["A", 40].revision > 1 and len(got) == len(held) + 30
