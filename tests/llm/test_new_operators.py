"""Role repair, hard negatives and the id store against brute force on awkward tables."""

import hashlib
import heapq
import os
import re
import zlib
from itertools import pairwise
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"


# --- role repair ---------------------------------------------------------------------


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        if kind:
            out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows, faults):
    """All edit sequences in order of (cost, labels), until one ends in the grammar."""
    heap = [(0, "", 0, "", ())]
    seen = set()
    while heap:
        cost, audit, at, roles, out = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, "\n".join(out)
        if (at, roles, audit) in seen or not re.fullmatch("s?(ua)*u?", roles):
            continue
        seen.add((at, roles, audit))
        push = lambda *x: heapq.heappush(heap, x)
        if audit[-3:] != "III":
            for role in ("user", "assistant"):
                push(cost + 5, audit + "I", at, roles + role[0], (*out, f"{role}:"))
        if at < len(rows):
            _, turn, role, text = rows[at]
            push(cost + 2, audit + "D", at + 1, roles, out)
            if faults[at] not in ("blank", "duplicate"):
                more = 5 * (faults[at] == "truncated")
                if role:
                    push(cost + more, audit + "K", at + 1, roles + role[:1], (*out, f"{role}:{text}"))
                for given in ("user", "assistant"):
                    push(cost + 1 + more, audit + "R", at + 1, roles + given[0], (*out, f"{given}:{text}"))
    raise AssertionError


def repaired(conv, rows):
    def order(r):
        return (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest())

    rows = sorted((r for r in rows if r[0] == conv), key=order)
    if not rows:
        return (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    faults, seen = [], set()
    for _, _, role, text in rows:
        inner = text.strip(SPACE)
        faults.append("blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in pairwise(rows))
    cost, audit, text = cheapest(rows, faults)
    return (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def talks(seed=5, convs=40, most=6):
    rng = np.random.default_rng(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "cut off", "", " \t", None, "Why?", "a long. answer", "é ü?"]
    rows = []
    for conv in range(convs):
        for turn in range(int(rng.integers(0, most + 1))):
            t = None if rng.random() < 0.1 else int(turn + (rng.random() < 0.2))
            rows.append((conv, t, roles[rng.integers(8)] if rng.random() < 0.6 else ("user", "assistant")[turn % 2], texts[rng.integers(len(texts))]))
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Hello."), (2**60 + 1, 2**60 + 1, "user", "x" * 100_000 + ".")]
    return rows


TALK = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("size", [1024, 2, 1])
def test_role_repair_equals_search_over_all_edits(spark, size):
    from barstrata.llm.role_repair import damaged, repair_conversations

    rows = talks()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{TALK}, audit int, kind string")
    got = repair_conversations(damaged(frame), frame, slice_rows=size).collect()
    hit = damage(rows)
    want = {conv: repaired(conv, hit) for conv in {r[0] for r in rows}}
    assert {tuple(r) for r in got} == set(want.values()) and len(got) == len(want)


def test_role_repair_over_many_tasks_and_a_hot_conversation(spark):
    from barstrata.llm.role_repair import repair_conversations

    rows = [(1, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(3000)] + [(2, 0, "user", "again.")] * 500 + [(3, 0, "user", "a.")]
    del rows[1501]  # the 1501st turn is the assistant's
    frame = spark.createDataFrame(rows, TALK).repartition(7)
    got = {r["conv_id"]: r for r in repair_conversations(frame, slice_rows=64).collect()}
    assert got[1]["gaps"] == 1 and got[1]["illegal"] == 1
    # Two users meet: one goes for 2, and so does no other turn.
    assert got[1]["cost"] == 2 and got[1]["audit"].count("D") == 1
    assert got[2]["duplicate"] == 499 and got[2]["audit"] == "D" * 500 and got[2]["cost"] == 1000
    assert (got[3]["audit"], got[3]["cost"]) == ("D", 2)


def test_role_repair_of_an_empty_table(spark):
    from barstrata.llm.role_repair import damaged, repair_conversations

    frame = spark.createDataFrame([], TALK)
    assert repair_conversations(damaged(frame), frame).collect() == []


def test_role_repair_query(spark, sf_dir):
    from barstrata.llm.queries import op11_role_repair

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hit = damage(rows)
    got = {tuple(r) for r in op11_role_repair(spark, sf_dir).collect()}
    assert got == {repaired(conv, hit) for conv in {r[0] for r in rows}}


# --- hard negatives ------------------------------------------------------------------


def mined(rows, every):
    """By all products; rows are (id, label, integers)."""
    out = []
    width = max((len(q) for *_, q in rows), default=0)
    rows = [(i, label, q + [0] * (width - len(q))) for i, label, q in rows]
    rank = lambda i: 2**63 - 1 if i is None else i
    for a, label, q in rows:
        if a is None or a % every:
            continue
        scores = sorted(((-sum(x * y for x, y in zip(q, r, strict=True)), rank(i), k) for i, k, r in rows if i != a or k != label))
        for s, i, _ in [x for x in scores if x[2] == label][:5]:
            fits = [x for x in scores if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            unrank = lambda v: None if v == 2**63 - 1 else v
            out += [(a, unrank(i), r + 1, unrank(n), -s, -t) for r, (t, n, _) in enumerate(fits)]
    return out


VECTOR = "vec_id long, embedding array<float>, label int, rank string, id int, q int"


def vectors(seed=3, n=400, dim=12, big=1.0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x * big)) for x in rng.normal(0, 0.3, dim)], int(rng.integers(4)) if i % 3 else 0) for i in range(n)]
    rows += [(n + i, rows[4][1], i % 4) for i in range(60)]  # one vector many times
    rows += [(None, rows[0][1], 1), (None, None, 2), (7001, None, 1), (7002, [], 1), (7003, [0.5, 0.25], 2), (7004, rows[1][1], None)]
    rows += [(7005, [float("nan")] * dim, 1), (7006, [float("inf")] * dim, 1), (7007, [None] * dim, 1), (8000, rows[8][1], 3), (8000, rows[8][1], 3)]
    return rows


def usable(rows):
    ok = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    return [(i, k, [int(np.floor(256 * x)) for x in v]) for i, v, k in ok]


@pytest.mark.parametrize("big", [1.0, 300.0, 1e6])
def test_hard_negatives_equal_all_products(spark, big, monkeypatch):
    from barstrata.llm import hard_negatives as module

    monkeypatch.setattr(module, "BLOCKS_PER_PASS", 2)
    n = 150 if big == 1e6 else 400
    rows = vectors(n=n, big=big)
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTOR).repartition(5)
    got = module.hard_negatives(frame, F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, got), key=str) == sorted(mined(usable(rows), 20), key=str)
    assert len(got) > 20


def test_survivors_drop_nothing_that_qualifies():
    from barstrata.llm.hard_negatives import survivors

    rng = np.random.default_rng(1)
    a, r = rng.integers(-200, 200, (7, 16)), rng.integers(-300, 300, (500, 16))
    exact = a @ r.T
    for share in (0.5, 0.9, 0.999, 1.0):
        low = np.quantile(exact, share, 1).astype(np.int64)
        high = exact.max(1) - 5
        x, y, score = survivors(a, r, low, high)
        want = {(i, j, int(exact[i, j])) for i, j in np.argwhere((exact >= low[:, None]) & (exact <= high[:, None]))}
        assert set(zip(x.tolist(), y.tolist(), score.tolist(), strict=True)) == want


def test_hard_negatives_of_an_empty_table(spark):
    from barstrata.llm.hard_negatives import hard_negatives

    assert hard_negatives(spark.createDataFrame([], VECTOR), F.col("vec_id") % 100 == 0).collect() == []


def test_hard_negatives_sql(spark, sf_dir):
    import duckdb

    from barstrata.llm.queries import ORACLES, op12_hard_negatives

    path = sf_dir.replace("sf0.001", "sf0.01")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/embeddings.parquet')")
    want = con.execute(ORACLES["op12_hard_negatives"]).fetchall()
    got = op12_hard_negatives(spark, path).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


# --- id store ------------------------------------------------------------------------


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    return path, Tokenizer.from_file(path)


DOC = "doc_id long, text string, copy int, shard string, part int"


def texts():
    rows = [(i * 3, f"Some words {i}, and {i * i} more!") for i in range(200)]
    rows += [(1, None), (2, ""), (4, "  "), (5, "é ü ~ <|endoftext|> it's"), (7, "long " * 50_000), (2**60 + 1, "far"), (None, "no id"), (None, "no id")]
    return rows + [(8, "same text")] * 40 + [(8, "other text")] * 3


@pytest.mark.parametrize("shard_bytes", [8 << 20, 200])
def test_id_store_round_trip(spark, shard_bytes):
    from barstrata.llm.id_store import write_ids

    path, plain = tokenizer()
    rows = texts()
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DOC).repartition(6)
    store = write_ids(frame, path, shard_bytes=shard_bytes, bucket_keys=16)
    got = store.starts(store.read(store.keys)).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r["copy"] for r in got if r["doc_id"] == 8] == list(range(43))
    at, left = 0, {}
    for i, t in rows:
        raw = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        left.setdefault(i, []).append(raw)
    for r in got:
        assert r["start"] == at and r["n_ids"] * 4 == len(r["ids"])
        at += r["n_ids"]
        left[r["doc_id"]].remove(bytes(r["ids"]))
    # The files hold the ids in that order and nothing else.
    root = Path(store.path.removeprefix("file:"))
    names = sorted(os.listdir(root / "ids"))
    raw = b"".join((root / "ids" / n).read_bytes() for n in names if n.endswith(".bin"))
    joined = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in got])
    assert np.array_equal(np.frombuffer(raw, "<u2"), joined) and all(n.endswith(".bin") for n in names)
    assert len(names) > (20 if shard_bytes == 200 else 0)


def test_id_store_finds_held_keys_only(spark):
    from barstrata.llm.id_store import write_ids

    frame = spark.createDataFrame([(i, f"text {i}") for i in range(0, 4000, 2)], "doc_id long, text string")
    store = write_ids(frame, tokenizer()[0], bucket_keys=100)
    wanted = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("copy"))
    found = store.find(wanted.unionByName(wanted)).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(0, 4000, 2))
    again = wanted.where("doc_id % 1000 = 0").withColumn("copy", F.lit(1).cast("long"))
    assert store.find(again).count() == 0


def test_minimal_perfect_hash_is_a_bijection():
    from barstrata.llm.id_store import build_hash, slots

    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 20000):
        h1, h2 = rng.integers(0, 2**64, (2, n), np.uint64)
        levels, table = build_hash(h1, h2)
        assert np.array_equal(np.sort(slots(levels, table, h1, h2)), np.arange(n))
        assert len(table) * 64 <= 5 * n + 64 * len(levels)
    with pytest.raises(ValueError):
        build_hash(np.zeros(2, np.uint64), np.zeros(2, np.uint64))


def test_id_store_of_an_empty_table(spark):
    from barstrata.llm.id_store import encoded_documents

    assert encoded_documents(spark.createDataFrame([], DOC), tokenizer()[0]).collect() == []


def test_id_store_query(spark, sf_dir):
    from barstrata.llm.queries import op13_id_store

    _, plain = tokenizer()
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    at, want = 0, []
    for i, t in docs:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, op13_id_store(spark, sf_dir).collect())) == want
