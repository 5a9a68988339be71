"""What op10 writes, shuffles and leaves behind on the way to its result."""

import time
from collections import Counter
from math import isclose, log2

import numpy as np
import pyarrow as pa
import pytest

from barstrata.llm import paragraph_dedup as P
from barstrata.llm.common import BATCH_BYTES, dropped_shuffles

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _text(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}" + ("." if i % 11 == 10 else "") for i, k in enumerate(rng.integers(0, 10**6, n)))


def test_equal_paragraphs_need_no_keys_beside_their_bands():
    shared = _text(60, 1)
    texts = [_text(40, 2) + ". " + shared, shared + "\n" + _text(30, 3), "", None, "few words."]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    keys = [k for b in P._keys(P.LEAST_WORDS)(iter([batch])) for k in b.column(0).to_pylist()]
    units = [x for _, x in P.paragraphs(texts)]
    assert len(keys) == sum(len(x.text) * (1 if isinstance(x, P.Windows) else P.BANDS) for x in units)
    bands = {}
    for x in units:
        if isinstance(x, P.Paragraphs):
            for digest, row in zip(x.digest.tolist(), P._bands(x).tolist(), strict=True):
                assert bands.setdefault(digest, row) == row
    counts = Counter(d for x in units for d in x.digest.tolist())
    assert any(n > 1 for d, n in counts.items() if d in bands)


def test_texts_without_windows_have_the_same_paragraphs():
    texts = [_text(200, 4) + "\n" + _text(50, 5), None, _text(9, 6)]
    whole = [x for _, x in P.paragraphs(texts) if isinstance(x, P.Paragraphs)]
    rest = [x for _, x in P.paragraphs(texts, windows=False)]
    assert len(whole) == len(rest) > 0
    for a, b in zip(whole, rest, strict=True):
        for name in ("kind", "text", "no", "start", "length", "words", "digest", "shingles", "heads"):
            assert (getattr(a, name) == getattr(b, name)).all()


def test_prefixes_by_definition_without_lists(spark):
    rng = np.random.default_rng(7)
    sets = {d: sorted({int(t) for t in rng.integers(0, 60, 5 + d % 20)} | {1000 + d}) for d in range(1, 80)}
    sets |= {500: [9001, 9002, 9003], 501: [3]}
    rows = spark.createDataFrame(list(sets.items()), "digest long, tokens array<long>")
    frame = P._prefixes(rows, 80)
    df = Counter(t for s in sets.values() for t in s)
    want = {}
    for d, s in sets.items():
        by_df = sorted((df[t], t) for t in s if df[t] > 1)
        alone, plain = len(s) - len(by_df), len(s) - -(-len(s) * 80 // 100) + 1
        for k, (_, t) in enumerate(by_df[: max(plain - alone, 0)]):
            want[d, t] = (len(s), alone + k + 1, sum(log2(n) for n, _ in by_df) / len(s))
    got = {(r.digest, r.token): r for r in frame.collect()}
    assert got.keys() == want.keys() and len(want) > 80
    for at, (n, pos, central) in want.items():
        assert (got[at].n, got[at].pos) == (n, pos) and isclose(got[at].central, central)
    assert "collect_list" not in frame._jdf.queryExecution().optimizedPlan().toString()


def _shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = manager.getAllFiles().mkString("\n").split("\n")
    return {n for n in names if "/shuffle_" in n and n.endswith(".data")}


def test_no_shuffle_files_are_left_once_the_tables_are_written(spark):
    own = spark.newSession()
    passage = _text(60, 8)
    edited = passage.split()
    edited[30] = "changed"
    rows = [(k, _text(40, 20 + k) + ". " + (passage if k % 2 else " ".join(edited)) + " " + _text(30, 40 + k)) for k in range(8)]
    docs = own.createDataFrame([*rows, rows[0]], "doc_id long, text string")
    before, setting = _shuffle_files(own), own.conf.get(CLEANUP)
    found = P.repeated_paragraphs(docs)
    for _ in range(50):
        if not (left := _shuffle_files(own) - before):
            break
        time.sleep(0.2)
    assert not left
    # The caller's own queries are as before, and the result can be read twice.
    assert own.conf.get(CLEANUP) == setting
    # Python tasks get texts by bytes.
    assert own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(BATCH_BYTES)
    assert found.count() == len(found.collect()) > 0
    assert {r.doc_id for r in found.collect()} == set(range(8))


def test_the_setting_comes_back_after_an_error(spark):
    own = spark.newSession()
    setting = own.conf.get(CLEANUP)
    with pytest.raises(ValueError), dropped_shuffles(own):
        assert own.conf.get(CLEANUP) == "true"
        raise ValueError
    assert own.conf.get(CLEANUP) == setting
