"""The training-data operators against brute force on small, awkward tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string, a string, k int, id string, rank double, media binary"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def words(n, seed, size=4000):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, size, n)]


def awkward():
    """Nulls, empties, ties, repeats, a very long text, near and exact copies."""
    base = words(120, 1)
    near = base[:60] + ["edit"] + base[61:]
    far = base[:60] + words(60, 2)
    texts = [
        None,
        "",
        "   \t\n",
        "one two",
        "ONE two",
        " ".join(base),
        " ".join(base).upper(),
        " ".join(near),
        " ".join(far),
        " ".join(words(20000, 3)),
        "a\nb\n\nshared line of six words here\nanother shared line of words\nc",
        "shared line of six words here\nanother shared line of words\nown tail",
        "é ü \u00a0 ß\u2028x <|endoftext|> ~ it's 42!",
    ]
    rows = [(i, t, "s" if i % 3 else None) for i, t in enumerate(texts)]
    return rows + [(None, "null id text here", "s")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, "y", 0.5, b"z") for i, t, s in rows], SCHEMA)


def normal(text):
    return (text or "").translate(LOWER)


def shingles(text, width=4):
    w = WORD.findall(normal(text))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def components(sets, percent):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * len(sets[x] | sets[y]):
                    a, b = find(x), find(y)
                    parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def many_near_copies():
    """Groups of edited copies around the threshold, and a passage that all share."""
    rng = np.random.default_rng(7)
    passage, rows = words(30, 99), []
    for group in range(6):
        base = words(100, 100 + group)
        for _ in range(25):
            copy = list(base)
            for at in rng.integers(0, 100, rng.integers(0, 5)):
                copy[at] = f"e{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(copy + passage), "s"))
    return rows


@pytest.mark.parametrize("rows", [awkward()[:-1], many_near_copies()], ids=["awkward", "near"])
def test_ngram_join_equals_all_pairs(spark, rows):
    from barstrata.llm.ngram_join import ngram_jaccard_components

    sets = {i: shingles(t) for i, t, _ in rows}
    want = components(sets, 85)
    got = ngram_jaccard_components(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}


def test_ngram_join_keeps_one_of_a_group(spark):
    from barstrata.llm.ngram_join import keep_one_per_component, ngram_jaccard_components

    rows = awkward()
    kept = keep_one_per_component(frame(spark, rows + rows[5:6]))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    want = components({i: shingles(t) for i, t, _ in rows if i is not None}, 85)
    assert Counter(r.doc_id for r in kept.collect()) == Counter([i for i in want if want[i] == i] + [None])
    assert ngram_jaccard_components(frame(spark, [])).count() == 0


def test_pipeline_compares_five_words_at_80_percent(spark):
    import corpus_pipeline

    base = words(140, 31, 10**6)
    edited = [f"e{i}" if i in (30, 70, 110) else w for i, w in enumerate(base)]
    assert 0.80 <= len(shingles(" ".join(base), 5) & shingles(" ".join(edited), 5)) / len(shingles(" ".join(base), 5) | shingles(" ".join(edited), 5)) < 0.82
    rows = [(1, " ".join(base), "s"), (2, " ".join(edited), "s"), (3, " ".join(words(140, 32, 10**6)), "s")]
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, frame(spark, rows), "").collect()} == {1, 3}


def test_components_of_chains_and_stars(spark):
    from barstrata.llm.components import connected_components

    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (3, 2)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing_meets_targets_and_its_sql(spark, tmp_path):
    from barstrata.llm.mixing import SQL, poisson_mix

    rows = [(i, "x" * 50, f"s{min(i % 7, 3)}") for i in range(4000)]
    rows += [(5000 + k, t, s) for k, (_, t, s) in enumerate(awkward())] + [(None, "no id", "s")]
    docs = frame(spark, rows)
    columns = ["doc_id", "source", "copy_no", "mix_key"]
    got = poisson_mix(docs).select(*columns).collect()
    docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}).to_parquet(tmp_path / "d.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet'")
    assert Counter(map(tuple, got)) == Counter(db.sql(f"SELECT {', '.join(columns)} FROM ({SQL})").fetchall())
    weights = {"s0": 3.0, "s3": 1.0}
    mixed = poisson_mix(frame(spark, rows[:4000]), weights=weights, budget=2.0)
    chars = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert set(chars) == {"s0", "s3"}
    assert chars["s0"] == pytest.approx(0.75 * 2 * 200_000, rel=0.05)
    assert poisson_mix(frame(spark, [])).count() == 0


def test_poisson_counts_have_the_right_moments(spark):
    from barstrata.llm.mixing import poisson_mix

    rows = [(i, "ab", "s") for i in range(3000)]
    counts = poisson_mix(frame(spark, rows), budget=40.0).groupBy("doc_id").count().toPandas()["count"]
    assert counts.mean() == pytest.approx(40, rel=0.02)
    assert counts.var() == pytest.approx(40, rel=0.12)


def test_toxicity_learns_and_ignores_identity_terms(spark):
    from barstrata.llm.toxicity import score_toxicity

    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        text = " ".join(words(60, i, 800))
        if toxic:
            text += " women are " + " ".join(rng.choice(["vile", "rotten", "filth"], 2))
        rows.append((i, text, "s"))
        labels.append((i, int(toxic)))
    rows += [(10_000, "women met on sunday", "s"), (10_001, "men met on sunday", "s"), (10_002, None, "s"), (10_003, "", "s"), (None, "vile", "s")]
    told = {r.doc_id: r for r in score_toxicity(frame(spark, rows), spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, toxic int")).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in range(600) if told[i].held_out} == set(held)
    assert np.mean([told[i].predicted == int(i % 4 == 0) for i in held]) > 0.95
    assert abs(told[10_000].score - told[10_001].score) < 0.1 and told[10_000].predicted == 0
    assert told[10_002].score == told[10_003].score
    none = score_toxicity(frame(spark, rows[:2]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in none.collect()] == [0.5, 0.5]
    assert score_toxicity(frame(spark, []), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def tiny_objective(fairness):
    from barstrata.llm.toxicity import Objective, counterfactual, word_features

    texts = ["you vile rotten women", "a calm day", "vile men rotten", "the women met", "rotten vile jewish fool", "a book of rain", None, "vile rotten"]
    labels = np.array([1, 0, 1, 0, 1, 0, 0, 1], float)
    pairs = [counterfactual(t or "", 7 * k) for k, t in enumerate(texts)]
    ours, twins = (list(word_features([p[side] for p in pairs])) for side in (0, 1))
    lost = [np.setdiff1d(a, b) for a, b in zip(ours, twins)]
    gained = [np.setdiff1d(b, a) for a, b in zip(ours, twins)]
    weights = np.arange(1.0, 9.0)
    return Objective(ours, lost, gained, labels, weights, fairness, 0.01), ours, twins, labels, weights


def test_toxicity_loss_and_gradient_by_brute_force():
    goal, ours, twins, labels, weights = tiny_objective(0.7)
    rng = np.random.default_rng(2)
    w, bias = rng.normal(0, 1, len(goal.used)), 0.3
    value = {int(f): w[k] * goal.values[k] for k, f in enumerate(goal.used)}

    def logit(ids):
        return bias + sum(value.get(int(i), 0.0) for i in ids)

    want = 0.01 / 2 * sum(w * w)
    for a, b, y, s in zip(ours, twins, labels, weights):
        p = 1 / (1 + np.exp(-logit(a)))
        want += s / weights.sum() * (-y * np.log(p) - (1 - y) * np.log(1 - p) + 0.7 * (logit(a) - logit(b)) ** 2)
    loss, g, gb = goal(w, bias)
    assert loss == pytest.approx(want)
    for k in rng.choice(len(w), 12, replace=False):
        step = np.zeros(len(w))
        step[k] = 1e-6
        assert g[k] == pytest.approx((goal(w + step, bias)[0] - goal(w - step, bias)[0]) / 2e-6, abs=1e-6)
    assert gb == pytest.approx((goal(w, bias + 1e-6)[0] - goal(w, bias - 1e-6)[0]) / 2e-6, abs=1e-6)


def test_toxicity_penalty_decides_on_identity_terms(spark, sf_dir):
    """On the given tables, whose texts name no group, and where a term goes with toxic labels."""
    from barstrata.llm.toxicity import FAIRNESS, identity_features, score_toxicity, train, word_features

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    terms = identity_features()
    free, held = (train(docs, labels, fairness=f)[0] for f in (0.0, FAIRNESS))
    assert np.abs(free[terms]).max() > 0.05 and np.abs(free - held).max() > 0.05
    assert np.std(held[terms]) < 0.5 * np.std(free[terms])

    rows, told = [], []
    for i in range(600):
        toxic = i % 4 == 0
        rows.append((i, " ".join(words(40, i, 800)) + (" those women are vile rotten filth" if toxic else " a quiet town"), "s"))
        told.append((i, int(toxic)))
    rows.append((9999, "The women met on sunday.", "s"))
    marks = spark.createDataFrame(told, "doc_id long, toxic int")
    women = next(word_features(["women"]))
    weight = {f: train(frame(spark, rows), marks, fairness=f)[0][women].sum() for f in (0.0, FAIRNESS)}
    assert weight[0.0] > 1.0 and abs(weight[FAIRNESS]) < 0.1 * weight[0.0]
    score = {f: score_toxicity(frame(spark, rows), marks, fairness=f).where("doc_id = 9999").first() for f in (0.0, FAIRNESS)}
    assert score[FAIRNESS]["score"] < score[0.0]["score"] and score[FAIRNESS]["predicted"] == 0


def test_toxicity_scores_are_sums_of_weights(spark):
    from barstrata.llm.toxicity import drop_toxic, score_toxicity, train, word_features

    rows = [(i, f"word{i} " + ("scum filth" if i % 3 == 0 else "calm rain"), "s") for i in range(90)]
    rows += [(5, "another text of id five scum", "s"), *awkward(), (700, "scum " * 30000, "s")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    docs = frame(spark, rows).withColumns({"score": F.lit("own"), "predicted": F.lit(7), "held_out": F.lit("x"), "ids": F.lit(1)})
    w, bias = train(docs, labels)
    assert all((a == b).all() if hasattr(a, "all") else a == b for a, b in zip(train(docs.repartition(5), labels), (w, bias)))
    got = score_toxicity(docs, labels).collect()
    want = [1 / (1 + np.exp(-(bias + sum(float(w[i]) for i in next(word_features([r.text]), []))))) for r in got]
    assert [r.score for r in got] == pytest.approx(want, abs=1e-6)
    assert all(r.predicted == int(r.score >= 0.3) and r.ids == 1 for r in got)
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} == {"own"}
    assert kept.count() == sum(r.predicted == 0 for r in got)


@pytest.fixture(scope="session")
def tokenizer():
    tokens = pytest.importorskip("public_tokenizers")
    return str(tokens.path("word_bpe_49k.json"))


def check_pieces(pieces, rows, tokenizer, size, pad):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    ids = {i: t.encode(text or "", add_special_tokens=False).ids + [1] for i, text, _ in rows}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(ids)
    for doc, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            raw = np.array(ids[doc][at : at + p.length], "<u4").tobytes()
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids[doc]), zlib.crc32(raw))
            at += p.length
        assert at == len(ids[doc])
    lacks = []
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        lacks.append(size - at)
    assert min(lacks) >= 0 and sorted(lacks)[:-1] == [x for x in sorted(lacks)[:-1] if x <= pad]


@pytest.mark.parametrize("parts", [1, 7])
def test_packing_is_an_exact_round_trip(spark, tokenizer, parts):
    from barstrata.llm.packing import pack

    rows = awkward() + [(100 + i, " ".join(words(30 + 17 * (i % 40), i)), "s") for i in range(120)]
    got = pack(frame(spark, rows).repartition(parts), tokenizer, size=256, open_windows=8).collect()
    check_pieces(got, rows, tokenizer, 256, 16)
    assert pack(frame(spark, []), tokenizer).count() == 0


def test_word_encoder_equals_whole_texts(tokenizer):
    from tokenizers import Tokenizer

    from barstrata.llm.packing import WordEncoder

    texts = [t or "" for _, t, _ in awkward()] + ["a\x1cb \x85 c", "tilde ~~ ~x~", "ΑΣ Σ ΟΔΟΣ", "e\u0301 \u0301x", "don't 'll", "<|startoftext|>a"]
    whole = Tokenizer.from_file(tokenizer)
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, np.uint32).tobytes() for t in texts]
    assert WordEncoder(tokenizer)(texts) == want


def exact_groups(rows):
    keep, size = {}, Counter()
    for i, t, _ in rows:
        size[normal(t)] += 1
        keep[normal(t)] = max(keep.get(normal(t), i), i)
    return {i: (keep[normal(t)], size[normal(t)], keep[normal(t)] == i, hashlib.sha256(normal(t).encode()).hexdigest()) for i, t, _ in rows}


@pytest.mark.parametrize("weak", [False, True])
def test_stream_dedup(spark, tmp_path, weak):
    from barstrata.llm.stream_dedup import sha256_hex, stream_dedup

    rows = awkward()[:-1] + [(50, "One Two", "s"), (51, "İ", "s"), (52, "i̇", "s")]
    frame(spark, rows).repartition(3).write.parquet(str(tmp_path / "t.parquet"))
    digest = (lambda x: F.substring(sha256_hex(x), 1, 1)) if weak else sha256_hex
    got = stream_dedup(spark, str(tmp_path / "t.parquet"), digest=digest).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == exact_groups(rows) and len(got) == len(rows)


def test_stream_dedup_goes_on_from_its_state(spark, tmp_path):
    from barstrata.llm.stream_dedup import stream_dedup

    path, state = str(tmp_path / "t.parquet"), str(tmp_path / "state")
    first, second = [(1, "a b", "s"), (2, "c", "s")], [(3, "A B", "s"), (4, None, "s"), (4, "", "s")]
    frame(spark, first).write.parquet(path)
    stream_dedup(spark, path, state)
    frame(spark, second).write.mode("append").parquet(path)
    got = stream_dedup(spark, path, state).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 2)}
    assert sorted(r.kept for r in got if r.doc_id == 4) == [False, True]
    frame(spark, []).write.parquet(str(tmp_path / "e.parquet"))
    assert stream_dedup(spark, str(tmp_path / "e.parquet")).count() == 0


def test_line_dedup_equals_its_sql(spark, tmp_path):
    from barstrata.llm.line_dedup import SQL, line_dedup

    rng = np.random.default_rng(11)
    pool = [" ".join(words(n, n)) for n in (1, 2, 3, 5, 6, 8)] + [""]
    rows = awkward()[:-1] + [(100 + i, "\n".join(rng.choice(pool, rng.integers(1, 12))), "s") for i in range(60)]
    # Copies that part after 1, 2, ... lines, a line many times over, and nested runs.
    run = [f"l{i} of a run" for i in range(40)]
    rows += [(200 + i, "\n".join(run[i % 7 : 3 + 2 * i] + [f"end {i}"]), "s") for i in range(18)]
    rows += [(300, "\n".join(["again"] * 23), "s"), (301, "\n".join(["again"] * 9 + run[3:11] + ["again"] * 4), "s")]
    docs = frame(spark, rows)
    docs.select("doc_id", "text").toPandas().to_parquet(tmp_path / "d.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet'")
    want = {r[0]: r[1:] for r in db.sql(f"SELECT doc_id, n_lines, n_removed, longest_run, runs, text FROM ({SQL})").fetchall()}
    got = line_dedup(docs)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.longest_run, r.runs, r.text) for r in got.collect()} == want
    assert got.columns[: len(docs.columns)] == docs.columns


def test_line_dedup_finds_long_runs(spark):
    from barstrata.llm.line_dedup import line_dedup

    run = [f"line {i} of the long run here" for i in range(21)]
    rows = [(1, "\n".join(["own first line of words x", *run]), "s"), (2, "\n".join([*run, "own last line of words y"]), "s"), (2, None, "s"), (None, "\n".join(run[:3]), "s")]
    got = {(r.doc_id, r.text is None): r for r in line_dedup(frame(spark, rows)).collect()}
    assert got[2, False].n_removed == 21 and got[2, False].longest_run == 21 and got[2, False].runs == "0+21<1:1" and got[2, False].text == "own last line of words y"
    assert got[1, False].n_removed == 3  # the null id comes first
    assert got[None, False].n_removed == 0 and got[2, True].text is None
    assert line_dedup(frame(spark, [])).count() == 0


def test_media_round_trip(spark):
    from barstrata.llm.media import media_columns, payload_of

    shared = " ".join(words(3000, 21))
    rows = awkward() + [(60, shared + " tail one", "s"), (61, "head " + shared, "s"), (62, shared + " tail one", "s"), (60, "other text of the id", "s"), (61, "head " + shared, "s")]
    got = media_columns(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t, _ in rows:
        p, n = payload_of(t)
        assert len(p) % 576 == 0 and len(p) > 0
        want[i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    by_hash = defaultdict(set)
    for r in got:
        by_hash[r.payload_sha256].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_hash.values())
    assert media_columns(frame(spark, [])).count() == 0


def test_media_store_keeps_shared_chunks_once(spark, monkeypatch):
    from barstrata.llm.media import cut_points, encode_media, payload_of, read_media, store_media
    from barstrata.llm.sketch import key_bitmap

    shared = " ".join(words(6000, 22))
    rows = [(i, f"{i} " * 300 + shared, "s") for i in range(5)]
    media = [encode_media(payload_of(t)[0]) for _, t, _ in rows]
    for m in media:
        ends = cut_points(m)
        assert ends[-1] == len(m) and ends == sorted(set(ends))
    for bits in (27, 6):  # a full bitmap sends every chunk to the table
        monkeypatch.setattr("barstrata.llm.media.key_bitmap", lambda keys, bits=bits: key_bitmap(keys, bits))
        _, items, chunks = store_media(frame(spark, rows + rows[:2]))
        held = sum(len(zlib.decompress(r.blob)) for r in items.collect()) + sum(len(zlib.decompress(r.bytes)) for r in chunks.collect())
        assert held < 0.45 * sum(map(len, media))
        assert sorted(r.media_sha256 for r in read_media(items, chunks).collect()) == sorted(hashlib.sha256(m).hexdigest() for m in media)


def test_media_features_by_plain_definition():
    from barstrata.llm.media import features_of

    data = payload = "A plain text, é, of some words.".encode() * 20
    mean = sum(data) / len(data)
    std = (sum((x - mean) ** 2 for x in data) / len(data)) ** 0.5
    cross = sum((a >= 128) != (b >= 128) for a, b in zip(data, data[1:]))
    entropy = -sum(n / len(data) * np.log2(n / len(data)) for n in Counter(data).values())
    got = dict(x.split("=") for x in features_of(payload).split(";"))
    assert [float(got[k]) for k in ("mean", "std", "cross", "entropy")] == pytest.approx([mean, std, cross, entropy], abs=1e-4)


def test_url_filter_equals_brute_force(spark):
    from barstrata.llm.url_filter import RULES, THRESHOLD, features, filter_urls, model, score, split_url

    urls = [
        None, "", "no scheme", "http://A.Example.ORG/en/1x?q#f", "https://example.org/es/1", "http://x.com/fr/9", "http://com/de/1", "http://xcom/de/1",
        "http://example.org", "http://b.org/", "http://casino-win.example.net/en/1", "http://m.garden.example.net/fr/3.html", "a://b://c/d", "http://h?x/y", "://", "http://x.com/de",
        "http://h" + "a" * 100_000 + ".net/p", "http://h" + "a" * 100_000 + ".net/p",
    ]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)] + [(None, urls[3], "h", "p")], "page_id long, url string, host string, score string")
    got = {r.page_id: r for r in filter_urls(pages).collect()}
    fitted = model()
    for i, u in enumerate(urls):
        host, path = split_url(u or "")
        fits = [(len(t), t, k) for k, t in RULES if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith(t[len(t.split("/")[0]) :])]
        rule = max(fits)[1:] if fits else (None, "block" if score(host, path, fitted) >= THRESHOLD else "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *rule), u
    assert got[16].host == "h" + "a" * 100_000 + ".net" and [got[16], got[17]] == [got[16], got[16].__class__(*[17, *got[16][1:]])]
    assert got[None].rule == "example.org/en/1" and got[10].verdict == "block" and got[11].verdict == "allow"
    assert len(features("", "")) == 0 or features("", "").dtype == np.int64
    assert filter_urls(pages.where("false")).count() == 0


def test_url_model_on_unseen_hosts(monkeypatch):
    """Folds of the labelled table: a host is judged by a model that has not seen it."""
    from barstrata.llm import url_filter as U

    known = {U.split_url(u)[0] for u in U.UNWANTED_URLS + U.WANTED_URLS}
    assert not [h for h in known if re.search("casino-win|cheap-pills|ads-track|spam-farm|free-bets|adult-x|example", h)]
    bad, good, found = list(U.UNWANTED_URLS), list(U.WANTED_URLS), Counter()
    for fold in range(5):
        monkeypatch.setattr(U, "UNWANTED_URLS", [u for k, u in enumerate(bad) if k % 5 != fold])
        monkeypatch.setattr(U, "WANTED_URLS", [u for k, u in enumerate(good) if k % 5 != fold])
        U.model.cache_clear()
        fitted = U.model()
        for label, urls in ((1, bad), (0, good)):
            for k, url in enumerate(urls):
                if k % 5 == fold:
                    for v in U._variants(url, k)[1:]:
                        found[label, U.score(*U.split_url(v), fitted) >= U.THRESHOLD] += 1
    U.model.cache_clear()
    assert found[1, True] > 0.5 * (found[1, True] + found[1, False])
    assert found[0, True] < 0.01 * (found[0, True] + found[0, False])


def test_quality_sample_prefers_the_target(spark):
    from barstrata.llm.quality import importance_sample, quality_sample

    good = [(i, " ".join(words(40, i, 300)), "s") for i in range(300)]
    junk = [(1000 + i, " ".join(f"$$${x}" for x in words(40, 5000 + i, 300)), "s") for i in range(100)]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 300, 3)] + [(1000 + i, 0) for i in range(0, 100, 3)] + [(None, 1), (5, None)], "doc_id long, quality int")
    docs = frame(spark, good + junk)
    got = {r.doc_id for r in quality_sample(docs, labels).collect()}
    assert len(got) == round(400 * 100 / 134) and len(got - set(range(300))) < 10
    again = {r.doc_id for r in importance_sample(docs.repartition(3), labels.where("quality > 0").select("doc_id"), k=len(got)).collect()}
    assert again == got
    rows = awkward()
    assert importance_sample(frame(spark, rows), labels.select("doc_id"), k=len(rows)).count() == len(rows)
    assert quality_sample(frame(spark, []), labels).count() == 0
    assert quality_sample(docs, labels.where("false")).count() == 0


def test_quality_counts_every_target_text(spark):
    from barstrata.llm.quality import BUCKETS, importance_sample, ngram_buckets

    docs = spark.range(25_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id")).alias("text"))
    got = {r.doc_id: r.log_weight for r in importance_sample(docs, docs.where("doc_id < 24000").select("doc_id"), k=25_000).collect()}
    found = [int(ids[0]) for ids in ngram_buckets([f"w{i}" for i in range(25_000)])]
    raw, target = (np.bincount(found[:n], minlength=BUCKETS) + 1.0 for n in (25_000, 24_000))
    ratios = np.log(target / target.sum()) - np.log(raw / raw.sum())
    assert [got[i] for i in range(25_000)] == pytest.approx(ratios[found].tolist())


def test_quality_model_does_not_depend_on_the_bitmap(spark):
    from barstrata.llm.quality import log_ratios

    docs = spark.createDataFrame([(i if i % 7 else None, f"w{i % 5} x{i} y") for i in range(300)], "id long, text string")
    target = spark.range(0, 300, 3).select(F.col("id").alias("__target"))
    assert (log_ratios(docs, target) == log_ratios(docs, target, bits=6)).all()


def test_kth_largest_with_ties(spark):
    from barstrata.llm import quality

    rng = np.random.default_rng(3)
    rows = [(float(k), i) for i, k in enumerate(rng.integers(0, 50, 6000))] + [(float("1e300"), 9001), (-1e300, 9002)]
    keys = spark.createDataFrame(rows, "key double, id long")
    order = sorted(rows, key=lambda r: (-r[0], r[1]))
    for k in (1, 2, 777, 5999, 6002):
        assert quality.kth_largest(keys, k) == order[k - 1]


def test_repeated_passages(spark):
    from barstrata.llm.paragraph_dedup import repeated_paragraphs

    def prose(n, seed):
        w = words(n, seed, 10**6)
        return " ".join(x + ("." if i % 11 == 10 else "") for i, x in enumerate(w))

    passage = prose(66, 500)
    edited = passage.split()
    edited[30] = "changed"
    rows = [(i, prose(80, i) + ". " + (passage if i % 5 == 0 else "") + " " + prose(40, 1000 + i), "s") for i in range(40)]
    rows += [(90, prose(50, 90) + ". " + " ".join(edited) + " " + prose(30, 91), "s"), (91, None, "s"), (92, "", "s"), (None, passage, "s")]
    got = repeated_paragraphs(frame(spark, rows)).collect()
    assert {r.doc_id for r in got} == {i for i in range(0, 40, 5)} | {90, None}
    assert all(not r.removed for r in got if r.doc_id is None and r.first_doc_id is None)
    text = {i: (t or "").encode() for i, t, _ in rows}
    for r in got:
        if r.doc_id is not None and r.doc_id != 90:
            part = text[r.doc_id][r.start : r.start + r.length].decode()
            assert len(set(part.split()) & set(passage.split())) >= 0.5 * len(part.split())
    assert repeated_paragraphs(frame(spark, [])).count() == 0


def plain(n, seed):
    return words(n, seed, 10**6)


def found_docs(spark, rows):
    from barstrata.llm.paragraph_dedup import repeated_paragraphs

    return {r.doc_id for r in repeated_paragraphs(frame(spark, rows)).collect()}


def test_repeated_line_of_short_sentences_with_an_edit(spark):
    line = [w + ("." if i % 10 == 9 else "") for i, w in enumerate(plain(50, 700))]
    edited = line[:25] + ["changed"] + line[26:]
    rows = [(k, "\n".join([" ".join(plain(20, 710 + k)), " ".join(x), " ".join(plain(20, 720 + k))]), "s") for k, x in enumerate((line, edited, plain(50, 701)))]
    assert found_docs(spark, rows) == {0, 1}


def test_passages_inside_sentences_and_without_punctuation(spark):
    passages = [plain(51, 800 + k) for k in range(20)]
    rows = []
    for k, passage in enumerate(passages):
        for copy in range(2):
            rows.append((2 * k + copy, " ".join(plain(13 + 3 * k + 40 * copy, 900 + 2 * k + copy) + passage + plain(30 + k, 1000 + 2 * k + copy)), "s"))
    rows.append((99, " ".join(plain(300, 1100)), "s"))
    assert found_docs(spark, rows) == set(range(40))


def test_passages_inside_sentences_with_an_edit(spark):
    rows = []
    for k in range(20):
        passage = plain(75, 1200 + k)
        edited = passage[:37] + ["changed"] + passage[38:]
        rows += [(2 * k + copy, " ".join(plain(40 + k, 1300 + 2 * k + copy) + x + plain(35, 1400 + 2 * k + copy)), "s") for copy, x in enumerate((passage, edited))]
    assert found_docs(spark, rows) == set(range(40))


def test_repeated_rows_are_one_document(spark):
    from barstrata.llm.paragraph_dedup import repeated_paragraphs

    text = " ".join(plain(60, 1500))
    rows = [(1, text, "s"), (1, text, "s"), (2, " ".join(plain(60, 1501)), "s"), (2, " ".join(plain(60, 1501)), "s")]
    assert repeated_paragraphs(frame(spark, rows)).count() == 0
    got = repeated_paragraphs(frame(spark, [*rows, (3, text, "s")])).collect()
    assert {(r.doc_id, r.copies, r.removed) for r in got} == {(1, 2, False), (3, 2, True)}
    assert len({(r.doc_id, r.paragraph) for r in got}) == len(got)
    # Equal windows that overlap are no copies of each other.
    assert repeated_paragraphs(frame(spark, [(4, "same " * 40, "s")])).count() == 0


def test_repeated_paragraphs_equal_all_pairs(spark):
    """Groups, removals and copies of awkward rows against all pairs of paragraphs and of windows."""
    from barstrata.llm import paragraph_dedup as P

    rng = np.random.default_rng(23)
    rows = [r for r in awkward() if r[0] is not None] + many_near_copies()[:60]
    rows = [(i, t, s) for i, (_, t, s) in enumerate(rows)]
    rows += [(500 + k, t, "s") for k, t in enumerate(["very long " + " ".join(plain(30_000, 7)), "tie " * 3, "few words."])]
    for k in range(24):
        line = plain(60, 4000 + k % 4)
        for at in rng.integers(0, 60, k % 3):
            line[at] = f"x{k}{at}"
        rows.append((600 + k, " ".join(plain(12, 5000 + k)) + ".\n" + " ".join(line) + "\nend of it.", "s"))
    units, sets = [], {}
    for i, text, _ in rows:
        for _, x in P.paragraphs([text]):
            for k in range(len(x.text)):
                kind = P.WORDS if isinstance(x, P.Windows) else int(x.kind[k])
                units.append((kind, i, int(x.no[k]), int(x.digest[k])))
                if kind != P.WORDS:
                    end = x.heads[k + 1] if k + 1 < len(x.heads) else len(x.shingles)
                    sets[int(x.digest[k])] = set(x.shingles[x.heads[k] : end].tolist())
    digests = sorted(sets)
    at = {d: n for n, d in enumerate(digests)}
    named = components({n: sets[d] for d, n in at.items()}, P.PERCENT)
    group = {d: named[at[d]] for d in digests}
    members = defaultdict(list)
    for kind, i, no, digest in units:
        members[("w", digest) if kind == P.WORDS else group[digest]].append((i, no))
    want = {m: (min(g), len(g)) for g in members.values() if len(g) > 1 for m in g}
    got = {(r.doc_id, r.paragraph): ((r.first_doc_id, r.first_paragraph), r.copies) for r in P.repeated_paragraphs(frame(spark, rows), run_words=0).collect()}
    assert len(want) > 100 and got.keys() <= want.keys()
    # MinHash may miss a pair; what it finds is exact.
    same = sum(got.get(m) == v for m, v in want.items())
    assert same >= 0.97 * len(want)


def test_minhash_pairs_are_mostly_found(spark):
    from barstrata.llm.paragraph_dedup import repeated_paragraphs

    rng, rows = np.random.default_rng(17), []
    for i in range(60):
        w = words(60, 3000 + i, 10**6)
        e = list(w)
        e[int(rng.integers(5, 55))] = "edit"
        rows += [(2 * i, " ".join(w), "s"), (2 * i + 1, " ".join(e), "s")]
    found = {r.doc_id for r in repeated_paragraphs(frame(spark, rows)).collect()}
    assert len(found) >= 0.95 * len(rows)


def test_kernels_hash_words_exactly():
    from barstrata.llm.kernels import shingle_sets, slices, word_hashes

    texts = ["Ab ab\tAB  x" + "y" * 700, "", None, "x" + "y" * 700 + " zz", "é É"]
    seen = {}
    for first, _, joined, offsets in slices(texts):
        hashes, bounds, starts, ends = word_hashes(joined, offsets)
        for k in range(len(offsets) - 1):
            own = WORD.findall(normal(texts[first + k]))
            assert len(own) == bounds[k + 1] - bounds[k]
            for w, h in zip(own, hashes[bounds[k] : bounds[k + 1]], strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert [len(s) for s in shingle_sets(texts, 4)] == [1, 0, 0, 1, 1]


def test_pipeline_stages_run_and_keep_columns(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "poisson_mix", "packing"]
    from barstrata.llm.common import materialize

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0.6 * counts[0]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).agg(F.countDistinct("doc_id")).first()[0] == docs.select("doc_id").distinct().count()


def test_pipeline_stages_on_awkward_tables(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, ties, an empty table and clashing names."""
    import corpus_pipeline

    labels = [(100 + i, int(i % 3 == 0)) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = awkward() + [(100 + i, f"topic{i} " + ("scum filth" if i % 3 == 0 else "calm rain") + f" number{i}", "s") for i in range(60)]
    rows += [rows[5], (5, "other text of a repeated id", "t"), (None, "second null id", None)]
    names = ["score", "predicted", "held_out", "n_lines", "n_removed", "runs", "copy_no", "mix_key", "rate", "parts", "cdf", "id", "first", "component_id"]
    docs = frame(spark, rows).select("doc_id", "text", "source", F.length("text").alias("n_chars"), *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    kept, want = docs, Counter((i, t) for i, t, _ in rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = Counter(tuple(r) for r in kept.select("doc_id", "text").collect())
        kept = stage(spark, kept, str(tmp_path))
        assert kept.schema.names == docs.schema.names, name
        found = kept.collect()
        assert found and all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for r in found for n in names), name
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in found)
        after = Counter((r.doc_id, r.text) for r in found)
        if name == "toxicity":
            assert {i for i, _ in before - after if i and i >= 100} <= {100 + i for i in range(0, 60, 3)} and not after - before
        if name == "ngram_jaccard":
            assert not after - before and after[None, "second null id"] == 1 and all(n == 1 for (i, _), n in after.items() if i is not None)
        if name != "poisson_mix":
            assert {0, 1} <= {r.doc_id for r in found}
        kept = spark.createDataFrame(found, docs.schema)
    packed = corpus_pipeline.packing(spark, kept, "").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept.collect()} and want
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name


def test_mixing_broadcast_and_shuffled_alike(spark):
    from barstrata.llm.mixing import poisson_mix

    rows = [(i, "x" * (i % 9), f"s{i % 5}") for i in range(500)] + awkward()
    docs = frame(spark, rows).withColumns({c: F.lit(7) for c in ("rate", "parts", "cdf", "size")})
    before, got = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), []
    for threshold in (before, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        out = poisson_mix(docs)
        assert out.columns == [*docs.columns, "copy_no", "mix_key"]
        got.append(Counter((r.doc_id, r.copy_no, r.rate) for r in out.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got[0] == got[1] and got[0]


def test_bitmap_holds_its_keys(spark):
    from barstrata.llm.sketch import hits, key_bitmap

    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 500)
    table = key_bitmap(spark.createDataFrame([(int(k),) for k in keys], "key long"), 16)
    other = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 20_000)
    assert hits(table, keys).all() and hits(table, other).mean() < 0.02
    slots = {int(k) & 0xFFFF for k in keys}
    assert hits(table, other).tolist() == [(int(k) & 0xFFFF) in slots for k in other]
    assert not hits(key_bitmap(spark.createDataFrame([], "key long"), 16), other).any()
