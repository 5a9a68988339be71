"""Substring dedup: paragraph MinHash banding, exact verification, components.

Texts are cut at line ends and sentence ends into short paragraphs, so that a passage
inside a longer text falls into paragraphs of its own. Equal paragraphs are one
class. Classes that share the MinHash of a band collide; a pair that reaches the
threshold also shares one of its rarest shingles, so colliding classes are grouped by
band and rare shingle. Each group is compared with its most central member, then
those outside that leader's component with the rest of the group; a pair links if
the exact Jaccard similarity of the word shingles reaches the threshold. Of each
component the first paragraph in (id, number) order stays. Only passages count: runs
of neighbouring repeated paragraphs with enough words together, so that a stock
sentence in an otherwise clean text is left alone.

Two more kinds of units are passages in themselves. Whole lines are banded and
verified like paragraphs, so that one edit does not lose a line of short sentences.
Word windows start at anchors that the words alone choose, wherever sentences and
lines end; equal windows are one class. Units of different kinds are never compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, dropped_shuffles, materialize, release
from .components import connected_components
from .kernels import chain, give_back, mix, slices, word_hashes
from .sketch import hits, key_bitmap

#: Words of a shingle, words that a paragraph has at least, and the threshold.
WIDTH, LEAST_WORDS, PERCENT = 5, 8, 80
#: Words that a run of neighbouring repeated paragraphs has at least. A passage of
#: 50 words may lose up to a paragraph at either end to the text around it.
RUN_WORDS = 25
#: Words that a line has at least and that a window has, and starts of which one is an
#: anchor. Any WINDOW + ANCHORS - 1 words that two texts share hold an equal window.
WINDOW, ANCHORS = RUN_WORDS, 12
PARAGRAPH, LINE, WORDS = range(3)
_KINDS = mix(np.arange(1, 4, dtype=np.uint64)) * np.array([0, 1, 1], np.uint64)
_NEVER = np.uint64(2**64 - 1)
#: Three bands of one row find a pair at 0.8 with probability 1 - 0.2 ** 3 = 0.992. Wider
#: bands would need more of them; what few rows let through is cut by the second key.
BANDS, ROWS = 3, 1
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_QUOTE = np.zeros(256, bool)
_QUOTE[list(b"\"')]")] = True


@dataclass
class Paragraphs:
    """The paragraphs and then the lines of a run of texts, as columns."""

    kind: np.ndarray
    text: np.ndarray  # number of the text in its run
    no: np.ndarray  # number of the unit in its text
    start: np.ndarray  # first byte in the text
    length: np.ndarray  # bytes
    words: np.ndarray
    first: np.ndarray  # number of the first word in ``hashes``
    hashes: np.ndarray  # of the run's words
    shingles: np.ndarray  # of all paragraphs, one after the other
    heads: np.ndarray  # each paragraph's first shingle

    @cached_property
    def digest(self) -> np.ndarray:
        heads = np.cumsum(self.words) - self.words
        place = np.arange(self.words.sum()) - np.repeat(heads, self.words)
        signed = mix(self.hashes[np.repeat(self.first, self.words) + place] + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        return mix(np.add.reduceat(signed, heads) + self.words.astype(np.uint64) + _KINDS[self.kind])


@dataclass
class Windows:
    """The word windows of a run of texts, as columns."""

    text: np.ndarray
    no: np.ndarray
    start: np.ndarray
    length: np.ndarray
    digest: np.ndarray


def _closing(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a line or sentence ends with the word, and whether a line does."""
    last = raw[ends - 1]
    before = raw[np.maximum(ends - 2, starts)]
    stop = _STOP[last] | (_QUOTE[last] & _STOP[before])
    lines = np.concatenate(([0], np.cumsum(raw == 10)))
    after = np.concatenate((lines[starts[1:]], [lines[-1]]))
    line = after > lines[ends]
    return stop | line, line


def _spans(closing: np.ndarray, bounds: np.ndarray, least: int) -> np.ndarray:
    """(text, no, first word, last word + 1) of the paragraphs of ``least`` words and more.

    A paragraph ends with a line or sentence once it has ``least`` words, and with
    its text; a shorter rest of a text belongs to the paragraph before it.
    """
    out, stops = [], np.flatnonzero(closing) + 1
    for text in range(len(bounds) - 1):
        first, end, no = int(bounds[text]), int(bounds[text + 1]), 0
        lo, hi = np.searchsorted(stops, (first + least, end))
        for stop in [*stops[lo:hi].tolist(), end]:
            if stop - first >= least:
                out.append((text, no, first, stop))
                first, no = stop, no + 1
        if no and first < end:
            out[-1] = (text, no - 1, out[-1][2], end)
    return np.array(out, np.int64).reshape(-1, 4)


def _line_spans(line: np.ndarray, bounds: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """(text, no, first word, last word + 1) of the long lines that are not one of ``spans``.

    A text's lines are numbered on from its spans.
    """
    closing = line.copy()
    closing[bounds[1:][np.diff(bounds) > 0] - 1] = True
    stop = np.flatnonzero(closing) + 1
    first = np.concatenate(([0], stop[:-1]))
    n = len(line) + 1
    new = (stop - first >= WINDOW) & ~np.isin(first * n + stop, spans[:, 2] * n + spans[:, 3])
    text = np.searchsorted(bounds, first[new], side="right") - 1
    no = _numbers(text) + np.bincount(spans[:, 0], minlength=len(bounds))[text]
    return np.stack([text, no, first[new], stop[new]], axis=1)


def _numbers(text: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of equal numbers."""
    return np.arange(len(text)) - np.searchsorted(text, text)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    size = 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def _anchors(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """First words of windows: those least in some run of ANCHORS starts of their text."""
    n = len(hashes)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    order = np.full(n + 2 * (ANCHORS - 1), _NEVER)
    own = order[ANCHORS - 1 : ANCHORS - 1 + n]
    own[: n - WIDTH + 1] = mix(chain(hashes, WIDTH) ^ _SEEDS[0]) >> np.uint64(1)
    # Fewer words than a window are left: a gap that no run of starts spans.
    own[np.arange(n) + WINDOW > np.repeat(bounds[1:], np.diff(bounds))] = _NEVER
    return np.flatnonzero((own == ~_least(~_least(order, ANCHORS), ANCHORS)) & (own != _NEVER))


def _windows(hashes: np.ndarray, bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray, held: np.ndarray) -> Windows:
    """The windows of all texts; a text's are numbered on from its ``held`` units."""
    first = _anchors(hashes, bounds)
    digest = np.full(len(first), WINDOW, np.uint64)
    for k in range(WINDOW):
        digest = digest * np.uint64(0xA24BAED4963EE407) + hashes[first + k]
    digest = mix(digest ^ _KINDS[WORDS])
    text = np.searchsorted(bounds, first, side="right") - 1
    # A window that overlaps an equal one of its text is no copy of it.
    order = np.lexsort((first, digest, text))
    a, b = order[:-1], order[1:]
    whole = np.ones(len(first), bool)
    whole[b[(text[a] == text[b]) & (digest[a] == digest[b]) & (first[b] - first[a] < WINDOW)]] = False
    first, digest, text = first[whole], digest[whole], text[whole]
    return Windows(text, _numbers(text) + held[text], starts[first] - offsets[text], ends[first + WINDOW - 1] - starts[first], digest)


def paragraphs(texts: list[str | None], least: int = LEAST_WORDS, windows: bool = True) -> Iterator[tuple[int, Paragraphs | Windows]]:
    """(number of the first text, units) for runs of texts, without the windows if so told; ``least`` >= WIDTH."""
    for begin, _, joined, offsets in slices(texts):
        hashes, bounds, starts, ends = word_hashes(joined, offsets)
        if not len(starts):
            continue
        closing, line = _closing(np.frombuffer(joined, np.uint8), starts, ends)
        spans = _spans(closing, bounds, least)
        lines = _line_spans(line, bounds, spans)
        kind = np.repeat([PARAGRAPH, LINE], [len(spans), len(lines)])
        text, no, first, stop = np.concatenate((spans, lines)).T
        if windows:
            yield begin, _windows(hashes, bounds, starts, ends, offsets, np.bincount(text, minlength=len(bounds)))
        if not len(text):
            continue
        words = stop - first
        sizes = words - WIDTH + 1
        heads = np.cumsum(sizes) - sizes
        at = np.repeat(first - heads, sizes) + np.arange(sizes.sum())
        shingles = chain(hashes, WIDTH)[at] ^ np.repeat(_KINDS[kind], sizes)
        yield begin, Paragraphs(kind, text, no, starts[first] - offsets[text], ends[stop - 1] - starts[first], words, first, hashes, shingles, heads)


def _lists(values: np.ndarray, heads: np.ndarray) -> pa.Array:
    offsets = np.concatenate((heads, [len(values)]))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def _bands(x: Paragraphs) -> np.ndarray:
    """The band keys, a row for each unit."""
    mins = [np.minimum.reduceat(mix(x.shingles ^ seed), x.heads) for seed in _SEEDS]
    keys = []
    for b in range(BANDS):
        key = np.full(len(x.heads), b, np.uint64)
        for least in mins[b * ROWS : (b + 1) * ROWS]:
            key = key * np.uint64(3) + least
        keys.append(mix(key))
    return np.stack(keys, axis=1)


def _keys(least: int):
    """Every key that may repeat: the digests of windows, and the bands of paragraphs and lines.

    Equal paragraphs have equal bands, so that their digests need no keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in paragraphs(batch.column(0).to_pylist(), least):
                keys = x.digest if isinstance(x, Windows) else _bands(x).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])
        give_back()

    return run


def _units(least: int, repeated: Broadcast):
    """Rows kind, doc, tid, no, start, length, words, digest, bands of the units with a repeated key.

    ``bands`` are the repeated ones; windows have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = repeated.value
        for batch in batches:
            docs, tids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for begin, x in paragraphs(batch.column(2).to_pylist(), least):
                n = len(x.text)
                if isinstance(x, Windows):
                    told = hits(table, x.digest)
                    kind, words, bands, common = np.full(n, WORDS), np.full(n, WINDOW), np.zeros((n, 0), np.uint64), np.zeros((n, 0), bool)
                else:
                    kind, words, bands = x.kind, x.words, _bands(x)
                    common = hits(table, bands.ravel()).reshape(bands.shape)
                    told = common.any(axis=1)
                counts = common[told].sum(axis=1)
                rows = begin + x.text[told]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(kind[told], pa.int32()),
                        pa.array(docs[rows]),
                        pa.array(tids[rows]),
                        *(pa.array(c[told], pa.int32()) for c in (x.no, x.start, x.length, words)),
                        pa.array(x.digest[told].view(np.int64)),
                        _lists(bands[told][common[told]], np.cumsum(counts) - counts),
                    ],
                    names=["kind", "doc", "tid", "no", "start", "length", "words", "digest", "bands"],
                )
        give_back()

    return run


def _sets(least: int, wanted: Broadcast):
    """Rows digest, tokens: the shingles, with repeats, of the wanted paragraphs and lines, each once a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in paragraphs(batch.column(0).to_pylist(), least, windows=False):
                once = np.zeros(len(x.digest), bool)
                once[np.unique(x.digest, return_index=True)[1]] = True
                picked = np.flatnonzero(once & hits(wanted.value, x.digest))
                sizes = np.diff(np.append(x.heads, len(x.shingles)))[picked]
                heads = np.cumsum(sizes) - sizes
                at = np.repeat(x.heads[picked] - heads, sizes) + np.arange(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.digest[picked].view(np.int64)), _lists(x.shingles[at], heads)], names=["digest", "tokens"]
                )
        give_back()

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    both = pairs.join(sets.select(F.col("digest").alias("a"), F.col("tokens").alias("ta")), "a").join(
        sets.select(F.col("digest").alias("b"), F.col("tokens").alias("tb")), "b"
    )
    shared, union = F.size(F.array_intersect("ta", "tb")), F.size(F.array_union("ta", "tb"))
    return both.where(shared * 100 >= union * percent).select("a", "b")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """Rows digest, n, central, pos, token: each set's prefix in the order of rarity.

    Two sets at the threshold share a token of their prefixes in any one order.
    Tokens of one set only come first and are left out, so that the many edited
    words of distant copies fill their prefixes; ``pos`` counts them. ``central`` is
    large for sets whose tokens many others have.
    """
    tokens = sets.select("digest", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    counts = materialize(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "paragraph-df")
    plain = F.col("n") - ((F.col("n") * percent + 99) / 100).cast("long") + 1
    # Windows over the tokens of one set.
    by_df = Window.partitionBy("digest").orderBy("df", "token")
    whole = by_df.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        tokens.join(counts, "token")
        .select(
            "digest",
            "n",
            "token",
            F.row_number().over(by_df).alias("k"),
            F.count("*").over(whole).alias("held"),
            (F.sum(F.log2("df")).over(whole) / F.col("n")).alias("central"),
        )
        .withColumn("pos", F.col("n") - F.col("held") + F.col("k"))
        .where(F.col("pos") <= plain)
        .select("digest", F.col("n").cast("int").alias("n"), "central", F.col("pos").cast("int").alias("pos"), "token")
    )


def _near(percent: int) -> Column:
    """Length and positional filters for rows l and r of one token.

    The tokens before both positions hold no common one if this is the first, so
    that the rest bounds the overlap; a link passes at its first common token.
    """
    bound = F.least(F.col("l.n") - F.col("l.pos"), F.col("r.n") - F.col("r.pos")) + 1
    both = F.col("l.n") + F.col("r.n")
    return (
        (F.col("l.n") * 100 >= F.col("r.n") * percent)
        & (F.col("r.n") * 100 >= F.col("l.n") * percent)
        & (bound * (100 + percent) >= both * percent)
    )


def repeated_paragraphs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST_WORDS,
    percent: int = PERCENT,
    run_words: int = RUN_WORDS,
) -> DataFrame:
    """One row per unit of a repeated passage: doc_id, paragraph, start,
    length, words, first_doc_id, first_paragraph, copies, removed.

    Units are paragraphs, lines and word windows, numbered in this order in a text;
    they may overlap. ``start`` and ``length`` are bytes of the UTF-8 text. ``first_*`` name the
    component's unit that stays, ``copies`` counts the component's units.
    Paragraphs of fewer than ``least`` (at least ``WIDTH``) words are not compared; null and empty texts
    have none. ``run_words`` holds for runs of paragraphs; lines and windows have ``WINDOW``
    words at least. Rows that repeat id and text are one document. A null id is kept as
    null and comes first. Other columns are not read. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    narrow = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tid"),
        F.col(text_col).alias("text"),
    )
    with dropped_shuffles(docs.sparkSession):
        repeats = materialize(narrow.groupBy("doc", "tid").agg(F.count("*").alias("rows")).where("rows > 1").select("doc", "tid"), "paragraph-rows")
        if not repeats.isEmpty():
            again = narrow.join(repeats, ["doc", "tid"], "left_semi").dropDuplicates(["doc", "tid"])
            narrow = materialize(narrow.join(repeats, ["doc", "tid"], "left_anti").unionByName(again), "paragraph-texts")
        # A bitmap of fixed size tells which keys repeat, so that all other units stay in
        # their tasks; what it lets through is compared exactly below.
        again = narrow.select("text").mapInArrow(_keys(least), "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        repeated = docs.sparkSession.sparkContext.broadcast(key_bitmap(again))
        everything = materialize(
            narrow.mapInArrow(
                _units(least, repeated), "kind int, doc long, tid long, no int, start int, length int, words int, digest long, bands array<long>"
            ),
            "paragraphs",
        )
        units = everything.where(F.col("kind") != WORDS)
        # Band keys that paragraphs of different words share.
        keys = units.select("digest", F.explode("bands").alias("band")).distinct()
        common = keys.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
        members = materialize(keys.join(common, "band"), "paragraph-members")
        links = _links(narrow, members, least, percent)
        labels = materialize(connected_components(links), "paragraph-labels")

        place = F.struct("doc", "tid", "no")
        named = units.select("kind", "doc", "tid", "no", "start", "length", "words", "digest").join(
            labels, F.col("digest") == F.col("node"), "left"
        ).withColumn("group", F.coalesce("component", "digest")).drop("node", "component")
        groups = materialize(
            named.groupBy("group").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count("*").alias("copies")).where("lo <> hi"),
            "paragraph-groups",
        )
        windows = everything.where(F.col("kind") == WORDS).drop("kind", "bands")
        # The windows whose words occur elsewhere, with their first place and copies.
        window_groups = materialize(
            windows.groupBy("digest").agg(F.min(place).alias("lo"), F.count("*").alias("copies")).where("copies > 1"), "window-groups"
        )
    real = lambda c: F.when(F.col(c) == -(2**63), F.lit(None)).otherwise(F.col(c))
    repeated = named.join(groups.select("group", "lo", "copies"), "group")
    # Windows over one document's paragraphs; a line is a passage in itself.
    document = Window.partitionBy("doc", "tid", "kind")
    island = F.col("no") - F.row_number().over(document.orderBy("no"))
    run = F.sum("words").over(Window.partitionBy("doc", "tid", "kind", "island"))
    passages = (
        repeated.withColumn("island", island)
        .withColumn("run_words", run)
        .where((F.col("kind") == LINE) | (F.col("run_words") >= run_words))
    )
    columns = ["doc", "tid", "no", "start", "length", "words", "lo", "copies"]
    return (
        passages.select(*columns)
        .unionByName(windows.join(window_groups, "digest").select(*columns))
        .select(
            real("doc").alias("doc_id"),
            F.col("no").alias("paragraph"),
            "start",
            "length",
            "words",
            real("lo.doc").alias("first_doc_id"),
            F.col("lo.no").alias("first_paragraph"),
            "copies",
            (place != F.col("lo")).alias("removed"),
        )
    )


def _links(narrow: DataFrame, members: DataFrame, least: int, percent: int) -> DataFrame:
    """Verified links (a, b) of digests that together span every component."""
    spark = narrow.sparkSession
    wanted = members.select("digest").distinct()
    told = narrow.select("text").mapInArrow(_sets(least, spark.sparkContext.broadcast(key_bitmap(wanted))), "digest long, tokens array<long>")
    sets = materialize(
        told.join(wanted, "digest", "left_semi").dropDuplicates(["digest"]).select("digest", F.array_distinct("tokens").alias("tokens")),
        "paragraph-sets",
    )
    keyed = materialize(
        members.join(_prefixes(sets, percent), "digest").select(F.xxhash64("band", "token").alias("key"), "digest", "n", "pos", "central"),
        "paragraph-keys",
    )
    release(spark, members)
    leaders = materialize(
        keyed.groupBy("key")
        .agg(F.max(F.struct("central", "digest", "n", "pos")).alias("top"), F.count("*").alias("size"))
        .where("size > 1")
        .select("key", F.col("top.digest").alias("digest"), "top.n", "top.pos"),
        "paragraph-leaders",
    )
    first = keyed.alias("l").join(leaders.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.digest") != F.col("r.digest")) & _near(percent))
    starred = materialize(_verified(_pairs(first), sets, percent), "paragraph-links")
    labels = materialize(connected_components(starred), "paragraph-labels")
    node = labels.select(F.col("node").alias("digest"), "component")
    lead = (
        leaders.select("key", "digest").join(node, "digest", "left")
        .select("key", F.col("digest").alias("lead"), F.coalesce("component", "digest").alias("lead_label"))
    )
    owner = materialize(
        keyed.select("key", "digest", "n", "pos").join(lead, "key").join(node, "digest", "left")
        .select("key", "digest", "n", "pos", F.coalesce("component", "digest").alias("label"), "lead", "lead_label"),
        "paragraph-labelled",
    )
    release(spark, keyed)
    # The leader itself has been compared with the whole group.
    strays = materialize(owner.where("label <> lead_label").drop("lead", "lead_label"), "paragraph-strays")
    others = owner.where("digest <> lead").drop("lead", "lead_label")
    second = strays.alias("l").join(
        others.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.label") != F.col("r.label")) & _near(percent)
    )
    rest = materialize(_verified(_pairs(second), sets, percent), "paragraph-links")
    release(spark, owner, strays)
    return starred.unionByName(rest)


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("l.digest", "r.digest").alias("a"), F.greatest("l.digest", "r.digest").alias("b")).distinct()
