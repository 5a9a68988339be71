"""N-gram Jaccard self-join with prefix filters under several global token orders.

Two documents link when the Jaccard similarity of their word-shingle sets is at
least ``percent`` / 100. In any one global order of the shingles, two similar sets
share a shingle of their prefixes, so a candidate pair must pass under each order:

* order A, ascending shingle hash. A longer prefix (``SPARE`` more of the set)
  must share as many shingles with one partner; a document whose prefix has too
  few shingles that any other set's prefix has is out. One count over a quarter of
  the postings removes almost all documents that have no partner, also those that
  share a passage with thousands of others.
* order B, rarest first, by exact counts over the remaining sets. It feeds the
  inverted index, with length and positional filters.
* order C, ascending second hash. Checked, like A, for every pair from B before
  the exact comparison of the whole sets.

Equal sets are one class, compared once. A posting list is never joined with
itself outright: each list names its most central set as leader, all others are
compared with the leaders first, and after connected components only the rows
outside a list's leading component are compared with the rest of the list. A list
whose members are one component already adds nothing, so a group of near copies
costs about one comparison a member, and every link between components is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release
from .components import connected_components
from .kernels import mix, shingle_sets

#: Hundredths of a set by which order A's prefix is longer than the plain one.
SPARE = 10
_SEED_C = np.uint64(0x5851F42D4C957F2D)


def _up(n, hundredths: int):
    """ceil(n * hundredths / 100) in integers, for Python, numpy and Column alike."""
    if isinstance(n, Column):
        return ((n * hundredths + 99) / 100).cast("long")
    return (n * hundredths + 99) // 100


def _signed(tokens: np.ndarray) -> np.ndarray:
    return tokens.view(np.int64)


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    """Two independent order-free 64-bit sums of a set."""
    pair = [mix(tokens ^ np.uint64(k)).sum(dtype=np.uint64) for k in (0x1F3D, 0x7A2B9)]
    return tuple(np.array(pair, np.uint64).view(np.int64).tolist())


def _signatures(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sizes, one, two, heads = [], [], [], []
                for tokens in shingle_sets(part.column(1).to_pylist(), width):
                    n = len(tokens)
                    a, b = _digest(tokens)
                    sizes.append(n)
                    one.append(a)
                    two.append(b)
                    heads.append(_signed(tokens[: n - _up(n, percent) + _up(n, SPARE)]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), _lists(heads)],
                    names=["id", "n", "sig1", "sig2", "head"],
                )

    return run


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def _sets(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = list(shingle_sets(part.column(1).to_pylist(), width))
                heads = []
                for tokens in sets:
                    n = len(tokens)
                    p = n - _up(n, percent) + 1
                    second = np.argsort(mix(tokens ^ _SEED_C), kind="stable")[:p]
                    heads.append(_signed(tokens[second]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), _lists([_signed(s) for s in sets]), _lists(heads)],
                    names=["id", "n", "tokens", "head_c"],
                )

    return run


def _overlap_needed(a: Column, b: Column, percent: int) -> Column:
    """Least shared shingles of two linked sets: ceil(p / (100 + p) * (a + b))."""
    return (((a + b) * percent + (99 + percent)) / (100 + percent)).cast("long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass orders A and C and the exact comparison."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"), F.col("head_c").alias("ca"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"), F.col("head_c").alias("cb"))
    both = pairs.join(left, "a").join(right, "b")
    head = lambda t, n: F.slice(t, 1, (n - _up(n, percent) + 1).cast("int"))
    shared = F.when(
        F.arrays_overlap("ca", "cb") & F.arrays_overlap(head(F.col("ta"), F.col("na")), head(F.col("tb"), F.col("nb"))),
        F.size(F.array_intersect("ta", "tb")),
    ).otherwise(F.lit(0))
    # Orders A and C are checked and the sets intersected in one pass over a pair.
    return (
        both.select("a", "b", "na", "nb", shared.alias("shared"))
        .where((F.col("shared") > 0) & (F.col("shared") * 100 >= (F.col("na") + F.col("nb") - F.col("shared")) * percent))
        .select("a", "b")
    )


def _near(percent: int) -> Column:
    """Length and positional filters for posting rows l and r of one shingle.

    The positional bound takes the shingle as the pair's first common one; a pair
    that fails it here passes at its own first common shingle if it is a link.
    """
    bound = F.least(F.col("l.n") - F.col("l.pos"), F.col("r.n") - F.col("r.pos")) + 1
    return (
        (F.col("l.n") * 100 >= F.col("r.n") * percent)
        & (F.col("r.n") * 100 >= F.col("l.n") * percent)
        & (bound >= _overlap_needed(F.col("l.n"), F.col("r.n"), percent))
    )


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(
        F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")
    ).distinct()


def ngram_jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 4,
    percent: int = 85,
) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id``.

    ``component_id`` is the least id that links reach, the row's own included.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased. A text
    with fewer than ``width`` words is one shingle. Null and empty texts and texts
    without words have ``n_shingles`` 0 and link with nothing. Rows with a null id
    are returned with a null component and link with nothing. Rows that repeat an id
    are rows of one document and get one component. Other columns are not read, so
    their names may clash. An empty table gives no rows.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = materialize(
        narrow.mapInArrow(_signatures(width, percent), "id long, n long, sig1 long, sig2 long, head array<long>"),
        "ngram-heads",
    )
    real = base.where("n > 0 and id is not null")

    # Order A: shingles of the longer prefixes that at least two different sets have.
    postings = real.select("sig1", F.explode("head").alias("token"))
    common = (
        postings.groupBy("token")
        .agg(F.min("sig1").alias("lo"), F.max("sig1").alias("hi"))
        .where("lo <> hi")
        .select("token")
    )
    least = _up(_up(F.col("n"), percent), SPARE)
    hits = (
        real.select("id", "n", "sig1", "sig2", F.explode("head").alias("token"))
        .join(common, "token", "left_semi")
        .groupBy("id", "n", "sig1", "sig2")
        .agg(F.count("*").alias("hits"))
        .where(F.col("hits") >= least)
    )
    survivors = materialize(
        hits.groupBy("sig1", "sig2").agg(F.min("id").alias("id")).select("id"), "ngram-survivors"
    )

    whole = narrow.join(survivors, "id", "left_semi")
    sets = materialize(
        whole.mapInArrow(_sets(width, percent), "id long, n long, tokens array<long>, head_c array<long>"),
        "ngram-sets",
    )
    links = _links(sets, percent)

    classes = materialize(
        real.groupBy("sig1", "sig2")
        .agg(F.min("id").alias("rep"), F.max("id").alias("last"))
        .where("rep <> last")
        .select("sig1", "sig2", "rep"),
        "ngram-classes",
    )
    labels = materialize(connected_components(links), "ngram-labels")
    named = (
        base.select("id", "n", "sig1", "sig2")
        .join(classes, ["sig1", "sig2"], "left")
        .withColumn("node", F.when(F.col("n") > 0, F.coalesce("rep", "id")).otherwise(F.col("id")))
        .join(labels.select("node", "component"), "node", "left")
        .select(
            F.col("id").alias("doc_id"),
            F.col("n").alias("n_shingles"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    return named


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between sets that together span every component."""
    spark = sets.sparkSession
    # Order B: by count, then hash. Shingles of one set only come first, unlisted.
    tokens = sets.select("id", "n", F.explode("tokens").alias("token"))
    counts = materialize(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "ngram-df")
    ranked = (
        tokens.join(counts, "token")
        .groupBy("id", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("by_df"), F.sum(F.log2("df")).alias("weight"))
        .withColumn("alone", F.col("n") - F.size("by_df"))
        .withColumn("prefix", F.col("n") - _up(F.col("n"), percent) + 1 - F.col("alone"))
        .where("prefix > 0")
    )
    listed = materialize(
        ranked.select(
            "id",
            "n",
            (F.col("weight") / F.col("n")).alias("central"),
            "alone",
            F.posexplode(F.slice("by_df", 1, F.col("prefix").cast("int"))).alias("k", "item"),
        ).select("id", "n", "central", (F.col("alone") + F.col("k") + 1).alias("pos"), F.col("item.token").alias("token")),
        "ngram-index",
    )
    leaders = materialize(
        listed.groupBy("token")
        .agg(F.max(F.struct("central", (-F.col("id")).alias("minus"), "n", "pos")).alias("top"), F.count("*").alias("size"))
        .where("size > 1")
        .select("token", (-F.col("top.minus")).alias("id"), "top.n", "top.pos"),
        "ngram-leaders",
    )
    first = _pairs(
        listed.alias("l").join(leaders.alias("r"), (F.col("l.token") == F.col("r.token")) & (F.col("l.id") != F.col("r.id")) & _near(percent))
    )
    starred = materialize(_verified(first, sets, percent), "ngram-links")
    labels = materialize(connected_components(starred), "ngram-labels")

    owner = materialize(
        listed.join(labels, listed["id"] == labels["node"], "left").select(
            "token", "id", "n", "pos", F.coalesce("component", "id").alias("label")
        ),
        "ngram-labelled",
    )
    heads = leaders.select("token", F.col("id").alias("leader"))
    head_labels = heads.join(labels, heads["leader"] == labels["node"], "left").select(
        "token", F.coalesce("component", "leader").alias("lead_label")
    )
    strays = materialize(owner.join(head_labels, "token").where("label <> lead_label").drop("lead_label"), "ngram-strays")
    second = _pairs(
        strays.alias("l").join(
            owner.alias("r"),
            (F.col("l.token") == F.col("r.token")) & (F.col("l.label") != F.col("r.label")) & _near(percent),
        )
    )
    rest = materialize(_verified(second, sets, percent), "ngram-links")
    release(spark, counts)
    return starred.unionByName(rest)


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose component has a smaller id; columns unchanged.

    Of rows that repeat an id one stays. Rows with a null id stay.
    """
    found = ngram_jaccard_components(docs, id_col, text_col, **options)
    gone = materialize(
        found.where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct(), "ngram-gone"
    )
    kept = docs.join(gone, docs[id_col].cast("long") == F.col("__gone"), "left_anti")
    repeats = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if repeats.isEmpty():
        return kept
    # Only texts of repeated ids are compared; the others pass by.
    again = materialize(repeats.select(F.col("doc_id").alias("__again")), "ngram-again")
    on = kept[id_col].cast("long") == F.col("__again")
    alone = kept.join(again, on, "left_anti")
    return alone.unionByName(kept.join(again, on, "left_semi").dropDuplicates([id_col]))
