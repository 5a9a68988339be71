"""Quality by importance resampling of hashed n-gram models.

Two generative models of hashed word n-grams, one of target texts and one of the raw
corpus, give each document its log importance weight, the sum of log ratios over its
n-grams. Seeded Gumbel noise is added and the largest k keys are kept, which samples
without replacement in proportion to the weights. The k-th key is found by counting
keys in ever narrower bins, so no task sorts all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .kernels import NOT_ALNUM, SPACE, chain, slices, word_hashes
from .mixing import uniform
from .sketch import SLOT_BITS, hits, key_bitmap

#: Hashed n-gram buckets of each model.
BUCKETS = 1 << 15
#: Keys that the last bin may have before it is ordered outright.
_LAST = 5000
_BINS = 512


def ngram_buckets(texts: list[str | None], buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Each text's bucket of every word and every pair of words, in order, with repeats."""
    mask = np.uint64(buckets - 1)
    for _, _, joined, offsets in slices([t.lower() if t else t for t in texts]):
        words, bounds, _, _ = word_hashes(joined, offsets, SPACE)
        pairs = chain(words, 2)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield (np.concatenate((words[a:b], pairs[a : max(a, b - 1)])) & mask).astype(np.int64)


def _counted(table: np.ndarray):
    """Per task, the buckets' counts over all texts and over those whose id's key is in the bitmap."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for frame in frames:
            for at in range(0, len(frame), 500):
                part = frame.iloc[at : at + 500]
                found = list(ngram_buckets(part["text"].tolist()))
                marked = part["known"].to_numpy(bool) & hits(table, part["key"].to_numpy(np.int64))
                chosen = [ids for ids, target in zip(found, marked, strict=True) if target]
                counts[0] += np.bincount(np.concatenate(found), minlength=BUCKETS)
                if chosen:
                    counts[1] += np.bincount(np.concatenate(chosen), minlength=BUCKETS)
        yield pd.DataFrame({"bucket": np.arange(BUCKETS), "raw": counts[0], "target": counts[1]})

    return run


def _counts(docs: DataFrame, table: np.ndarray) -> pd.DataFrame:
    keyed = docs.select("text", F.col("id").isNotNull().alias("known"), F.xxhash64("id").alias("key"))
    return (
        keyed.mapInPandas(_counted(table), "bucket int, raw long, target long")
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .toPandas().set_index("bucket").reindex(range(BUCKETS), fill_value=0)
    )


def log_ratios(docs: DataFrame, target_ids: DataFrame, bits: int = SLOT_BITS) -> np.ndarray:
    """log(target / raw) of every bucket, with one count added to each.

    A bitmap of fixed size tells target texts where they lie, so that no text is
    shuffled. Ids that it marks and that are no targets are found by an exact join of
    ids, and what their texts have added is taken off again.
    """
    table = key_bitmap(target_ids.select(F.xxhash64("__target")), bits)

    @F.pandas_udf("boolean")
    def marked(keys: pd.Series) -> pd.Series:
        return pd.Series(hits(table, keys.to_numpy()))

    ids = docs.where("id is not null").select("id").where(marked(F.xxhash64("id")))
    strays = materialize(ids.join(target_ids, ids["id"] == target_ids["__target"], "left_anti").distinct(), "quality-strays")
    counts = _counts(docs, table)
    if not strays.isEmpty():
        counts["target"] -= _counts(docs.join(strays, "id", "left_semi"), table)["target"]
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    raw += counts["raw"].to_numpy()
    target += counts["target"].to_numpy()
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def kth_largest(keys: DataFrame, k: int) -> tuple[float, int | None]:
    """(key, id) of the k-th row by key descending, id ascending; keys has (key, id).

    Rows with a greater key, or the same key and no greater id, are the first k.
    """
    low, high, above = *keys.agg(F.min("key"), F.max("key")).first(), 0
    while True:
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        if low == high or inside.count() <= _LAST:
            # Equal keys are ordered by id; as many rows as are wanted of this bin.
            last = inside.orderBy(F.desc("key"), F.asc_nulls_first("id")).limit(k - above).orderBy("key", F.desc_nulls_last("id")).first()
            return last["key"], last["id"]
        width = (high - low) / _BINS
        slot = F.least(F.floor((F.col("key") - low) / width), F.lit(_BINS - 1)).cast("int")
        for row in sorted(
            inside.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect(),
            key=lambda r: -r["slot"],
        ):
            if above + row["n"] >= k:
                low, high = row["lo"], row["hi"]
                break
            above += row["n"]


def importance_sample(
    docs: DataFrame,
    target_ids: DataFrame,
    k: int | None = None,
    share: float | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: str = "dsir-1",
) -> DataFrame:
    """The sampled rows: doc_id, log_weight, key, n_grams.

    ``target_ids`` has ids of target texts in ``doc_id``; all of them are counted. ``k``, or ``share`` of the rows, is the
    size of the sample. Null and empty texts have no n-grams and weight 0. Rows that
    repeat an id share their noise and are told apart by nothing: at the last place
    all of them are kept. An empty table gives no rows.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    picked = materialize(
        target_ids.where("doc_id is not null")
        .select(F.col("doc_id").cast("long").alias("__target"))
        .distinct(),
        "quality-target",
    )
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(narrow, picked))

    def weigh(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = ratios.value
        for texts in parts:
            found = [(float(table[ids].sum()), len(ids)) for ids in ngram_buckets(texts.tolist())]
            yield pd.DataFrame(found, columns=["log_weight", "n_grams"]).astype({"log_weight": "float64", "n_grams": "int64"})

    weighed = F.pandas_udf(weigh, "log_weight double, n_grams long")
    noise = -F.log(-F.log((uniform(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("null")))) * 0.999998 + 1e-6)))
    keyed = materialize(
        narrow.withColumn("w", weighed("text")).select("id", "w.log_weight", "w.n_grams", (F.col("w.log_weight") + noise).alias("key")),
        "quality-keys",
    )
    rows = keyed.count()
    k = min(rows, round(rows * share) if k is None else k)
    if k <= 0:
        return keyed.where("false").select(F.col("id").alias("doc_id"), "log_weight", "key", "n_grams")
    key, last = kth_largest(keyed.select("key", "id"), k)
    tie = F.lit(True) if k == rows else (F.col("key") > key) | ((F.col("key") == key) & (F.col("id").isNull() | (F.col("id") <= F.lit(last))))
    return keyed.where(tie).select(F.col("id").alias("doc_id"), "log_weight", "key", "n_grams")


def quality_sample(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Sample as many documents as the labels say are of good quality, with them as target."""
    known = labels.where("quality is not null and doc_id is not null")
    share = known.agg(F.avg((F.col("quality") > 0).cast("double"))).first()[0]
    return importance_sample(docs, known.where("quality > 0").select("doc_id"), share=share or 0.0, **options)
