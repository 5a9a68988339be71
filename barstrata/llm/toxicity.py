"""Toxicity: a logistic classifier of hashed words with a counterfactual penalty.

Training texts are paired with copies whose identity terms are swapped for others of
the same group; a text without such terms gets a neutral sentence that names a group.
The loss is the labels' cross-entropy, an L2 penalty, and the squared difference of
the logits of a text and its counterfactual: naming a group must not move the score.
Words count by the evidence they bring: a feature's value is the z-score of its log
odds between the classes, and features without evidence for toxicity are left out, so
names and rare words of clean texts cannot carry a score; identity terms always count,
and the penalty decides on their weight. The model is fitted on a
bounded sample of labelled rows; every text is scored whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize
from .kernels import NOT_ALNUM, give_back, slices, word_hashes

#: Hashed word features.
BITS = 20
#: Labelled rows of each class that the model is fitted on, by least hash of the id.
TRAIN_ROWS_PER_CLASS = 6000
#: Weight of the counterfactual penalty and of L2.
FAIRNESS, RIDGE = 10.0, 1e-3
STEPS = 250
#: Least z-score, and toxic training rows, of a feature that counts.
EVIDENCE, SEEN = 1.3, 3

# Identity terms; those of a line stand for one another in swaps.
IDENTITY_TERMS = (
    "women men girls boys woman man girl boy female male",
    "black white asian latino african european arab indigenous",
    "christian muslim jewish hindu buddhist atheist catholic protestant",
    "gay straight lesbian bisexual transgender queer heterosexual",
    "immigrants refugees natives foreigners migrants citizens",
    "american mexican chinese german french spanish russian indian",
    "deaf blind disabled autistic elderly young",
    "frauen männer mädchen jungen muslime christen juden",
    "femmes hommes filles garçons musulmans chrétiens juifs",
    "mujeres hombres chicas chicos musulmanes cristianos judíos",
)
_GROUP = {w: k for k, line in enumerate(IDENTITY_TERMS) for w in line.split()}
_TERM = re.compile(r"\b(" + "|".join(sorted(_GROUP, key=len, reverse=True)) + r")\b", re.IGNORECASE)


def swap_terms(text: str, turn: int = 1) -> str:
    """``text`` with every identity term replaced by the one ``turn`` places on in its line."""

    def other(m: re.Match) -> str:
        line = IDENTITY_TERMS[_GROUP[m[0].lower()]].split()
        return line[(line.index(m[0].lower()) + turn) % len(line)]

    return _TERM.sub(other, text)


def counterfactual(text: str, key: int) -> tuple[str, str]:
    """A sentence that names an identity term, and its twin with another of the same line.

    A text that names none is given a neutral sentence that does, the same on both
    sides but for the term, which may be any other, so that every term is a feature
    of texts of both labels.
    """
    if _TERM.search(text):
        return text, swap_terms(text, 1 + key % 3)
    terms = sorted(_GROUP)
    at, step = key % len(terms), 1 + key // len(terms) % (len(terms) - 1)
    return tuple(f"{text} They are {terms[k % len(terms)]}." for k in (at, at + step))


def word_features(texts: list[str | None], bits: int = BITS) -> Iterator[np.ndarray]:
    """Each text's distinct feature numbers: hashed lower-case words without punctuation."""
    mask = np.uint64((1 << bits) - 1)
    for _, _, joined, offsets in slices([t.lower() if t else t for t in texts]):
        hashes, bounds, _, _ = word_hashes(joined, offsets, NOT_ALNUM)
        ids = (hashes & mask).astype(np.int64)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield np.unique(ids[a:b])


def identity_features(bits: int = BITS) -> np.ndarray:
    """The feature numbers of the identity terms."""
    return np.unique(np.concatenate(list(word_features(sorted(_GROUP), bits))))


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows], np.int64)
    return np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(rows)), lengths)


def evidence(features: list[np.ndarray], labels: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Each feature's value: the z-score of its log odds, 0 without evidence.

    Identity terms have a value of 1 at least: the penalty decides on them, not the
    chance of the sample.
    """
    ids, owner = _flat(features)
    toxic = labels[owner] > 0
    seen = np.bincount(ids[toxic], minlength=1 << bits)
    other = np.bincount(ids[~toxic], minlength=1 << bits)
    rows, others = (labels > 0).sum(), (labels <= 0).sum()
    prior = rows / max(1, others)
    odds = np.log((seen + prior) / rows) - np.log((other + 1) / others)
    z = odds / np.sqrt(1 / (seen + prior + 0.1) + 1 / (other + 1))
    values = np.where((z > EVIDENCE) & (seen >= SEEN), z, 0.0)
    terms = identity_features(bits)
    values[terms] = np.maximum(values[terms], 1.0)
    return values


class Objective:
    """The loss of weights over sparse rows: cross-entropy, counterfactual gap and L2.

    ``lost`` and ``gained`` are the features that a row's twin lacks and has besides.
    Features of value 0 cannot move a score and are left out.
    """

    def __init__(self, features, lost, gained, labels, row_weights, fairness: float = FAIRNESS, ridge: float = RIDGE, bits: int = BITS):
        self.n, self.labels, self.fairness, self.ridge = len(labels), labels, fairness, ridge
        self.share = row_weights / row_weights.sum()
        values = evidence(features, labels, bits)
        self.used = np.flatnonzero(values)
        self.values = values[self.used]
        self.rows, self.lost, self.gained = (self._kept(x) for x in (features, lost, gained))

    def _kept(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        ids, owner = _flat(rows)
        at = np.searchsorted(self.used, ids).clip(max=len(self.used) - 1)
        kept = self.used[at] == ids
        return at[kept], owner[kept]

    def _sum(self, v: np.ndarray, part: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return np.bincount(part[1], weights=v[part[0]], minlength=self.n)

    def _back(self, g: np.ndarray, part: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return np.bincount(part[0], weights=g[part[1]], minlength=len(self.used))

    def __call__(self, w: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
        """Loss, and its gradient by weights and bias."""
        v = w * self.values
        z = self._sum(v, self.rows) + bias
        gap = self._sum(v, self.lost) - self._sum(v, self.gained)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = (self.share * (np.logaddexp(0, z) - self.labels * z)).sum() + self.fairness * (self.share * gap * gap).sum() + self.ridge / 2 * (w * w).sum()
        pull, push = self.share * (p - self.labels), 2 * self.fairness * self.share * gap
        g = (self._back(pull, self.rows) + self._back(push, self.lost) - self._back(push, self.gained)) * self.values + self.ridge * w
        return float(loss), g, float(pull.sum())


def fit(features, lost, gained, labels, row_weights, bits: int = BITS, fairness: float = FAIRNESS, ridge: float = RIDGE, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights of all features and the bias, by full-batch Adam."""
    goal = Objective(features, lost, gained, labels, row_weights, fairness, ridge, bits)
    w, bias = np.zeros(len(goal.used)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        _, g, gb = goal(w, bias)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.1 / (1 - 0.9**step)
        w = w - rate * m / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        bias = bias - rate * mb / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    full = np.zeros(1 << bits, np.float32)
    full[goal.used] = w * goal.values
    return full, float(bias)


def held_out(id_col: Column) -> Column:
    """Rows that training never sees: crc32 of the id's text mod 4 is 2."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4 == 2


def _hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each training row's sparse features, and what its twin loses and gains."""
    for frame in frames:
        pairs = [counterfactual(t or "", zlib.crc32(str(i).encode())) for i, t in zip(frame["id"], frame["text"], strict=True)]
        ours, twins = list(word_features([a for a, _ in pairs])), list(word_features([b for _, b in pairs]))
        yield pd.DataFrame(
            {
                "id": frame["id"], "toxic": frame["toxic"], "weight": frame["weight"], "ids": ours,
                "lost": [np.setdiff1d(a, b) for a, b in zip(ours, twins, strict=True)],
                "gained": [np.setdiff1d(b, a) for a, b in zip(ours, twins, strict=True)],
            }
        )
        del frame, pairs, ours, twins
    give_back()


def _train(fairness: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        labels = frame["toxic"].to_numpy(float)
        if len(set(labels)) < 2:
            w, bias = np.zeros(1 << BITS, np.float32), float(-4.0 if not labels.any() else 4.0)
        else:
            w, bias = fit(*(list(frame[c]) for c in ("ids", "lost", "gained")), labels, frame["weight"].to_numpy(float), fairness=fairness)
        give_back()
        return pd.DataFrame({"weights": [w.tobytes()], "bias": [bias]})

    return run


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fairness: float = FAIRNESS
) -> tuple[np.ndarray, float]:
    """Fit on at most ``TRAIN_ROWS_PER_CLASS`` labelled rows of each class.

    Texts are hashed where they lie; the one task that fits gets feature numbers only.
    Rows whose label or id is null are not used; of an id's several labels the
    largest counts, of its several texts the least. Rows are weighted so that each class weighs what it does among
    all labelled rows. Without labelled rows the model scores everything 0.5, with
    one class alone near that class.
    """
    bounded_batches(docs.sparkSession)
    ids = (
        labels.where("toxic is not null and doc_id is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("__id"))
        .agg(F.max("toxic").alias("toxic"))
    )
    sizes = {bool(r[0]): r[1] for r in ids.groupBy(F.col("toxic") > 0).count().collect()}
    picked = None
    for toxic, rows in sizes.items():
        part = (
            ids.where(F.col("toxic") > 0 if toxic else F.col("toxic") <= 0)
            .orderBy(F.xxhash64("__id"), "__id")
            .limit(TRAIN_ROWS_PER_CLASS)
            .select("__id", F.lit(int(toxic)).alias("toxic"), F.lit(rows / min(rows, TRAIN_ROWS_PER_CLASS)).alias("weight"))
        )
        picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        return np.zeros(1 << BITS, np.float32), 0.0
    # At most 2 * TRAIN_ROWS_PER_CLASS rows of three numbers.
    sample = F.broadcast(materialize(picked, "toxic-sample"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(
        sample, F.col("id") == F.col("__id")
    )
    texts = rows.groupBy("id", "toxic", "weight").agg(F.min("text").alias("text"))
    sparse = texts.mapInPandas(_hashed, "id long, toxic int, weight double, ids array<long>, lost array<long>, gained array<long>")
    model = sparse.groupBy().applyInPandas(_train(fairness), "weights binary, bias double").first()
    if model is None:
        return np.zeros(1 << BITS, np.float32), 0.0
    return np.frombuffer(model["weights"], np.float32), model["bias"]


def _scorer(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, fairness: float) -> Column:
    """The fitted score as an expression of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, fairness))

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, b = shared.value
        for texts in parts:
            z = np.array([w[ids].sum(dtype=np.float64) for ids in word_features(texts.tolist())] or [], float) + b
            del texts
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        give_back()

    return F.pandas_udf(run, "double")(F.col(text_col))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, fairness: float = FAIRNESS
) -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``held_out``.

    Null and empty texts get the score of a text without words; very long texts are
    scored whole. Ids may be null (never held out) or repeat; input columns of the
    three names are replaced, all others kept. An empty table gives no rows.
    """
    score = _scorer(docs, labels, id_col, text_col, fairness)
    return (
        docs.drop("score", "predicted", "held_out")
        .withColumn("score", score)
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
        .withColumn("held_out", F.coalesce(held_out(F.col(id_col)), F.lit(False)))
    )


def drop_toxic(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, fairness: float = FAIRNESS
) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject; columns and rows as they are.

    Null and empty texts, null and repeated ids and columns of any name are allowed;
    rows with equal texts share their fate. An empty table gives no rows.
    """
    return docs.where(_scorer(docs, labels, id_col, text_col, fairness) < threshold)
