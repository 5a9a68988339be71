"""Hard-negative mining by bit-sliced integer products.

Vectors become integers. Anchors, a stated query set, are packed into blocks; a bounded
group of blocks is broadcast, and every task meets it with its own rows, batch by batch.
A batch's components are cut into bit-planes. The planes are multiplied with the anchors
from the most significant one down; after each, a score is known to lie in an interval
that the planes still missing can fill, and pairs whose interval cannot reach the anchor's
bound any more are dropped. While most pairs live, a plane is one matrix product of the
whole batch; after that only the living pairs are multiplied. Pairs that see the last
plane have exact scores.

Each task keeps the best few rows an anchor and window, so that only those are shuffled;
the bound of an anchor rises with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release

#: Anchors in a packed block, and blocks in one pass over the rows (some 16 MB at 64 components).
BLOCK_ANCHORS, BLOCKS_PER_PASS = 2048, 16
#: Rows of a batch that meet a block at once.
BATCH_ROWS = 2048
#: Below this share of living pairs they are multiplied one by one.
SPARSE_SHARE = 0.15
#: Stands for a null id, which comes last among ties.
_NO_ID = 2**63 - 1
_NEVER = -(2**62)

_ANCHORS = "n int, width int, first long, ids binary, labels binary, matrix binary"
_HITS = "anchor long, slot int, id long, score long"


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, label: Column | None) -> DataFrame:
    """(id, label, q): rows that take part, each component as floor(256 x)."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * 256).cast("long"))
    return vectors.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"),
        (F.col(label_col) if label is None else label).cast("long").alias("label"),
        whole.alias("q"),
    )


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as one matrix; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    most = max(int(sizes.max(initial=0)), width or 0, 1)
    if len(sizes) and (sizes == most).all():
        return values.reshape(len(sizes), most)
    out = np.zeros((len(sizes), most), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _widen(matrix: np.ndarray, width: int) -> np.ndarray:
    return matrix if matrix.shape[1] == width else np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def _pack_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 40
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ANCHORS):
            part = batch.slice(at, BLOCK_ANCHORS)
            matrix = _matrix(part.column("q"))
            row = {
                "n": matrix.shape[0], "width": matrix.shape[1], "first": first,
                "ids": part.column("id").to_numpy().tobytes(), "labels": part.column("label").to_numpy().tobytes(),
                "matrix": matrix.tobytes(),
            }
            first += matrix.shape[0]
            yield pa.RecordBatch.from_pylist([row], pa.schema([
                ("n", pa.int32()), ("width", pa.int32()), ("first", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("matrix", pa.binary()),
            ]))


class Block:
    """A block of anchors with their score windows and the best rows met so far."""

    def __init__(self, row, windows: dict[int, list[tuple[int, int]]] | None, keep: int):
        self.n, self.first, self.keep = row["n"], row["first"], keep
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.labels = np.frombuffer(row["labels"], np.int64)
        self.matrix = np.frombuffer(row["matrix"], np.int64).reshape(self.n, row["width"])
        if windows is None:
            slots, self.lows, self.highs = 1, np.full((self.n, 1), _NEVER), np.full((self.n, 1), -_NEVER)
        else:
            mine = [windows.get(self.first + k, []) for k in range(self.n)]
            slots = max((len(w) for w in mine), default=0) or 1
            # A missing window is empty: its low lies above its high.
            self.lows, self.highs = np.full((self.n, slots), -_NEVER), np.full((self.n, slots), _NEVER)
            for k, found in enumerate(mine):
                for s, (low, high) in enumerate(found):
                    self.lows[k, s], self.highs[k, s] = low, high
        self.slots = slots
        self.worst = self.lows.copy()  # a slot's least score that can still enter
        empty = np.zeros(0, np.int64)
        self.best = (empty, empty, empty)  # anchor * slots + slot, id, score

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Each anchor's least and greatest score of use."""
        return self.worst.min(1), self.highs.max(1)

    def take(self, anchor: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Enter exact scores and keep each slot's best."""
        lane, who, score = [self.best[0]], [self.best[1]], [self.best[2]]
        for s in range(self.slots):
            fits = (scores >= self.worst[anchor, s]) & (scores <= self.highs[anchor, s])
            lane.append(anchor[fits] * self.slots + s)
            who.append(ids[fits])
            score.append(scores[fits])
        lane, who, score = np.concatenate(lane), np.concatenate(who), np.concatenate(score)
        order = np.lexsort((who, -score, lane))
        lane, who, score = lane[order], who[order], score[order]
        starts = np.flatnonzero(np.concatenate(([True], lane[1:] != lane[:-1]))) if len(lane) else np.zeros(0, int)
        rank = np.arange(len(lane)) - np.repeat(starts, np.diff(np.append(starts, len(lane))))
        self.best = tuple(x[rank < self.keep] for x in (lane, who, score))
        last = rank == self.keep - 1
        self.worst[lane[last] // self.slots, lane[last] % self.slots] = score[last]


def _exact(anchors: np.ndarray, rows: np.ndarray) -> type:
    """The narrowest type in which every partial product of the planes is exact.

    The planes' partial sums stay below width * |a| * 2 ** (bits + 1).
    """
    most = rows.shape[1] * float(np.abs(anchors).max(initial=0)) * 4 * max(float(np.abs(rows).max(initial=0)), 1.0)
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def survivors(
    anchors: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, allowed: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs whose score lies in the anchor's [low, high].

    A component is its sign plane times -2 ** bits plus its lower planes. With planes
    above ``j`` done, the rest of a component is 0 to 2 ** j - 1, so a score lies between
    the sum so far less (2 ** j - 1) times the anchor's negative components and the same
    plus its positive ones.
    """
    exact = _exact(anchors, rows)
    bits = max(int(max(rows.max(initial=0), -1 - rows.min(initial=0))).bit_length(), 1)
    up = np.maximum(anchors, 0).sum(1)
    down = np.maximum(-anchors, 0).sum(1)
    a = anchors.astype(exact)

    def plane(j: int, of: np.ndarray) -> np.ndarray:
        return (of < 0) if j == bits else ((of >> j) & 1).astype(bool)

    def weight(j: int) -> int:
        return -(1 << j) if j == bits else 1 << j

    total = np.zeros((len(anchors), len(rows)), exact)
    live = np.ones(total.shape, bool) if allowed is None else allowed
    j = bits
    while j >= 0:
        total += (a * weight(j)) @ plane(j, rows).astype(exact).T
        rest = (1 << j) - 1
        live = live & (total >= (low - up * rest)[:, None]) & (total <= (high + down * rest)[:, None])
        j -= 1
        columns = live.any(0)
        if not columns.any():
            none = np.zeros(0, np.int64)
            return none, none, none
        if np.count_nonzero(live) < SPARSE_SHARE * live.size:
            break
    x, y = np.nonzero(live)
    score = total[x, y].astype(np.int64)
    del total, live
    while j >= 0 and len(x):
        keep_x, keep_y, keep_score = [], [], []
        for at in range(0, len(x), 65536):
            px, py = x[at : at + 65536], y[at : at + 65536]
            chosen = np.where(plane(j, rows[py]), anchors[px], 0)
            s = score[at : at + 65536] + weight(j) * chosen.sum(1)
            rest = (1 << j) - 1
            ok = (s >= low[px] - up[px] * rest) & (s <= high[px] + down[px] * rest)
            keep_x.append(px[ok])
            keep_y.append(py[ok])
            keep_score.append(s[ok])
        x, y, score = np.concatenate(keep_x), np.concatenate(keep_y), np.concatenate(keep_score)
        j -= 1
    return x, y, score


def _meet(block: Block, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, same: bool) -> None:
    """One block of anchors against one batch of rows, by label."""
    width = max(block.matrix.shape[1], rows.shape[1])
    matrix, rows = _widen(block.matrix, width), _widen(rows, width)
    if same:
        for label in np.intersect1d(block.labels, labels):
            mine, theirs = np.flatnonzero(block.labels == label), np.flatnonzero(labels == label)
            low, high = (x[mine] for x in block.bounds())
            other = block.ids[mine][:, None] != ids[theirs][None, :]
            x, y, score = survivors(matrix[mine], rows[theirs], low, high, other)
            block.take(mine[x], ids[theirs[y]], score)
    else:
        low, high = block.bounds()
        wanted = np.flatnonzero(low <= high)
        if len(wanted):
            other = block.labels[wanted][:, None] != labels[None, :]
            x, y, score = survivors(matrix[wanted], rows, low[wanted], high[wanted], other)
            block.take(wanted[x], ids[y], score)


def _search(shared, same: bool, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, windows = shared.value
        blocks = [Block(row, windows, keep) for row in packed]
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                ids, labels, rows = part.column("id").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("q"))
                for block in blocks:
                    _meet(block, ids, labels, rows, same)
        for block in blocks:
            lane, who, score = block.best
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.first + lane // block.slots), pa.array((lane % block.slots).astype(np.int32)), pa.array(who), pa.array(score)],
                names=["anchor", "slot", "id", "score"],
            )

    return run


def _best(hits: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    label: Column | None = None,
    positives: int = 5,
    negatives: int = 5,
    floor_percent: int = 80,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are the ``positives`` rows of its label with the highest integer
    inner product; for each, the ``negatives`` best rows of another label whose score is at
    least ``floor_percent`` of the positive's and not above it. Ties go to the smaller id.
    ``is_anchor`` is a condition on ``id_col``, ``label`` replaces the label column's values.

    Rows with a null label, a null vector or a null or non-finite component take no part.
    A null id comes after all others in ties. Rows that repeat an id are rows of their own;
    none is a positive of an anchor with its id. A vector shorter than another counts
    as ending in zeros, an empty one scores 0. Anchors without a positive, or without a
    negative in range, give no rows, nor does an empty table. Other columns are not read.
    Scores must fit a long.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_col, vector_col, label_col, label)
    chosen = integer_vectors(vectors.where(is_anchor), id_col, vector_col, label_col, label)
    blocks = materialize(chosen.mapInArrow(_pack_anchors, _ANCHORS), "anchors")
    found: DataFrame | None = None
    group: list[dict] = []

    def one_pass() -> DataFrame:
        names = {row["first"] + k: int(i) for row in group for k, i in enumerate(np.frombuffer(row["ids"], np.int64))}
        first = spark.sparkContext.broadcast((group.copy(), None))
        hits = _best(rows.mapInArrow(_search(first, True, positives), _HITS), positives)
        likes: dict[int, list[tuple[int, int]]] = {}
        for x in hits.orderBy("anchor", "rank").collect():  # a few rows an anchor of the pass
            likes.setdefault(x["anchor"], []).append((x["id"], x["score"]))
        windows = {
            anchor: [(-(-floor_percent * score // 100), score) for _, score in near] for anchor, near in likes.items()
        }
        second = spark.sparkContext.broadcast((group.copy(), windows))
        near = _best(rows.mapInArrow(_search(second, False, negatives), _HITS), negatives)
        pairs = spark.createDataFrame(
            [(anchor, slot, names[anchor], i, score) for anchor, near in likes.items() for slot, (i, score) in enumerate(near)],
            "anchor long, slot int, anchor_id long, positive_id long, positive_score long",
        )
        known = lambda c: F.when(F.col(c) != _NO_ID, F.col(c)).alias(c)
        out = near.join(pairs, ["anchor", "slot"]).withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).select(
            known("anchor_id"), known("positive_id"), F.col("rank").cast("int").alias("rank"), known("negative_id"), "positive_score", "negative_score"
        )
        out = materialize(out, "negatives")
        first.unpersist()
        second.unpersist()
        return out

    for row in blocks.toLocalIterator():
        group.append(row.asDict())
        if len(group) == BLOCKS_PER_PASS:
            part, group = one_pass(), []
            found = part if found is None else found.unionByName(part)
    if group or found is None:
        part = one_pass()
        found = part if found is None else found.unionByName(part)
    release(spark, blocks)
    return found


#: The query's result by comparing every anchor with every row.
SQL = """WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id,
    list_sum(list_transform(list_zip(a.q, r.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a, v r WHERE a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
pos AS (
  SELECT * FROM p WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM (
  SELECT pos.anchor_id, pos.vec_id AS positive_id, n.vec_id AS negative_id, pos.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY pos.anchor_id, pos.vec_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM pos JOIN p n ON n.anchor_id = pos.anchor_id AND NOT n.same
    AND 80 * pos.score <= 100 * n.score AND 100 * n.score <= 100 * pos.score)
WHERE rank <= 5"""
