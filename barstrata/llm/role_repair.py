"""Repair of conversations by weighted finite-state composition.

Three machines are composed: a conversation's rows (an acceptor with one arc a row), the
edits (a transducer: keep, change the role, delete, insert) and the grammar of roles (an
acceptor). Weights are pairs of cost and label string, added by concatenation and compared
in order. Composed states are pairs of a row's place and a grammar state; only arcs that
leave a reached state are made. Places are a topological order, and within a place the
number of insertions is, as no path gains by coming back to a grammar state.

No label string of as many rows is a proper prefix of another of the same cost, since each
ends with the edit of its last row; so comparing prefixes decides as whole strings do, and
the machine can be cut anywhere. Rows are sorted by range over all tasks and cut into
slices; a slice becomes the matrix of its best weights between grammar states. Matrices of
a conversation are multiplied in order with the strings replaced by their ranks, which
tells each slice's path. So a long conversation is spread over tasks. Only its text's
running hash and its label string are made in one, row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: Grammar of role initials, (s?(ua)+)?: arcs of each state, its start and final states.
ARCS: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
START, FINAL = 0, (0, 3)
STATES = range(len(ARCS))
#: Costs of the edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Roles that can be given or inserted, by initial.
GIVEN = {"u": "user", "a": "assistant"}
#: Rows in a slice.
SLICE_ROWS = 1024
SPACE = " \t\n\x0b\x0c\r"

# Ids and turns reach Python as strings: a nullable long would become a double there.
_SLICES = (
    "conv_id string, slice long, costs array<int>, ranks array<int>, labels array<string>, blank long, duplicate long, truncated long, "
    "illegal long, first string, last string, low string, high string, first_turn string, last_turn string, turns long"
)
_SUMMARY = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_OUT = f"{_SUMMARY}, repaired_sha256 string"

Weight = tuple[int, str]


@cache
def insertions(state: int) -> tuple[tuple[int, Weight], ...]:
    """(state, weight) reached from ``state`` by insertions alone, no state twice."""
    reached: dict[int, Weight] = {state: (0, "")}
    queue = [state]
    for here in queue:
        cost, labels = reached[here]
        for initial, there in ARCS[here].items():
            if initial in GIVEN and there not in reached:
                reached[there] = (cost + INSERT, labels + "I")
                queue.append(there)
    return tuple(reached.items())


@cache
def row_arcs(state: int, initial: str, fault: str) -> tuple[tuple[int, int, str], ...]:
    """Composed arcs of one row from ``state``: (next state, cost, labels), the best of each.

    ``fault`` is "drop" for a row that must go, "cut" for a truncated one, else "".
    """
    best: dict[int, Weight] = {}
    for here, (cost, labels) in insertions(state):
        edits = [(here, DELETE, "D")]
        if fault != "drop":
            stays = TRUNCATED if fault == "cut" else 0
            edits += [(there, KEEP + stays, "K") for x, there in ARCS[here].items() if x == initial]
            edits += [(there, REROLE + stays, "R") for x, there in ARCS[here].items() if x in GIVEN]
        for there, more, label in edits:
            weight = (cost + more, labels + label)
            if there not in best or weight < best[there]:
                best[there] = weight
    return tuple((there, cost, labels) for there, (cost, labels) in best.items())


def _extend(front: dict[int, tuple[int, int]], arcs) -> tuple[dict[int, tuple[int, int]], dict[int, tuple[int, str]]]:
    """One topological step: state to (cost, rank of its string) before and after.

    Also each state's way back: (state before, labels).
    """
    best: dict[int, tuple[int, int, str, int]] = {}
    for here, (cost, rank) in front.items():
        for there, more, labels in arcs(here):
            found = (cost + more, rank, labels, here)
            if there not in best or found < best[there]:
                best[there] = found
    order = {key: k for k, key in enumerate(sorted({(rank, labels) for _, rank, labels, _ in best.values()}))}
    after = {s: (cost, order[rank, labels]) for s, (cost, rank, labels, _) in best.items()}
    return after, {s: (here, labels) for s, (_, _, labels, here) in best.items()}


def slice_paths(rows: list[tuple[str, str, int]]) -> dict[tuple[int, int], Weight]:
    """The best weight between each pair of grammar states over (initial, fault, count) rows."""
    out = {}
    for start in STATES:
        front, ways = {start: (0, 0)}, []
        for initial, fault, count in rows:
            front, back = _extend(front, lambda s, i=initial, f=fault: row_arcs(s, i, f))
            ways.append((back, count - 1))
            # Repeats of a row are duplicates: they go, without a change of state or order.
            if count > 1:
                front = {s: (cost + DELETE * (count - 1), rank) for s, (cost, rank) in front.items()}
        for end, (cost, _) in front.items():
            labels, here = [], end
            for back, more in reversed(ways):
                labels.append("D" * more)
                here, step = back[here]
                labels.append(step)
            out[start, end] = (cost, "".join(reversed(labels)))
    return out


def _slice(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Slices of the sorted rows of one task; a slice is of one conversation."""
    number = TaskContext.get().partitionId() << 40
    names = [c.split()[0] for c in _SLICES.split(", ")]
    held: list[tuple] = []

    def finish() -> tuple:
        nonlocal number
        paths = slice_paths([(x[2], "drop" if x[3] in ("blank", "duplicate") else "cut" if x[3] == "truncated" else "", x[4]) for x in held])
        order = {w: k for k, w in enumerate(sorted({labels for _, labels in paths.values()}))}
        pairs = [paths.get((a, b)) for a in STATES for b in STATES]
        count = {"blank": 0, "duplicate": 0, "truncated": 0}
        illegal, turns, before, last_turn = 0, 0, None, None
        for _, turn, initial, fault, n in held:
            if fault:
                count[fault] += 1
            count["blank" if fault == "blank" else "duplicate"] += n - 1
            illegal += (n - 1) * (initial + initial not in LEGAL) + (before is not None and before + initial not in LEGAL)
            turns += turn is not None and turn != last_turn
            before, last_turn = initial, turn
        known = [x[1] for x in held if x[1] is not None]
        number += 1
        return (
            held[0][0], number, [-1 if p is None else p[0] for p in pairs], [-1 if p is None else order[p[1]] for p in pairs],
            [None if p is None else p[1] for p in pairs], count["blank"], count["duplicate"], count["truncated"], illegal,
            held[0][2], held[-1][2], *(None if t is None else str(t) for t in (
                min(known, default=None), max(known, default=None), held[0][1], held[-1][1],
            )), turns,
        )

    def table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names)

    for frame in frames:
        done = []
        for conv, turn, initial, fault, n in zip(*(frame[c] for c in ("conv_id", "turn", "initial", "fault", "n")), strict=True):
            row = (conv, None if turn is None else int(turn), initial, fault, int(n))
            if held and (held[0][0] != row[0] or len(held) == size):
                done.append(finish())
                held = []
            held.append(row)
        if done:
            yield table(done)
    if held:
        yield table([finish()])


#: Pairs of adjacent role initials that are in order.
LEGAL = {"su", "ua", "au"}


def _join_slices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a conversation from its slices, which come in order."""
    names = [c.split()[0] for c in _SUMMARY.split(", ")]
    held: dict | None = None

    def begin(conv) -> dict:
        return {"conv": conv, "front": {START: (0, 0)}, "ways": [], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0,
                "last": None, "low": None, "high": None, "last_turn": None, "turns": 0}

    def add(s: dict, x) -> None:
        k = len(STATES)

        def arcs(here: int):
            return [(b, x.costs[here * k + b], x.ranks[here * k + b]) for b in STATES if x.costs[here * k + b] >= 0]

        s["front"], back = _extend(s["front"], arcs)
        # Only the labels of ways that some state still uses: one from each.
        s["ways"].append({end: (here, x.labels[here * k + end]) for end, (here, _) in back.items()})
        for name in ("blank", "duplicate", "truncated", "illegal"):
            s[name] += int(getattr(x, name))
        s["illegal"] += s["last"] is not None and s["last"] + x.first not in LEGAL
        s["last"] = x.last
        first, last = (None if t is None else int(t) for t in (x.first_turn, x.last_turn))
        s["turns"] += int(x.turns) - (first is not None and first == s["last_turn"])
        s["last_turn"] = last
        if x.low is not None:
            s["low"] = int(x.low) if s["low"] is None else min(s["low"], int(x.low))
            s["high"] = int(x.high) if s["high"] is None else max(s["high"], int(x.high))

    def finish(s: dict) -> tuple:
        tails = [
            (cost + more, rank, labels, here)
            for here, (cost, rank) in s["front"].items()
            for there, (more, labels) in insertions(here)
            if there in FINAL
        ]
        cost, _, tail, here = min(tails)
        parts = [tail]
        for way in reversed(s["ways"]):
            here, labels = way[here]
            parts.append(labels)
        gaps = 0 if s["low"] is None else s["high"] - s["low"] + 1 - s["turns"]
        return s["conv"], gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], cost, "".join(reversed(parts))

    def table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names)

    for frame in frames:
        done = []
        for x in frame.itertuples(index=False):
            if held is None or held["conv"] != x.conv_id:
                if held is not None:
                    done.append(finish(held))
                held = begin(x.conv_id)
            add(held, x)
        if done:
            yield table(done)
    if held is not None:
        yield table([finish(held)])


class _Rebuilt:
    """A conversation's summary and the running hash of its repaired rows."""

    def __init__(self, conv, summary: tuple | None):
        self.conv, self.summary = conv, summary or (0, 0, 0, 0, 0, 0, "")
        self.audit, self.at, self.state = self.summary[-1], 0, START
        self.hash, self.empty = hashlib.sha256(), True

    def _put(self, initial: str, role: str, text: str) -> None:
        self.state = ARCS[self.state][initial]
        self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.empty = False

    def _give(self, text: str) -> None:
        (initial,) = [x for x in ARCS[self.state] if x in GIVEN]
        self._put(initial, GIVEN[initial], text)

    def _insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._give("")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._insert()
        label = self.audit[self.at]
        self.at += 1
        if label == "K":
            self._put(role[:1], role, text)
        elif label == "R":
            self._give(text)

    def finish(self) -> tuple:
        self._insert()
        return self.conv, *self.summary, self.hash.hexdigest()


def _rebuild(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _OUT.split(", ")]
    held: _Rebuilt | None = None
    fields = names[1:-1]

    def table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names)

    for frame in frames:
        done = []
        heads = list(zip(*(frame[f] for f in fields), strict=True))
        for k, (conv, kind, role, text) in enumerate(zip(*(frame[c] for c in ("conv_id", "kind", "role", "text")), strict=True)):
            if kind == 0:
                if held is not None:
                    done.append(held.finish())
                summary = None if heads[k][-1] is None else (*(int(v) for v in heads[k][:-1]), heads[k][-1])
                held = _Rebuilt(conv, summary)
            else:
                held.row(role, text)
        if done:
            yield table(done)
    if held is not None:
        yield table([held.finish()])


def damaged(conversations: DataFrame, rate: int = 20) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that a row's key decides.

    By crc32("conv_id:turn") modulo ``rate``: 0 drops the row, 1 empties its text, 2 takes
    out its sentence ends, 3 repeats it, 4 makes its role user. Nulls are read as one space.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary"))
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), (key % rate).alias("damage"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (
        rows.where("damage <> 0")
        .withColumns({"text": text, "role": F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))})
        .withColumn("again", F.explode(F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select("conv_id", "turn", "role", "text")
    )


def repair_conversations(rows: DataFrame, every: DataFrame | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """A row for each conversation of ``rows`` (conv_id, turn, role, text): its faults, the
    cheapest edits that bring its roles in order, and the sha256 of the repaired rows.

    Rows are taken by turn, nulls first, then by role and text digest. Null roles and texts
    are read as one space; a role's initial must be one of the grammar's for the row to be
    kept. ``every`` may name more conversations (conv_id); those without rows give zeros, an
    empty audit and the hash of nothing. A null conversation id is a conversation. Repeated
    rows are duplicates but for the first. Texts of any length are hashed as they come.
    An empty table gives no rows; other columns are not read.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    every = rows.select("conv_id").distinct() if every is None else every.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    order: list[str | Column] = ["conv_id", "turn", "role", "digest"]
    keyed = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    trimmed = F.rtrim("text", F.lit(SPACE))
    # Repeated rows are one with a count before anything is shuffled.
    runs = (
        keyed.withColumns({"blank": trimmed == "", "ends": F.right(trimmed, F.lit(1)).isin(*".!?")})
        .groupBy(*order)
        .agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("ends").alias("ends"))
    )
    runs = materialize(runs, "runs")
    # A text's first turn in its conversation: small rows, summed before the shuffle.
    first = runs.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("at"))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("at.turn").alias("first_turn"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    fault = (
        F.when(F.col("blank"), "blank")
        .when(~F.col("turn").eqNullSafe(F.col("first_turn")), "duplicate")
        .when(~F.col("ends"), "truncated")
        .otherwise("")
    )
    told = runs.join(first, same).select(*order, F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "n")
    ranged = told.repartitionByRange(*order).sortWithinPartitions(*order)
    name = lambda c: F.col(c).cast("string").alias(c)
    narrow = ranged.select(name("conv_id"), name("turn"), "initial", "fault", "n")
    slices = narrow.mapInPandas(lambda frames: _slice(frames, slice_rows), _SLICES)
    whole = slices.repartition("conv_id").sortWithinPartitions("conv_id", "slice")
    summary = whole.mapInPandas(_join_slices, _SUMMARY)
    fields = [c.split()[0] for c in _SUMMARY.split(", ")][1:]
    conv = F.col("conv_id").eqNullSafe(F.col("c"))
    summary = summary.withColumn("c", F.col("conv_id").cast("long")).drop("conv_id")
    heads = every.join(summary, conv, "left").drop("c").withColumn("kind", F.lit(0))
    texts = keyed.withColumn("kind", F.lit(1))
    both = heads.unionByName(texts, allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    out = ordered.select(name("conv_id"), "kind", "role", "text", *fields).mapInPandas(_rebuild, _OUT)
    out = materialize(out.withColumn("conv_id", F.col("conv_id").cast("long")), "repaired")
    release(spark, runs)
    return out
