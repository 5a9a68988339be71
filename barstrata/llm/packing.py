"""Bounded-space online packing of token ids into fixed-length sequences.

Every partition keeps at most ``open_windows`` unfinished windows. A document's
whole windows go out at once; its rest is placed best-fit into the fullest window
that holds it. When none does, the fullest window goes out: if it lacks more than
``pad`` ids, the piece is cut to fill it and its own rest is placed again. What a
partition leaves open is first joined within the partition; only a single unfinished
window of each is passed on, and those are merged by the same rule in a tree, a few
thousand partitions a step, so no task ever gets more than that many windows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize
from .kernels import give_back

#: The id that ends every document.
END = 1
#: Partitions whose leftovers one merging task takes, 8 KB each.
FAN_IN = 1024
#: Words kept with their ids by one Python worker.
_CACHE_WORDS = 600_000
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SENTINEL = "~"
#: Words whose ids can be put together from those of their letters and their end.
_LETTERS = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)")
#: Words by which a tokenizer shows that it is so, with every such letter.
_PROBES = ["the", "Of", "zzqx", "a" * 40, "strengthening", *(f"na{chr(c)}ve" for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))]
_UNSAFE = re.compile(r"[\x1c-\x1f\x85]|<\|")


class WordEncoder:
    """Texts to little-endian 32-bit ids, by words that are encoded once each.

    It holds for tokenizers that drop white space and never join ids over it; the
    tests compare it with encoding whole texts. Texts with rare separators or
    special tokens are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self._tokenizer = Tokenizer.from_file(path)
        self._known: dict[str, bytes] = {}
        mark = self._ids(_SENTINEL)
        self._mark = mark[0] if len(mark) == 1 else None
        self._model = self._tokenizer.model
        alphabet = ByteLevel(add_prefix_space=False, use_regex=False)
        self._bytes = {ord(c): alphabet.pre_tokenize_str(c)[0][0] for c in "".join(_PROBES).lower() if not c.isascii()}
        # Whether the model alone gives a word of letters its ids, and ends of words theirs.
        self._plain = all(self._letters(w.lower()) == self._pack(self._ids(w)) for w in _PROBES) and all(
            self._ids(f"the{e}") == self._ids("the") + self._ids(e) for e in (".", ",", "!?", ".!!")
        )

    def _ids(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def _letters(self, word: str) -> bytes:
        """Ids of a lower-cased word of Latin letters, by the model without the steps before it."""
        return self._pack([t.id for t in self._model.tokenize(word if word.isascii() else word.translate(self._bytes))])

    def _split(self, words: list[str]) -> list[str]:
        """Learn words of letters, with or without an end of a sentence; the others come back."""
        known, rest = self._known, []
        for w in words:
            parts = _LETTERS.fullmatch(w)
            if parts is None:
                rest.append(w)
                continue
            core, end = parts[1].lower(), parts[2]
            ids = known.get(core)
            if ids is None:
                ids = known[core] = self._letters(core)
            if end:
                if end not in known:
                    known[end] = self._pack(self._ids(end))
                ids += known[end]
            known[w] = ids
        return rest

    def _learn(self, words: list[str]) -> None:
        if self._plain:
            words = self._split(words)
        plain = [w for w in words if _SENTINEL not in w] if self._mark is not None else []
        for at in range(0, len(plain), 256):
            part = plain[at : at + 256]
            ids = np.array(
                self._tokenizer.encode_batch_fast([f" {_SENTINEL} ".join(part)], add_special_tokens=False)[0].ids,
                np.uint32,
            )
            cuts = np.flatnonzero(ids == self._mark)
            if len(cuts) != len(part) - 1:
                continue
            begin = np.concatenate(([0], cuts + 1)) * 4
            end = np.concatenate((cuts, [len(ids)])) * 4
            raw = ids.tobytes()
            self._known.update((w, raw[a:b]) for w, a, b in zip(part, begin.tolist(), end.tolist(), strict=True))
        for w in words:
            if w not in self._known:
                self._known[w] = np.array(self._ids(w), np.uint32).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [None if _UNSAFE.search(t) else t.split() for t in texts]
        if len(self._known) > _CACHE_WORDS:
            self._known.clear()
        known = self._known
        new = set().union(*(words for words in split if words)).difference(known)
        if new:
            self._learn(sorted(new))
        return [
            np.array(self._ids(t), np.uint32).tobytes() if words is None else b"".join(map(known.__getitem__, words))
            for t, words in zip(texts, split, strict=True)
        ]


class Window:
    """Pieces of one sequence; a piece is (doc, start, ids, all ids of the document)."""

    __slots__ = ("pieces", "used")

    def __init__(self):
        self.pieces: list[tuple] = []
        self.used = 0

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        self.pieces.append((doc, start, ids, total))
        self.used += len(ids) // 4


class Packer:
    """The online rule; finished windows come out of ``add`` and ``finish``."""

    def __init__(self, size: int, open_windows: int, pad: int):
        self.size, self.most, self.pad = size, open_windows, pad
        self.open: list[Window] = []

    def _place(self, doc, start: int, ids: bytes, total: int) -> Iterator[Window]:
        while ids:
            n = len(ids) // 4
            fits = [w for w in self.open if w.used + n <= self.size]
            if fits:
                best = max(fits, key=lambda w: w.used)
                best.add(doc, start, ids, total)
                if best.used == self.size:
                    self.open.remove(best)
                    yield best
                return
            if len(self.open) < self.most:
                fresh = Window()
                self.open.append(fresh)
                continue
            fullest = max(self.open, key=lambda w: w.used)
            lack = self.size - fullest.used
            self.open.remove(fullest)
            if lack > self.pad:
                fullest.add(doc, start, ids[: 4 * lack], total)
                start, ids = start + lack, ids[4 * lack :]
            yield fullest

    def add(self, doc, start: int, ids: bytes, total: int) -> Iterator[Window]:
        """Place a document's ids, whole windows first."""
        while len(ids) >= 4 * self.size:
            whole = Window()
            whole.add(doc, start, ids[: 4 * self.size], total)
            start, ids = start + self.size, ids[4 * self.size :]
            yield whole
        yield from self._place(doc, start, ids, total)

    def finish(self) -> Iterator[Window]:
        """Join what is open; at most the last window that comes out lacks ids."""
        rest = sorted(self.open, key=lambda w: -w.used)
        self.open, gathered = [], Window()
        for window in rest:
            for doc, start, ids, total in window.pieces:
                while ids:
                    n = min(self.size - gathered.used, len(ids) // 4)
                    gathered.add(doc, start, ids[: 4 * n], total)
                    start, ids = start + n, ids[4 * n :]
                    if gathered.used == self.size:
                        yield gathered
                        gathered = Window()
        if gathered.used:
            yield gathered


def _rows(window: Window, sequence: int, keep_ids: bool) -> Iterator[tuple]:
    offset = 0
    for doc, start, ids, total in window.pieces:
        n = len(ids) // 4
        yield doc, start, n, zlib.crc32(ids), total, sequence, offset, ids if keep_ids else None
        offset += n


_NAMES = [c.split()[0] for c in _PIECES.split(", ")] + ["ids"]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_NAMES)
    return out.astype({c: "Int64" for c in _NAMES[:1]} | {c: "int64" for c in _NAMES[1:-1]})


def _pack_partition(path: str, size: int, open_windows: int, pad: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        encode, packer, made, rows = WordEncoder(path), Packer(size, open_windows, pad), part << 32, []
        end = np.array([END], np.uint32).tobytes()
        for frame in frames:
            docs, texts = frame["doc_id"].tolist(), [t or "" for t in frame["text"]]
            for at in range(0, len(texts), 200):
                for doc, ids in zip(docs[at : at + 200], encode(texts[at : at + 200]), strict=True):
                    ids += end
                    for window in packer.add(None if pd.isna(doc) else int(doc), 0, ids, len(ids) // 4):
                        rows += _rows(window, made, False)
                        made += 1
                if len(rows) > 5000:
                    yield _frame(rows)
                    rows = []
            del frame, docs, texts
        for window in packer.finish():
            rows += _rows(window, made, window.used < size)
            made += 1
        if rows:
            yield _frame(rows)
        del encode, packer, rows
        give_back()

    return run


def _merge(size: int, open_windows: int, pad: int, level: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["sequence_id", "offset"], kind="stable")
        # The lowest partition of the group names its sequences, above all that it made.
        part = int(frame["sequence_id"].iloc[0]) >> 32
        packer, rows, made = Packer(size, open_windows, pad), [], (part << 32) | (level << 26)
        for x in frame.itertuples(index=False):
            for window in packer.add(None if pd.isna(x.doc_id) else int(x.doc_id), int(x.start), bytes(x.ids), int(x.doc_tokens)):
                rows += _rows(window, made, False)
                made += 1
        for window in packer.finish():
            rows += _rows(window, made, window.used < size)
            made += 1
        return _frame(rows)

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 2048,
    open_windows: int = 64,
    pad: int = 16,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone. Texts longer than ``size`` fill whole
    windows. Rows with a null or repeated id are packed one by one under that id. An
    empty table gives no rows. Other columns are not read. ``tokenizer_path`` must
    name the same file on every executor. A sequence lacks at most ``pad`` ids, but
    for the very last one.
    """
    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"{_PIECES}, ids binary"
    made = materialize(narrow.mapInPandas(_pack_partition(tokenizer_path, size, open_windows, pad), schema), "packed")
    done, level = [], 0
    while True:
        done.append(made.where("ids is null").drop("ids"))
        left = made.where("ids is not null")
        parts = left.agg(F.countDistinct("sequence_id")).first()[0]
        if parts <= 1:
            return _union(done + [left.drop("ids")])
        level += 1
        group = F.floor(F.shiftright("sequence_id", 32) / F.lit(FAN_IN**level))
        merged = left.groupBy(group.alias("__group")).applyInPandas(_merge(size, open_windows, pad, level), schema)
        made = materialize(merged, "packed-left")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
