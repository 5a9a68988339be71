"""Vectorised text kernels for Arrow batches: word spans and 64-bit word hashes.

Texts are handled in slices of about a megabyte, so a batch never needs more than
a few dozen megabytes of temporary arrays whatever its texts' lengths.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000

#: Bytes that part words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII byte that is not a letter or digit.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: A-Z to a-z.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPAN = 256
_POWERS = np.cumprod(np.full(_SPAN, _BASE, np.uint64))
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, np.uint64) | np.uint64(1)
_LETTER = _BYTE[LOWER]


def give_back() -> None:
    """Return a task's freed memory to the machine.

    Spark keeps Python workers for later tasks; what Arrow and the C library hold in
    reserve would count against the executor through stages that run no Python.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def slices(texts: Sequence[str | None]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first, last + 1, joined bytes, offsets) of runs of texts; a blank parts texts."""
    first, size, parts = 0, 0, []
    for k, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        parts.append(raw)
        size += len(raw) + 1
        if size >= SLICE_BYTES or k == len(texts) - 1:
            offsets = np.zeros(len(parts) + 1, np.int64)
            np.cumsum([len(p) + 1 for p in parts], out=offsets[1:])
            yield first, k + 1, b" ".join(parts) + b" ", offsets
            first, size, parts = k + 1, 0, []


def word_hashes(
    joined: bytes, offsets: np.ndarray, separators: np.ndarray = SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z only) words, each text's first word, and spans.

    Returns (hashes, bounds, starts, ends): words ``bounds[k]:bounds[k + 1]`` are
    text k's, and a word is the bytes ``starts[i]:ends[i]`` of ``joined``.
    """
    raw = np.frombuffer(joined, np.uint8)
    inside = np.concatenate(([False], ~separators[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds, starts, ends
    lengths = ends - starts
    heads = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(heads, lengths)
    terms = _LETTER[raw[inside[1:-1]]]
    # Beyond a span the powers repeat, multiplied by the span's own odd number.
    if lengths.max() > _SPAN:
        terms *= _POWERS[place % _SPAN]
        terms *= mix((place // _SPAN).astype(np.uint64) + np.uint64(1))
    else:
        terms *= _POWERS[place]
    sums = np.add.reduceat(terms, heads)
    return mix(sums + lengths.astype(np.uint64)), bounds, starts, ends


def chain(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` words; run i starts at word i."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xA24BAED4963EE407) + hashes[k : k + n]
    return mix(out)


def shingle_sets(texts: Sequence[str | None], width: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes.

    With fewer words than ``width`` the whole sequence is the one shingle; without
    words the set is empty.
    """
    for _, _, joined, offsets in slices(texts):
        hashes, bounds, _, _ = word_hashes(joined, offsets)
        runs = chain(hashes, width)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= width:
                yield np.unique(runs[a : b - width + 1])
            elif b > a:
                yield chain(hashes[a:b], int(b - a))
            else:
                yield np.zeros(0, np.uint64)
