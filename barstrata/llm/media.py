"""Media columns: content-defined chunking of payloads with a deduplicated chunk store.

A media item is a 44-byte WAVE header and the payload as 8-bit mono samples. A gear
hash that rolls over its bytes cuts it into chunks where the content says so, so equal
stretches give equal chunks wherever they stand. Equal media are stored once, and so
is a chunk that stands at several places: these form a table of their own by digest.
A stored item has its ordered chunk list and the bytes of its other chunks, compressed;
reading joins in the shared chunks, checks every chunk's digest and the whole item's
SHA-256, and computes features of the samples read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .sketch import hits, key_bitmap

#: Payloads are padded with bytes of 255 to a multiple of this.
BLOCK = 576
HEADER = 44
#: Least and largest chunk, and the bits of the gear hash that are 0 at a cut.
LEAST_CHUNK, LARGEST_CHUNK, CUT_BITS = 512, 16384, 11
_GEAR = np.random.Generator(np.random.PCG64(576)).integers(0, 2**32, 256, np.uint32)
_MASK = np.uint32(((1 << CUT_BITS) - 1) << (32 - CUT_BITS))


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded UTF-8 bytes and their number without padding."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (-len(raw) % BLOCK or (0 if raw else BLOCK)), len(raw)


def encode_media(payload: bytes) -> bytes:
    """8-bit mono PCM at 8 kHz: every payload byte is one sample."""
    rate = 8000
    return (
        struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
        + payload
    )


def decode_media(media: bytes) -> bytes:
    """The samples of ``encode_media``'s form."""
    riff, _, wave, _, _, form, channels, _, _, _, bits, _, size = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:HEADER])
    if (riff, wave, form, channels, bits) != (b"RIFF", b"WAVE", 1, 1, 8) or size != len(media) - HEADER:
        raise ValueError("not an 8-bit mono item")
    return media[HEADER:]


def cut_points(media: bytes) -> list[int]:
    """Ends of the chunks, by the hash of the 32 bytes before each place."""
    data = _GEAR[np.frombuffer(media, np.uint8)]
    # Doubling: after step s, data[i] is the hash of the last 2 ** (s + 1) bytes.
    for width in (1, 2, 4, 8, 16):
        shifted = data.copy()
        shifted[width:] += data[:-width] << np.uint32(width)
        data = shifted
    ends, last = [], 0
    for place in (np.flatnonzero((data & _MASK) == 0) + 1).tolist():
        while place - last > LARGEST_CHUNK:
            last += LARGEST_CHUNK
            ends.append(last)
        if place - last >= LEAST_CHUNK:
            ends.append(place)
            last = place
    while len(media) - last > LARGEST_CHUNK:
        last += LARGEST_CHUNK
        ends.append(last)
    if last < len(media):
        ends.append(len(media))
    return ends


def chunk_digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _parts(media: bytes) -> tuple[list[bytes], list[bytes]]:
    """The chunks in order and their digests."""
    ends = cut_points(media)
    parts = [media[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return parts, [chunk_digest(p) for p in parts]


def _keys(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), "<i8")


def _described(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each row's media digest and the keys of its chunks, without bytes."""
    for frame in frames:
        rows = []
        for doc, text in zip(frame["doc"], frame["text"], strict=True):
            payload, n = payload_of(text)
            media = encode_media(payload)
            rows.append((doc, n, hashlib.sha256(media).digest(), _keys(_parts(media)[1])))
        yield pd.DataFrame(rows, columns=["doc", "n_bytes", "media", "keys"]).astype({"doc": "Int64"})


def _items(shared: Broadcast):
    """Rows of the store: the chunk list, and the bytes of the chunks that stand nowhere else."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                media = encode_media(payload_of(text)[0])
                parts, digests = _parts(media)
                common = hits(shared.value, _keys(digests))
                own = b"".join(p for p, c in zip(parts, common, strict=True) if not c)
                rows.append((hashlib.sha256(media).digest(), digests, [len(p) for p in parts], np.flatnonzero(common).tolist(), zlib.compress(own, 6)))
            yield pd.DataFrame(rows, columns=["media", "chunks", "sizes", "shared", "blob"])

    return run


def _lent(shared: Broadcast):
    """The chunks that may stand at several places, each once a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told: set[bytes] = set()
        for frame in frames:
            rows = []
            for text in frame["text"]:
                parts, digests = _parts(encode_media(payload_of(text)[0]))
                for part, digest, common in zip(parts, digests, hits(shared.value, _keys(digests)), strict=True):
                    if common and digest not in told:
                        told.add(digest)
                        rows.append((digest, zlib.compress(part, 6)))
            yield pd.DataFrame(rows, columns=["digest", "bytes"])

    return run


def features_of(payload: bytes) -> str:
    """Mean, deviation, crossing rate of the middle, and entropy in bits of the samples."""
    data = np.frombuffer(payload, np.uint8)
    counts = np.bincount(data, minlength=256)
    share = counts[counts > 0] / len(data)
    values = np.arange(256)
    mean = float((counts * values).sum()) / len(data)
    power = float((counts * values * values).sum()) / len(data) - mean * mean
    cross = int(np.count_nonzero(np.diff((data >= 128).view(np.int8))))
    return f"mean={mean:.4f};std={max(power, 0.0) ** 0.5:.4f};cross={cross};entropy={-float((share * np.log2(share)).sum()):.4f}"


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rebuild, check and describe the stored items."""
    for frame in frames:
        rows = []
        for key, blob, chunks, sizes, borrowed in zip(frame["media"], frame["blob"], frame["chunks"], frame["sizes"], frame["borrowed"], strict=True):
            parts = {} if borrowed is None else {item["k"]: zlib.decompress(item["bytes"]) for item in borrowed}
            own, at = zlib.decompress(blob), 0
            for k, size in enumerate(sizes):
                if k not in parts:
                    parts[k] = own[at : at + size]
                    at += size
            media = b"".join(parts[k] for k in range(len(chunks)))
            if any(chunk_digest(parts[k]) != bytes(c) for k, c in enumerate(chunks)) or hashlib.sha256(media).digest() != bytes(key):
                raise ValueError(f"stored media {bytes(key).hex()} is damaged")
            payload = decode_media(media)
            rows.append((bytes(key), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), bytes(key).hex(), features_of(payload)))
        yield pd.DataFrame(rows, columns=["media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


_READ = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, items, chunks): each row's media digest, and the store in the shared folder.

    ``items`` has media, chunks, sizes, shared and blob: the ordered chunk list, which
    of them are in ``chunks`` (digest, bytes), and the bytes of the others. Chunks of
    one place only never leave their task but for the store: a bitmap of fixed size
    tells the others. Copies of a medium have no bytes of their own.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    rows = materialize(narrow.mapInPandas(_described, "doc long, n_bytes long, media binary, keys array<long>"), "media-rows")
    repeated = rows.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = docs.sparkSession.sparkContext.broadcast(key_bitmap(repeated))
    texts = narrow.select("text")
    items = materialize(texts.mapInPandas(_items(shared), "media binary, chunks array<binary>, sizes array<int>, shared array<int>, blob binary"), "media-items")
    chunks = materialize(texts.mapInPandas(_lent(shared), "digest binary, bytes binary").dropDuplicates(["digest"]), "media-chunks")
    return rows, items, chunks


def read_media(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """One described row per stored medium, rebuilt from the store and verified."""
    none = F.lit(None).cast("array<struct<k:int,bytes:binary>>")
    whole = items.where("size(shared) = 0").select("media", "chunks", "sizes", "blob", none.alias("borrowed"))
    parted = items.where("size(shared) > 0")
    # Only copies of one medium share all of their chunks, and these hold no bytes.
    copies = parted.where("size(shared) = size(chunks)").dropDuplicates(["media"])
    single = parted.where("size(shared) < size(chunks)").unionByName(copies)
    wanted = single.select("media", F.explode("shared").alias("k"), "chunks").select("media", "k", F.element_at("chunks", F.col("k") + 1).alias("digest"))
    borrowed = wanted.join(chunks, "digest").groupBy("media").agg(F.collect_list(F.struct("k", "bytes")).alias("borrowed"))
    lending = single.join(borrowed, "media").select(*whole.columns)
    # A bitmap's chance hit may leave a repeated medium more than once.
    return whole.unionByName(lending).mapInPandas(_read, _READ).dropDuplicates(["media"])


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature; all but n_bytes as read back.

    A null text is empty; an empty text is one block of 255s. Equal texts have equal
    values, and so have repeated rows. Null ids are kept. Texts that differ only in
    trailing padding bytes share a stored item. Other columns are not read. An empty
    table gives no rows.
    """
    rows, items, chunks = store_media(docs, id_col, text_col)
    read = materialize(read_media(items, chunks), "media-read")
    return rows.select(F.col("doc").alias("doc_id"), "n_bytes", "media").join(read, "media").drop("media")
