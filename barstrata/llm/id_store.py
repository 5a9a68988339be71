"""Token ids in binary shards, found by a minimal perfect hash of the document key.

Files of a store, all below one folder:

* ``ids/PART-NNNNNN.bin``: little-endian ids one after another, in ascending document id;
  two bytes an id if the vocabulary allows it, else four. A shard ends with the document
  that fills it.
* ``keys``: a Parquet row per document with its key.
* ``shards``: a Parquet row per file with its number of ids and those of all files before.
* ``index``: a Parquet row per bucket of keys with a minimal perfect hash: bit arrays of
  falling size, in each of which a key owns a bit if no other key of the bucket that is
  still without one hashes to it; the bit's rank among all set bits is the key's slot. A
  slot holds a fingerprint of the key, and the file, offset and length of its ids.

A look-up hashes the key to a bucket and a slot, compares the fingerprint and reads one
range of one file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path
from .packing import WordEncoder

#: The id that ends every document.
END = 2
#: Bytes after which a shard ends; keys in a bucket of the index, on average.
SHARD_BYTES, BUCKET_KEYS = 8 << 20, 4096
#: Bits an unplaced key gets in each array, and the arrays after which equal keys are assumed.
_SPREAD, _LEVELS = 2, 200

_KEYS = "doc_id string, part long, shard long, copy long, leads boolean, offset long, n_ids long"
_INDEX = "bucket long, n int, levels array<int>, bits binary, prints binary, shards binary, offsets binary, lengths binary"
# Ids reach Python as strings: a nullable long would become a double there.
_PLACES = "doc_id string, copy long, shard long, offset long, n_ids long"


def _file_system(path: str):
    """A file system and the path in it, by the path's scheme."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def _name(root: str, shard: int) -> str:
    return f"{root}/ids/{shard >> 24:06d}-{shard & 0xFFFFFF:06d}.bin"


class _Shards:
    """The files of one task; each appears under its name only when it is whole."""

    def __init__(self, root: str, part: int):
        self.system, self.root = _file_system(root)
        self.part, self.count, self.size, self.parts = part, 0, 0, []

    @property
    def shard(self) -> int:
        return self.part << 24 | self.count

    def add(self, raw: bytes) -> None:
        self.parts.append(raw)
        self.size += len(raw)

    def close(self) -> None:
        if not self.parts:
            return
        name = _name(self.root, self.shard)
        own = f"{name}.{uuid.uuid4().hex}"
        with self.system.open_output_stream(own) as out:
            for raw in self.parts:
                out.write(raw)
        self.system.move(own, name)  # a second attempt replaces it by the same bytes
        self.parts, self.size = [], 0
        self.count += 1


@cache
def _encoder(path: str) -> WordEncoder:
    """One a Python worker, so that the tasks after its first find words known."""
    return WordEncoder(path)


def _write(root: str, tokenizer: str, width: int, shard_bytes: int):
    kind = np.dtype("<u2") if width == 2 else np.dtype("<u4")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        encode, shards = _encoder(tokenizer), _Shards(root, part)
        end = np.array([END], np.uint32).tobytes()
        start = last = object()
        copy, leads = 0, True
        for frame in frames:
            rows, docs, texts = [], frame["doc_id"].tolist(), [t or "" for t in frame["text"]]
            for at in range(0, len(texts), 200):
                for doc, ids in zip(docs[at : at + 200], encode(texts[at : at + 200]), strict=True):
                    if last is start or last != doc:
                        leads, copy, last = last is start, 0, doc
                    else:
                        copy += 1
                    raw = np.frombuffer(ids + end, "<u4").astype(kind).tobytes()
                    rows.append((doc, part, shards.shard, copy, leads, shards.size, len(raw) // width))
                    shards.add(raw)
                    if shards.size >= shard_bytes:
                        shards.close()
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _KEYS.split(", ")])
        shards.close()

    return run


def _key(*seed: Column) -> Column:
    return F.xxhash64(*seed, F.coalesce(F.col("doc_id"), F.lit(0)), F.col("doc_id").isNull(), F.col("copy"))


def _hashed(keys: DataFrame, buckets: int) -> DataFrame:
    """Two hashes of each key, and its bucket."""
    both = keys.withColumns({"h1": _key(), "h2": _key(F.lit(0x5EED))})
    return both.withColumn("bucket", F.pmod(F.shiftright("h2", 20), F.lit(buckets)))


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _bit(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (_mix(h1, level + 1) + (_mix(h2, level + 1) << np.uint64(1))) % np.uint64(bits)


def prints(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """32-bit fingerprints, independent of the bits that the levels use."""
    return (_mix(h1 ^ (h2 >> np.uint64(7)), 0xF1) >> np.uint64(16)).astype(np.uint32)


def build_hash(h1: np.ndarray, h2: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Words of each bit array, and all of them joined, for distinct keys (h1, h2)."""
    levels, arrays = [], []
    while len(h1):
        if len(levels) == _LEVELS:
            raise ValueError("keys of a minimal perfect hash must be distinct")
        words = -(-_SPREAD * len(h1) // 64)
        place = _bit(h1, h2, len(levels), 64 * words).astype(np.int64)
        alone = np.bincount(place, minlength=64 * words) == 1
        arrays.append(np.packbits(alone, bitorder="little").view("<u8"))
        levels.append(words)
        h1, h2 = h1[~alone[place]], h2[~alone[place]]
    return levels, np.concatenate(arrays) if arrays else np.zeros(0, "<u8")


def slots(levels: list[int], table: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Each key's slot: the rank of the first bit that it owns; -1 for keys that own none."""
    ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(table)))).astype(np.int64)
    out = np.full(len(h1), -1, np.int64)
    left, at = np.arange(len(h1)), 0
    for level, words in enumerate(levels):
        place = _bit(h1[left], h2[left], level, 64 * words)
        word, bit = at + (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
        here = (table[word] >> bit) & np.uint64(1) == 1
        below = table[word] & ((np.uint64(1) << bit) - np.uint64(1))
        out[left[here]] = (ranks[word] + np.bitwise_count(below).astype(np.int64))[here]
        left, at = left[~here], at + words
    return out


def _u64(column: pd.Series) -> np.ndarray:
    return column.to_numpy(np.int64).view(np.uint64)


def _index_bucket(frame: pd.DataFrame) -> pd.DataFrame:
    h1, h2 = _u64(frame["h1"]), _u64(frame["h2"])
    levels, table = build_hash(h1, h2)
    order = np.argsort(slots(levels, table, h1, h2))
    column = lambda c: frame[c].to_numpy(np.int64)[order].astype("<i8").tobytes()
    return pd.DataFrame([{
        "bucket": frame["bucket"].iloc[0], "n": len(frame), "levels": levels, "bits": table.tobytes(),
        "prints": prints(h1, h2)[order].astype("<u4").tobytes(),
        "shards": column("shard"), "offsets": column("offset"), "lengths": column("n_ids"),
    }])


def _find(key: tuple, wanted: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    if not len(index) or not len(wanted):
        return pd.DataFrame({c.split()[0]: np.zeros(0, object if " string" in c else np.int64) for c in _PLACES.split(", ")})
    row = index.iloc[0]
    h1, h2 = _u64(wanted["h1"]), _u64(wanted["h2"])
    slot = slots(list(row["levels"]), np.frombuffer(row["bits"], "<u8"), h1, h2)
    known = (slot >= 0) & (np.frombuffer(row["prints"], "<u4")[slot] == prints(h1, h2))
    slot = slot[known]
    out = pd.DataFrame({c: wanted[c].to_numpy(kind)[known] for c, kind in (("doc_id", object), ("copy", np.int64))})
    for name, packed in (("shard", "shards"), ("offset", "offsets"), ("n_ids", "lengths")):
        out[name] = np.frombuffer(row[packed], "<i8")[slot]
    return out


def _read(root: str, width: int):
    kind = "<u2" if width == 2 else "<u4"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _file_system(root)
        name, source = None, None
        for frame in frames:
            ids = []
            for shard, offset, n in zip(frame["shard"], frame["offset"], frame["n_ids"], strict=True):
                wanted = _name(base, int(shard))
                if wanted != name:
                    if source is not None:
                        source.close()
                    name, source = wanted, system.open_input_file(wanted)
                raw = source.read_at(int(n) * width, int(offset))
                ids.append(np.frombuffer(raw, kind).astype("<u4").tobytes())
            yield frame.assign(ids=ids)
        if source is not None:
            source.close()

    return run


class IdStore:
    """A written store: ``keys`` and ``shards`` as tables, ``find`` and ``read`` by key."""

    def __init__(self, spark: SparkSession, path: str, width: int, buckets: int):
        self.spark, self.path, self.width, self.buckets = spark, path, width, buckets

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    @property
    def keys(self) -> DataFrame:
        """(doc_id, copy) of every document; copies number the rows that repeat an id from 0."""
        return self._table("keys", "doc_id long, copy long")

    @property
    def shards(self) -> DataFrame:
        """(shard, n_ids, base): a file's ids and those of all files before it."""
        return self._table("shards", "shard long, n_ids long, base long")

    def find(self, wanted: DataFrame) -> DataFrame:
        """(doc_id, copy, shard, offset in bytes, n_ids) of the wanted keys that are held.

        Keys asked for more than once are looked up once. A key that is not held has no
        row, but for one in 2 ** 32 whose fingerprint agrees with another's.
        """
        asked = _hashed(wanted.select("doc_id", "copy").distinct(), self.buckets)
        index = self._table("index", _INDEX)
        asked = asked.withColumn("doc_id", F.col("doc_id").cast("string"))
        found = asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(_find, _PLACES)
        return found.withColumn("doc_id", F.col("doc_id").cast("long"))

    def read(self, wanted: DataFrame) -> DataFrame:
        """The rows of ``find`` with their ids, as little-endian unsigned 32-bit integers."""
        return self._fetch(wanted, _read(self.path, self.width), "ids binary")

    def digests(self, wanted: DataFrame) -> DataFrame:
        """The rows of ``find`` with the crc32 of the ids read, so that ids stay in their task."""
        read = _read(self.path, self.width)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in read(frames):
                yield frame.assign(ids_crc32=[zlib.crc32(x) for x in frame["ids"]]).drop(columns="ids")

        return self._fetch(wanted, run, "ids_crc32 long")

    def _fetch(self, wanted: DataFrame, run, added: str) -> DataFrame:
        places = self.find(wanted).withColumn("doc_id", F.col("doc_id").cast("string"))
        # One task reads a file from front to back; a file is of bounded size.
        near = places.repartition("shard").sortWithinPartitions("shard", "offset")
        return near.mapInPandas(run, f"{_PLACES}, {added}").withColumn("doc_id", F.col("doc_id").cast("long"))

    def starts(self, places: DataFrame) -> DataFrame:
        """``places`` with ``start``: ids of all documents before."""
        return places.join(self.shards.select("shard", "base"), "shard").withColumn(
            "start", (F.col("base") + F.col("offset") / F.lit(self.width)).cast("long")
        )


def _numbered(made: DataFrame) -> DataFrame:
    """``copy`` counted over tasks: only a task's first run of rows can continue an id."""
    known = F.col("doc_id").eqNullSafe(F.col("id"))
    leading = made.where("leads").select(F.col("doc_id").alias("id")).distinct()
    counts = made.join(leading, known, "left_semi").groupBy("doc_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("doc_id").alias("id"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases = bases.where("base > 0")
    return (
        made.join(bases, known & (F.col("part") == F.col("p")), "left")
        .withColumn("copy", F.col("copy") + F.coalesce("base", F.lit(0)))
        .drop("id", "p", "base")
    )


def _bases(made: DataFrame) -> DataFrame:
    """Ids of every file and of all files before it: sums within a task, then over the tasks."""
    files = made.groupBy("part", "shard").agg(F.sum("n_ids").alias("n_ids"))
    run = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    tasks = tasks.select("part", run(Window.orderBy("part")).alias("task_base"))  # a row a task
    return files.withColumn("own", run(Window.partitionBy("part").orderBy("shard"))).join(tasks, "part").select(
        "shard", "n_ids", (F.col("own") + F.col("task_base")).alias("base")
    )


def write_ids(
    docs: DataFrame,
    tokenizer_path: str,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_bytes: int = SHARD_BYTES,
    bucket_keys: int = BUCKET_KEYS,
) -> IdStore:
    """Encode all texts, write the ids in ascending document id, and index them by key.

    ``path`` is a new folder that all executors reach; by default one in the shared folder.
    Every document ends with the id 2. Null and empty texts are that id alone. Rows with a
    null id come first; rows that repeat an id are numbered in ``copy``, in the order of a
    digest of their texts, and may lie in several tasks and files. A very long text lies
    whole in one file. Other columns are not read. An empty table gives a store without
    rows. ``tokenizer_path`` must name the same file on every executor.

    Texts are shuffled once, by range of the id; files are written under a name of their
    own and then renamed, so a task that runs again replaces them by the same bytes.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    path = path or shared_path(spark, "ids")
    system, root = _file_system(path)
    system.create_dir(f"{root}/ids", recursive=True)
    width = 2 if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else 4
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # The last key splits the rows of one id and text.
    order = ["doc_id", "digest", "row"]
    keyed = texts.withColumns({"digest": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    written = f"{path}/written"
    named = ranged.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    named.mapInPandas(_write(path, tokenizer_path, width, shard_bytes), _KEYS).write.parquet(written)
    made = spark.read.schema(_KEYS).parquet(written)
    made = _numbered(made.withColumn("doc_id", F.col("doc_id").cast("long")))
    made.select("doc_id", "copy").write.parquet(f"{path}/keys")
    _bases(made).write.parquet(f"{path}/shards")
    buckets = max(made.count() // bucket_keys, 1)
    hashed = _hashed(made, buckets).select("bucket", "h1", "h2", "shard", "offset", "n_ids")
    hashed.groupBy("bucket").applyInPandas(_index_bucket, _INDEX).write.parquet(f"{path}/index")
    return IdStore(spark, path, width, buckets)


def encoded_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of a new store.

    Every key of the store is looked up through the index; ``write_ids`` states what
    nulls, repeated ids and empty tables give.
    """
    store = write_ids(docs, tokenizer_path)
    found = store.starts(store.digests(store.keys))
    return found.select("doc_id", "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")


__all__ = ["IdStore", "build_hash", "encoded_documents", "prints", "slots", "write_ids"]
