"""Exact deduplication by a stateful stream.

A file stream of (digest, id, locator) feeds a streaming aggregation whose RocksDB
state has one entry per digest, kept on disk without expiry: the digest, the stable
identifier (the largest id so far), the locator of that row's content and the number
of rows. A run takes the files it has not seen yet, so later files continue from the
same state. Rows whose digest is held by another row are hits; their full bytes are
put together where equal and compared with the bytes at the locator. Should bytes
differ under one digest, the rows of that digest are grouped by their bytes instead.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_path
from .sketch import hits, key_bitmap

#: Disk-backed state whose commits write changes only; without preallocated files
#: the many small stores of a wide shuffle take little disk.
_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _located(frame: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, normalised text, and the row's place: file and row number in it."""
    return frame.select(
        F.col(id_col).cast("long").alias("id"),
        normalised(F.col(text_col)).alias("norm"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


def update_state(
    spark: SparkSession,
    path: str,
    state_dir: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_hex,
) -> None:
    """Stream the Parquet files of ``path`` that ``state_dir`` has not seen into its state."""
    schema = spark.read.parquet(path).select(id_col, text_col).schema
    # As a pattern, the path may be one file as well as a folder.
    files = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
    before = {key: spark.conf.get(key, None) for key in _STATE_CONF}
    for key, value in _STATE_CONF.items():
        spark.conf.set(key, value)
    try:
        seen = _located(spark.readStream.schema(schema).parquet(files), id_col, text_col)
        state = (
            seen.select(digest(F.col("norm")).alias("digest"), "id", "file", "row")
            .groupBy("digest")
            .agg(F.max(F.struct("id", "file", "row")).alias("keeper"), F.count("*").alias("members"))
        )
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", state_dir)
            .format("noop")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def read_state(spark: SparkSession, state_dir: str) -> DataFrame:
    """digest, keep_id, file, row, members: one row per digest in the state."""
    held = spark.read.format("statestore").load(state_dir)
    value = held.schema["value"].dataType.fieldNames()
    return held.select(
        F.col("key").getField("digest").alias("digest"),
        F.col("value").getField(value[0]).getField("id").alias("keep_id"),
        F.col("value").getField(value[0]).getField("file").alias("file"),
        F.col("value").getField(value[0]).getField("row").alias("row"),
        F.col("value").getField(value[1]).alias("members"),
    )


def stream_dedup(
    spark: SparkSession,
    path: str,
    state_dir: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_hex,
) -> DataFrame:
    """One row per row of the Parquet table at ``path``:
    doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after lower-casing A-Z; null counts as empty. Of
    equal texts the largest id stays, and of several rows with it the last by file
    and row number. A null id is smaller than any other. An empty table gives no
    rows. Other columns are not read. With ``state_dir`` later calls go on from the
    state; the files it has seen must still be there.
    """
    state_dir = state_dir or shared_path(spark, "dedup-state")
    update_state(spark, path, state_dir, id_col, text_col, digest)
    groups = materialize(read_state(spark, state_dir).where("members > 1"), "dedup-groups")
    rows = _located(spark.read.parquet(path), id_col, text_col).withColumn("digest", digest(F.col("norm")))

    # Hits: the bytes of the rows of groups. The bitmap keeps the texts of all others out of
    # the shuffle; equal bytes of a task are one row before it, so that a digest that a third
    # of all rows share is a row a task.
    table = key_bitmap(groups.select(F.xxhash64("digest")))

    @F.pandas_udf("boolean")
    def repeated(keys: pd.Series) -> pd.Series:
        return pd.Series(hits(table, keys.to_numpy()))

    texts = materialize(
        rows.where(repeated(F.xxhash64("digest")))
        .groupBy("digest", "norm").agg(F.max(F.struct("id", "file", "row")).alias("k"), F.count("*").alias("members"))
        .join(groups.select("digest", F.struct("file", "row").alias("held")), "digest"),
        "dedup-texts",
    )
    # The rows with the bytes at the locator are the one of these that has the locator's row.
    at_locator = F.struct("k.file", "k.row") == F.col("held")
    others = texts.where(~at_locator).select("digest", "norm")
    kept_text = texts.where(at_locator).select("digest", F.col("norm").alias("kept_norm"))
    differ = materialize(others.join(kept_text, "digest").where("norm <> kept_norm").select("digest").distinct(), "dedup-differ")
    members = groups.select("digest", "keep_id", F.col("file").alias("kept_file"), F.col("row").alias("kept_row"), "members")
    plain = rows.select("id", "file", "row", "digest", sha256_hex(F.col("norm")).alias("text_sha256"))
    out = plain.join(members, "digest", "left")
    if differ.isEmpty():
        return _result(out)
    # Different bytes under one digest: these rows are grouped by their bytes.
    odd = rows.join(differ, "digest", "left_semi")
    by_bytes = texts.join(differ, "digest", "left_semi").select("digest", "norm", "k", "members")
    resolved = odd.join(by_bytes, ["digest", "norm"]).select(
        "id",
        "file",
        "row",
        "digest",
        sha256_hex(F.col("norm")).alias("text_sha256"),
        F.col("k.id").alias("keep_id"),
        F.col("k.file").alias("kept_file"),
        F.col("k.row").alias("kept_row"),
        "members",
    )
    return _result(out.join(differ, "digest", "left_anti").select(*resolved.columns).unionByName(resolved))


def _result(rows: DataFrame) -> DataFrame:
    alone = F.col("members").isNull()
    return rows.select(
        F.col("id").alias("doc_id"),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("members", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce((F.col("file") == F.col("kept_file")) & (F.col("row") == F.col("kept_row")), F.lit(True)).alias("kept"),
        "text_sha256",
    )


#: DuckDB SQL of ``stream_dedup`` for tables whose ids are distinct.
SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM n JOIN g USING (norm)
"""
