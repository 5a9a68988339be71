"""Shared helpers: tables in the shared checkpoint folder.

Joins carry no broadcast hints: written tables have their true size in bytes, so Spark
broadcasts a side below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles, splitting
skewed partitions, beyond it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Bytes of one Arrow batch of a Python task.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only in local mode."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "barstrata.shared.dir", None
    )
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="barstrata-")
        spark.conf.set("barstrata.shared.dir", path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    It cuts the lineage: a lost executor costs a reread, not a recomputation, and
    the reader sees one fixed version of the rows.
    """
    spark = df.sparkSession
    # Spark 4.1 can take a union as partitioned like its branches when they are not and
    # lose rows in the join after it.
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of this session's queries go as soon as a query ends, not when the driver collects garbage.

    For blocks whose queries end in written tables or in rows at the driver: nothing reads
    their shuffles again.
    """
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def bounded_batches(spark: SparkSession) -> None:
    """Hand rows to this session's Python tasks by bytes, not by 10,000 rows of any length.

    A batch lies in memory several times: outside the heap of the executor, and in its
    Python task as Arrow, as objects and as what is computed from them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _folders(table: DataFrame) -> list[str]:
    return sorted({f.rpartition("/")[0] for f in table.inputFiles()})


def together(tables: list[DataFrame]) -> DataFrame:
    """The rows of materialized tables of one schema, as one scan of all their files.

    A union has a branch for each table, and the driver plans every branch again
    whenever a stage of the plan ends.
    """
    paths = [path for table in tables for path in _folders(table)]
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*paths)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete materialized tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for table in tables:
        for parent in _folders(table):
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)
