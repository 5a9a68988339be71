"""Findings that are seen again and again: first and last seen, closed when gone, in a partitioned table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.bars import written

#: What a table of findings adds to their key.
LIFE = "first_seen long, last_seen long, closed_at long"


def merged(held: DataFrame, seen: DataFrame, key: Sequence[str], at: Column) -> DataFrame:
    """``held`` (key, first_seen, last_seen, closed_at) after a look at time ``at`` has seen the
    keys of ``seen``: new ones are first seen then, known ones keep their first time, open ones
    that are gone are closed, and a closed one that comes back is first seen anew."""
    now = seen.select(*key).distinct().withColumn("__seen", F.lit(True))
    both = held.join(now, list(key), "full_outer")
    here, shut = F.col("__seen").isNotNull(), F.col("closed_at").isNotNull()
    return both.select(
        *key,
        F.when(here & (F.col("first_seen").isNull() | shut), at).otherwise(F.col("first_seen")).alias("first_seen"),
        F.when(here, at).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(here, F.lit(None).cast("long")).when(shut, F.col("closed_at")).otherwise(at).alias("closed_at"),
    )


def look(spark: SparkSession, path: str, seen: DataFrame, key: Sequence[str], at: int, partition: str) -> DataFrame:
    """Bring the table at ``path``, partitioned by the key column ``partition``, up to a look at ``at``.

    Only partitions with a finding that is seen or still open are rewritten, by a dynamic
    partition overwrite. A look that is not after the last one changes nothing, so that a
    batch that runs again does no harm. A table that is not there yet is made.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in seen.select(*key).schema.fields) + f", {LIFE}"
    columns = [*key, "first_seen", "last_seen", "closed_at"]
    spark.createDataFrame([], schema).write.mode("append").partitionBy(partition).parquet(path)
    held = spark.read.schema(schema).parquet(path)
    last = held.agg(F.max(F.greatest("last_seen", F.coalesce("closed_at", "last_seen")))).first()[0]
    if last is None or at > last:
        touched = held.where("closed_at is null").select(partition).unionByName(seen.select(partition)).distinct()
        part = held.join(touched, partition, "left_semi")
        # The new rows are fixed before the partitions that they come from are overwritten.
        fresh = written(merged(part, seen, key, F.lit(at).cast("long")).select(*columns), "findings")
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return spark.read.schema(schema).parquet(path)


def high_water(bars: DataFrame) -> DataFrame:
    """(symbol, tf, mark): the open time of each series' last bar."""
    return bars.groupBy("symbol", "tf").agg(F.max("open_ts").alias("mark"))


def beyond(bars: DataFrame, marks: DataFrame) -> DataFrame:
    """The bars after their series' mark; all of a series without one."""
    return bars.join(marks, ["symbol", "tf"], "left").where(F.col("mark").isNull() | (F.col("open_ts") > F.col("mark"))).drop("mark")
