"""Live bars: ticks arrive as a stream, a bar is emitted once, after it has closed."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.facts import append
from ..sources.candles import TF_SECONDS

#: Weeks start on Monday, four days after the epoch's Thursday.
_SHIFT = {"1W": "4 days"}


def _window(tf: str):
    span = f"{TF_SECONDS[tf]} seconds"
    return F.window("ts", span, span, _SHIFT[tf]) if tf in _SHIFT else F.window("ts", span)


def closed_bars(ticks: DataFrame, tf: str, lateness: str = "0 seconds") -> DataFrame:
    """OHLCV bars of a stream of (symbol, ts, seq, price), in append mode.

    The watermark closes a bar: it is emitted once ticks after its end, by at least
    ``lateness``, have come; later ticks of a closed bar are dropped. State holds the
    open bars only.
    """
    order = F.struct("ts", "seq")
    return (
        ticks.where("price is not null")
        .withWatermark("ts", lateness)
        .groupBy("symbol", _window(tf).alias("w"))
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.count("*").cast("double").alias("volume"),
        )
        .select("symbol", F.unix_seconds("w.start").alias("open_ts"), "open", "high", "low", "close", "volume", F.lit(tf).alias("tf"))
    )


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir; a local one only in local mode."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="barstrata-")
    return f"{top.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(frame: DataFrame, label: str) -> DataFrame:
    """``frame`` as a table in the shared folder, for plans that read it several times."""
    spark = frame.sparkSession
    path = shared_folder(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def stream_files(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stream of the Parquet file or the files of the folder at ``path``."""
    # As a pattern, the path may be one file as well as a folder.
    return spark.readStream.schema(schema).parquet(f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]")


def run_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """Run the stream over all input there is now and read what it has emitted.

    The Parquet sink and its checkpoint are in ``folder``, so a later run goes on
    from there and nothing is emitted twice.
    """
    spark = stream.sparkSession
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{folder}/bars")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/bars")


def fact_sink(path: str):
    """A foreachBatch function that appends facts to the table at ``path``, each once.

    A batch that is run again after a failure adds nothing. The new facts are fixed
    in the shared folder before the write, as it adds to the table that they are
    compared with. A table that is not there yet is made.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch.where("false").write.mode("append").parquet(path)
        held = spark.read.schema(batch.schema).parquet(path)
        written(append(held, batch), "facts-added").write.mode("append").parquet(path)

    return write
