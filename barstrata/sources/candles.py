"""Candle sources: ticks to closed OHLCV bars, integrity, gaps and guarded resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds of each timeframe.
TF_SECONDS = {"5m": 300, "15m": 900, "1H": 3600, "4H": 14400, "1D": 86400, "1W": 604800}
#: The first Monday of the epoch, where weeks are anchored.
MONDAY = 345600
#: Derived timeframes: source and its bars per bucket.
DERIVED = {"4H": ("1H", 4), "1W": ("1D", 7)}


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since the epoch, by floor, of a timestamp without time zone."""
    return F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts) / F.lit(1_000_000)).cast("long")


def bucket_start(seconds: Column, tf: str) -> Column:
    """Start of the bucket; weeks start on Monday."""
    size = TF_SECONDS[tf]
    shift = MONDAY if tf == "1W" else 0
    return seconds - F.pmod(seconds - shift, F.lit(size))


def bars_from_ticks(ticks: DataFrame, tf: str) -> DataFrame:
    """OHLCV bars of ticks (symbol, ts, seq, price), one partial aggregation.

    ``seq`` orders ticks of one instant. Null prices are no ticks.
    """
    order = F.struct("ts", "seq")
    return (
        ticks.where("price is not null")
        .withColumn("open_ts", bucket_start(epoch_seconds(F.col("ts")), tf))
        .groupBy("symbol", "open_ts")
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.count("*").cast("double").alias("volume"),
        )
        .withColumn("tf", F.lit(tf))
    )


def is_sound(prefix: str = "") -> Column:
    """The OHLC invariants: high and low bound open and close, low > 0, volume >= 0."""
    o, h, l, c, v = (F.col(f"{prefix}{n}") for n in ("open", "high", "low", "close", "volume"))
    return (h >= F.greatest(o, c, l)) & (l <= F.least(o, c)) & (l > 0) & (v >= 0)


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of the events table: the event type is the symbol, the value the price."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.round("value", 2).alias("price")
    )


def lineitem_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of the lineitem table by return flag, in a total order of its columns."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_returnflag").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("seq"),
        F.round("l_extendedprice", 2).alias("price"),
    )


def candles(spark: SparkSession, sf_dir: str, tf: str = "1H") -> DataFrame:
    """Sound closed bars of the events table."""
    return bars_from_ticks(event_ticks(spark, sf_dir), tf).where(is_sound())


def resample(bars: DataFrame, tf: str) -> DataFrame:
    """Bars of a derived timeframe, only of buckets with every source bar."""
    source, count = DERIVED[tf]
    return (
        bars.where(F.col("tf") == source)
        .groupBy("symbol", bucket_start(F.col("open_ts"), tf).alias("bucket"))
        .agg(
            F.min_by("open", "open_ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "open_ts").alias("close"),
            F.sum("volume").alias("volume"),
            F.count_distinct("open_ts").alias("n"),
        )
        .where(F.col("n") == count)
        .select("symbol", F.col("bucket").alias("open_ts"), "open", "high", "low", "close", "volume", F.lit(tf).alias("tf"))
    )


def gaps(bars: DataFrame) -> DataFrame:
    """(symbol, tf, open_ts) of bars missing inside each series' served span."""
    step = F.create_map(*[x for tf, s in TF_SECONDS.items() for x in (F.lit(tf), F.lit(s))])
    wanted = (
        bars.groupBy("symbol", "tf")
        .agg(F.min("open_ts").alias("a"), F.max("open_ts").alias("b"))
        .select("symbol", "tf", F.explode(F.sequence("a", "b", step[F.col("tf")].cast("long"))).alias("open_ts"))
    )
    return wanted.join(bars, ["symbol", "tf", "open_ts"], "left_anti")


def upsert(held: DataFrame, new: DataFrame) -> DataFrame:
    """Bars by (symbol, tf, open_ts), where a new bar replaces a held one."""
    both = held.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)))
    columns = [c for c in held.columns if c not in ("symbol", "tf", "open_ts")]
    return both.groupBy("symbol", "tf", "open_ts").agg(
        F.max_by(F.struct(*columns), "__age").alias("x")
    ).select("symbol", "tf", "open_ts", *[F.col(f"x.{c}") for c in columns])


def tail(bars: DataFrame, n: int) -> DataFrame:
    """The last ``n`` bars of each series."""
    from pyspark.sql import Window

    last = Window.partitionBy("symbol", "tf").orderBy(F.desc("open_ts"))
    return bars.withColumn("__r", F.row_number().over(last)).where(F.col("__r") <= n).drop("__r")
