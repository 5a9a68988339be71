"""Rolling spread profiles: a bar's volume lies evenly over the price bins it covered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.trading import sig8
from .series import by_time, rows

# Bars of the window, bars between two medians, a bin's width as a share of
# the first close, and the states with the ratios that enter and hold them.
WINDOW, STRIDE, BIN_SHARE = 240, 16, 0.0025
NODE_BANDS = {"AT_HVN": (">", 2.0, 1.5), "AT_LVN": ("<", 0.35, 0.5)}


def spread_ratio(bars: DataFrame, window: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """(symbol, tf, i, open_ts, ratio): volume in the close's bin over the median bin's.

    The window of ``window`` bars ends with the bar; bars from number ``window`` on are
    told. The median is over the bins with volume and is renewed every ``stride`` bars.
    Bins are not built: what covers the close is summed over the window's bars, and the
    median is read from the steps at the bars' edges, so cost does not depend on how
    many bins a bar spans. Bars after a median over no volume have no row.
    """
    key = ["symbol", "tf"]
    step = sig8(BIN_SHARE * F.first("close").over(by_time().rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda c: F.floor(F.col(c) / F.col("step"))
    base = bars.select(*key, "i", "open_ts", "volume", "low", "high", "close", step.alias("step")).withColumns({"b0": at("low"), "b1": at("high"), "cb": at("close")})
    base = base.withColumn("share", F.col("volume") / (F.col("b1") - F.col("b0") + 1))
    seen = F.collect_list(F.struct("b0", "b1", "share")).over(rows(1 - window, 0))
    told = base.withColumn("seen", seen).where(F.col("i") >= window)
    covers = F.filter("seen", lambda x: (x["b0"] <= F.col("cb")) & (x["b1"] >= F.col("cb")))
    own = told.select(
        *key, "i", "open_ts", (F.col("i") - (F.col("i") - window) % stride).alias("renewed"),
        F.aggregate(covers, F.lit(0.0), lambda a, x: a + x["share"]).alias("own"),
    )
    part = [*key, "renewed"]
    begun = told.where((F.col("i") - window) % stride == 0).select(*key, F.col("i").alias("renewed"), F.explode("seen").alias("x"))
    edges = F.array(
        F.struct(F.col("x.b0").alias("at"), F.col("x.share").alias("d")), F.struct((F.col("x.b1") + 1).alias("at"), (-F.col("x.share")).alias("d"))
    )
    turns = begun.select(*part, F.explode(edges).alias("e")).groupBy(*part, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    order = Window.partitionBy(*part).orderBy("at")
    levels = turns.withColumns({"level": F.sum("d").over(order), "width": F.lead("at").over(order) - F.col("at")}).where("level > 1e-9 and width > 0")
    upto = F.sum("width").over(Window.partitionBy(*part).orderBy("level", "at").rowsBetween(Window.unboundedPreceding, 0))
    bins = F.sum("width").over(Window.partitionBy(*part))
    medians = levels.withColumns({"upto": upto, "bins": bins}).where(F.col("upto") > F.floor(F.col("bins") / 2)).groupBy(*part).agg(F.min("level").alias("median"))
    return own.join(medians, part).select(*key, "i", "open_ts", F.round(F.col("own") / F.col("median"), 9).alias("ratio"))
