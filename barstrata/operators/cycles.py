"""Timing cycles: lows that follow each other within a band of days, and what lies between."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.bars import written
from .joins import asof
from .paths import reachable

# Bars beside a fractal low, the bands in days, where a top is left or right.
FRACTAL, DAILY_DAYS, WEEKLY_DAYS, LEFT, RIGHT = 2, (54, 66), (150, 200), 0.40, 0.60
DAY = 86400

_KEY = ["symbol", "tf"]


def fractal_lows(bars: DataFrame) -> DataFrame:
    """(at, low, i) of bars whose low is strictly below those of two bars on either side."""
    order = Window.partitionBy(*_KEY).orderBy("open_ts")
    near = [f("low", k).over(order) for f in (F.lag, F.lead) for k in range(1, FRACTAL + 1)]
    lowest = F.lit(True)
    for other in near:
        lowest = lowest & (F.col("low") < other)
    return bars.withColumn("__lowest", lowest).where("__lowest").select(*_KEY, F.col("open_ts").alias("at"), "low", "i")


def successors(lows: DataFrame, starts: DataFrame, ends: DataFrame, band: tuple[int, int]) -> DataFrame:
    """(key, at, to, late, inverted) of every low and start: the lowest low within the band of
    days after it, ties to the earlier; else, once the band is over, the next low after it.

    A low meets the others by bins of time as wide as the band, so two bins at most.
    """
    first, last = (d * DAY for d in band)
    width = last - first + DAY
    nodes = lows.select(*_KEY, "at").unionByName(starts.select(*_KEY, "at")).repartition(*_KEY, "at").distinct()
    bin_of = lambda c: F.floor(c / width)
    asked = nodes.withColumn("bin", F.explode(F.sequence(bin_of(F.col("at") + first), bin_of(F.col("at") + last))))
    seen = lows.select(*_KEY, F.col("at").alias("to"), "low", bin_of(F.col("at")).alias("bin"))
    inside = asked.join(seen, [*_KEY, "bin"]).where((F.col("to") >= F.col("at") + first) & (F.col("to") <= F.col("at") + last))
    best = inside.groupBy(*_KEY, "at").agg(F.min_by("to", F.struct("low", "to")).alias("near"))
    open_end = nodes.join(best, [*_KEY, "at"], "left").join(ends, _KEY).withColumn("until", -(F.col("at") + last))
    # The next low after the band, by an as-of join in falling time.
    later = lows.select(*_KEY, (-F.col("at")).alias("from"), F.col("at").alias("next"))
    told = asof(open_end, later, _KEY, "until", "from", ["next"], strict=True)
    over = F.col("near").isNull() & (-F.col("until") + FRACTAL * DAY <= F.col("end_ts"))
    return told.select(*_KEY, "at", F.coalesce("near", F.when(over, F.col("next"))).alias("to"), F.col("near").isNull().alias("late"), over.alias("inverted"))


def cycle_lows(pool: DataFrame, seeds: DataFrame, bars: DataFrame, band: tuple[int, int], name: str) -> tuple[DataFrame, DataFrame]:
    """The lows that a walk from each series' seed (key, at) accepts, and the inversions:
    bands that ended without a low."""
    ends = bars.groupBy(*_KEY).agg(F.max("open_ts").alias("end_ts"))
    known = seeds.join(bars.select(*_KEY, F.col("open_ts").alias("at")), [*_KEY, "at"], "left_semi")
    links = written(successors(pool, known, ends, band), "cycle-links")
    walked = reachable(links, known)
    at = bars.select(*_KEY, F.col("open_ts").alias("at"), "low", "i")
    into = links.where("to is not null").join(walked, [*_KEY, "at"], "left_semi").select(*_KEY, F.col("to").alias("at"), "late")
    lows = walked.join(at, [*_KEY, "at"]).join(into, [*_KEY, "at"], "left").withColumns({"seed": F.col("late").isNull(), "late": F.coalesce("late", F.lit(False)), "kind": F.lit(name)})
    turned = links.where("inverted").join(walked, [*_KEY, "at"], "left_semi").select(
        *_KEY, F.lit(f"{name}_INVERSION").alias("kind"), F.col("at").alias("after_low"), (F.col("at") + band[0] * DAY).alias("band_start"), (F.col("at") + band[1] * DAY).alias("band_end")
    )
    return written(lows, "cycle-lows"), turned


def classified(lows: DataFrame, bars: DataFrame) -> DataFrame:
    """Each cycle between two lows: its top, where in it that lies, and whether it failed by
    closing below its first low before it passed the top of the cycle before."""
    order = Window.partitionBy(*_KEY).orderBy("at")
    legs = lows.withColumns({"end": F.lead("at").over(order), "end_i": F.lead("i").over(order), "late_end": F.lead("late").over(order)})
    legs = legs.where(F.col("end_i") > F.col("i") + 1).select(*_KEY, "kind", "at", F.col("i").alias("start_i"), F.col("low").alias("start_low"), "end", "end_i", "late_end")
    # A bar belongs to the leg that it follows the start of; a leg's last bar is the next one's first.
    spans = asof(bars.select(*_KEY, "open_ts", "i", "high", "close"), legs, _KEY, "open_ts", "at", ["at"])
    closing = legs.select(*_KEY, "at", F.col("end").alias("open_ts")).join(bars.select(*_KEY, "open_ts", "i", "high", "close"), [*_KEY, "open_ts"])
    inside = spans.where("at is not null").select(*_KEY, "at", "open_ts", "i", "high", "close").unionByName(closing.select(*_KEY, "at", "open_ts", "i", "high", "close"))
    inside = inside.repartition(*_KEY, "at").distinct().join(legs, [*_KEY, "at"]).where("i <= end_i")
    tops = written(inside.groupBy(*_KEY, "at").agg(F.max_by(F.struct(F.col("i").alias("top_i"), F.col("open_ts").alias("top_ts"), F.col("high").alias("top_price")), F.struct("high", -F.col("i"))).alias("t")), "cycle-tops")
    told = legs.join(tops.select(*_KEY, "at", "t.*"), [*_KEY, "at"]).withColumn("prev_top", F.lag("top_price").over(order))
    falls = (
        inside.select(*_KEY, "at", "i", "high", "close", "start_low", "start_i").join(told.select(*_KEY, "at", "prev_top"), [*_KEY, "at"]).where("i > start_i")
        .groupBy(*_KEY, "at").agg(F.min(F.when(F.col("close") < F.col("start_low"), F.col("i"))).alias("down"), F.min(F.when(F.col("high") > F.col("prev_top"), F.col("i"))).alias("up"))
    )
    place = (F.col("top_i") - F.col("start_i")) / (F.col("end_i") - F.col("start_i"))
    failed = F.col("prev_top").isNotNull() & F.col("down").isNotNull() & (F.col("up").isNull() | (F.col("down") < F.col("up")))
    return told.join(falls, [*_KEY, "at"], "left").select(
        *_KEY, "kind", F.col("at").alias("start_ts"), F.col("end").alias("end_ts"), "top_ts", "top_price", F.bround(place, 3).alias("fraction"),
        F.when(place < LEFT, "left").when(place > RIGHT, "right").otherwise("mid").alias("translation"), F.coalesce(failed, F.lit(False)).alias("failed"), "late_end",
    )
