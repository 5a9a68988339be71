"""Sideways ranges: four local pivots at two levels, one active range at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof, first_beyond, meeting_bars
from .paths import reachable
from .structure import _DOWN, _UP, with_break_metrics
from .swings import seconds

# Pivots of a range, its boundary and height in ATR, tests that are told.
PIVOTS, BOUNDARY_ATR, MIN_HEIGHT_ATR, MAX_HEIGHT_ATR, MAX_TESTS = 4, 0.25, 1.0, 8.0, 10

_KEY = ["symbol", "tf"]


def candidates(pivots: DataFrame, bars: DataFrame) -> DataFrame:
    """Every run of four alternating pivots that is a range, whatever came before it.

    One search gives both containment and the break: the first close beyond the band from
    the first pivot on must come after the last pivot, and then ends the range.
    """
    order = Window.partitionBy(*_KEY).orderBy("market_time", "kind")
    run = order.rowsBetween(1 - PIVOTS, 0)
    side = lambda kind: F.when(F.col("kind") == kind, F.col("price"))
    windows = pivots.withColumns(
        {
            "n": F.count("*").over(run), "at": F.row_number().over(order).cast("long"), "first_ts": F.first("market_time").over(run), "first_i": F.first("i").over(run),
            "top": F.max(side("HIGH")).over(run), "bottom": F.min(side("LOW")).over(run),
            "lowest_top": F.min(side("HIGH")).over(run), "highest_bottom": F.max(side("LOW")).over(run),
            "n_top": F.count(side("HIGH")).over(run), "n_bottom": F.count(side("LOW")).over(run),
        }
    ).where((F.col("n") == PIVOTS) & (F.col("atr") > 0))
    band = BOUNDARY_ATR * F.col("atr")
    height = F.col("top") - F.col("bottom")
    flat = windows.where(
        (height >= MIN_HEIGHT_ATR * F.col("atr")) & (height <= MAX_HEIGHT_ATR * F.col("atr"))
        & (F.col("top") - F.col("lowest_top") <= band) & (F.col("highest_bottom") - F.col("bottom") <= band)
    ).withColumns({"band": band, "before": F.col("first_i") - 1})
    metrics = with_break_metrics(bars)
    above = first_beyond(flat, metrics, F.lit(True), F.col(_UP), "top", F.col(_DOWN), "bottom", after="before", name="above_i")
    both = first_beyond(above, metrics, F.lit(False), F.col(_UP), "top", F.col(_DOWN), "bottom", after="before", name="below_i")
    return both.withColumn("break_i", F.least("above_i", "below_i")).where("break_i is null or break_i > i")


def ranges(pivots: DataFrame, bars: DataFrame) -> DataFrame:
    """The ranges that are ever active: the first candidate, then always the first one whose
    pivots all come after the break of the one before.

    Each candidate's successor comes from one as-of join, the walk from pointer doubling.
    """
    from ..streaming.bars import written

    opened = bars.select(*_KEY, F.col("i").alias("break_i"), F.col("open_ts").alias("break_ts"))
    found = written(candidates(pivots, bars).join(opened, [*_KEY, "break_i"], "left"), "range-candidates")
    later = found.select(*_KEY, (-F.col("first_ts")).alias("from"), F.col("at").alias("to"))
    # Windows move on together with their first pivot, so the nearest one after the break is the successor.
    broken = found.where("break_ts is not null").select(*_KEY, "at", (-F.col("break_ts")).alias("until"))
    links = asof(broken, later, _KEY, "until", "from", ["to"], strict=True)
    starts = found.groupBy(*_KEY).agg(F.min("at").alias("at"))
    return found.join(reachable(links, starts), [*_KEY, "at"], "left_semi").withColumn(
        "range_id", F.concat_ws("|", "symbol", "tf", F.lit("RANGE"), F.col("market_time").cast("string"))
    )


def range_events(found: DataFrame, bars: DataFrame) -> DataFrame:
    """FORMED, TESTED and BROKEN: a test is an arrival of price at a boundary's band.

    The bar of the last pivot stands at a boundary, so it starts no test. Of each range the
    first ten tests are told and all are counted.
    """
    span = bars.select(*_KEY, F.col("i").alias("j"), F.col("open_ts").alias("at_ts"), "high", "low")
    far = 1e300
    sides = F.array(
        F.struct(F.lit("TOP").alias("side"), (F.col("top") - F.col("band")).alias("from"), F.lit(far).alias("to")),
        F.struct(F.lit("BOTTOM").alias("side"), F.lit(-far).alias("from"), (F.col("bottom") + F.col("band")).alias("to")),
    )
    base = found.select(*_KEY, "range_id", "market_time", "confirmed_at", "i", "break_i", "top", "bottom", "atr", "band", "n_top", "n_bottom")
    asked = base.withColumn("s", F.explode(sides)).withColumns({"side": F.col("s.side"), "lower": F.col("s.from"), "upper": F.col("s.to"), "after": F.col("i") - 1}).drop("s")
    met = meeting_bars(asked, span, "lower", "upper", "after", "break_i")
    line = Window.partitionBy("range_id", "side").orderBy("j")
    begun = met.withColumn("prev", F.lag("j").over(line)).where((F.col("j") > F.col("i")) & (F.col("prev").isNull() | (F.col("prev") < F.col("j") - 1)))
    order = Window.partitionBy("range_id").orderBy("j", F.desc("side"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    tests = begun.withColumns(
        {
            "episode": F.row_number().over(order).cast("long"),
            "top_touches": F.col("n_top") + F.count(F.when(F.col("side") == "TOP", 1)).over(so_far),
            "bottom_touches": F.col("n_bottom") + F.count(F.when(F.col("side") == "BOTTOM", 1)).over(so_far),
        }
    )
    counts = tests.groupBy("range_id").agg(
        F.count("*").alias("episodes"), F.count_if(F.col("side") == "TOP").alias("tops"), F.count_if(F.col("side") == "BOTTOM").alias("bottoms")
    )
    closed = F.col("at_ts") + seconds()

    def event(rows: DataFrame, name: str, time, known, side, episode, tops, bottoms, held) -> DataFrame:
        return rows.select(
            *_KEY, "range_id", F.lit(name).alias("event"), time.alias("market_time"), known.alias("confirmed_at"), "top", "bottom",
            F.bround((F.col("top") - F.col("bottom")) / F.col("atr"), 2).alias("height_atr"), side.cast("string").alias("side"), episode.cast("long").alias("episode"),
            tops.cast("long").alias("top_touches"), bottoms.cast("long").alias("bottom_touches"), held.cast("long").alias("bars_held"),
        )

    formed = event(base, "FORMED", F.col("market_time"), F.col("confirmed_at"), F.lit(None), F.lit(0), F.col("n_top"), F.col("n_bottom"), F.lit(0))
    tested = event(
        tests.where(F.col("episode") <= MAX_TESTS), "TESTED", F.col("at_ts"), F.greatest(closed, "confirmed_at"), F.col("side"), F.col("episode"),
        F.col("top_touches"), F.col("bottom_touches"), F.col("j") - F.col("i"),
    )
    ended = (
        found.where("break_i is not null").select("range_id", (F.col("above_i") == F.col("break_i")).alias("up")).join(base, "range_id").join(counts, "range_id", "left")
        .join(span.select(*_KEY, F.col("j").alias("break_i"), "at_ts"), [*_KEY, "break_i"])
    )
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    broken = event(
        ended, "BROKEN", F.col("at_ts"), F.greatest(closed, "confirmed_at"), F.when(F.coalesce("up", F.lit(False)), "TOP").otherwise("BOTTOM"), none("episodes"),
        F.col("n_top") + none("tops"), F.col("n_bottom") + none("bottoms"), F.col("break_i") - F.col("i"),
    )
    return formed.unionByName(tested).unionByName(broken)
