"""As-of joins, forward searches over bars, and latest or earliest rows of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bars in one bin of a forward search.
BIN = 128


def latest(frame: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key with the greatest ``order``, by partial aggregation."""
    rest = [c for c in frame.columns if c not in key]
    best = frame.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__x"))
    return best.select(*key, *[F.col(f"__x.{c}").alias(c) for c in rest])


def earliest(frame: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key; ``order`` may mix ascending and descending columns."""
    first = Window.partitionBy(*key).orderBy(*order)
    return frame.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")


def asof(
    left: DataFrame,
    right: DataFrame,
    key: Sequence[str],
    left_time: str,
    right_time: str,
    values: Sequence[str],
    max_age: int | None = None,
    strict: bool = False,
) -> DataFrame:
    """``left`` with the ``values`` of the last right row at or before its time.

    Both sides are merged and sorted by time once, and the last right row so far is
    carried along: one shuffle, no join. At equal times the right row comes first, or
    with ``strict`` too late. With ``max_age`` an older row counts as none. Right rows of one key and time are
    taken in the order of their values.
    """
    l = left.select(*key, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*[F.col(c) for c in left.columns]).alias("__row"))
    item = F.struct(F.col(right_time).alias("__at"), *values)
    r = right.select(*key, F.col(right_time).alias("__t"), F.lit(2 if strict else 0).alias("__side"), item.alias("__item"))
    # Spark can take a union as partitioned like its branches when it is not.
    both = l.unionByName(r, allowMissingColumns=True).repartition(*key)
    run = Window.partitionBy(*key).orderBy("__t", "__side", "__item").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__last", F.last("__item", ignorenulls=True).over(run)).where("__side = 1")
    known = F.lit(True) if max_age is None else F.col("__t") - F.col("__last.__at") <= max_age
    return out.select("__row.*", *[F.when(known, F.col(f"__last.{v}")).alias(v) for v in values])


def asof_many(left: DataFrame, facts: dict[str, tuple[DataFrame, str, Sequence[str]]], key: Sequence[str], left_time: str) -> DataFrame:
    """``left`` with the last row of each of ``facts`` (name: frame, time, values) at or before
    its time, as a struct of its values and ``at``, null if none.

    All are dealt by the key and sorted by time once, however many there are. At equal times
    facts come first; of several of one kind and time the greatest values are the last.
    """
    both = left.select(*key, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*[F.col(c) for c in left.columns]).alias("__row"))
    for name, (frame, time, values) in facts.items():
        item = F.struct(F.col(time).alias("at"), *values)
        both = both.unionByName(frame.select(*key, F.col(time).alias("__t"), F.lit(0).alias("__side"), item.alias(name)), allowMissingColumns=True)
    order = Window.partitionBy(*key).orderBy("__t", "__side", *facts).rowsBetween(Window.unboundedPreceding, 0)
    carried = {f"__{name}": F.last(name, ignorenulls=True).over(order) for name in facts}
    out = both.repartition(*key).withColumns(carried).where("__side = 1")
    return out.select("__row.*", *[F.col(f"__{name}").alias(name) for name in facts])


def first_crossing(
    left: DataFrame, bars: DataFrame, metric: Column, level: str, above: bool, after: str = "after", name: str = "hit", reach: bool = False
) -> DataFrame:
    """``left`` (symbol, tf, ``after``, ``level``) with the first bar i > after whose
    metric is beyond the level (or, with ``reach``, at it), as ``name``; null if none.

    Bins of ``BIN`` bars carry their extreme metric; a row looks for the first bin
    that can hold its bar and then inside that bin and its own first one, so it
    meets about n / BIN + 2 BIN bars instead of n.
    """
    key = ["symbol", "tf"]
    extreme = F.max if above else F.min
    strict = (lambda m: m > F.col(level)) if above else (lambda m: m < F.col(level))
    beyond = (lambda m: strict(m) | (m == F.col(level))) if reach else strict
    series = bars.select(*key, F.col("i").alias("__i"), F.floor(F.col("i") / BIN).alias("__bin"), metric.alias("__m")).where("__m is not null")
    bins = series.groupBy(*key, "__bin").agg(extreme("__m").alias("__x"))
    base = left.withColumn("__row", F.struct(*key, after, level))
    wanted = base.select(*key, after, level, "__row").distinct()
    own = F.floor(F.col(after) / BIN)
    # The bins to look into: a row's own and the first later one that can hold its bar.
    later = F.min(F.when((F.col("__bin") > own) & beyond(F.col("__x")), F.col("__bin")))
    told = wanted.join(bins, key).groupBy("__row").agg(later.alias("__later")).select("__row", "__row.*", "__later")
    where = told.select("__row", *key, after, level, F.explode(F.array_compact(F.array(own, "__later"))).alias("__bin"))
    hits = (
        where.join(series, [*key, "__bin"])
        .where((F.col("__i") > F.col(after)) & beyond(F.col("__m")))
        .groupBy("__row")
        .agg(F.min("__i").alias(name))
    )
    return base.join(hits, "__row", "left").drop("__row")


def meeting_bars(left: DataFrame, bars: DataFrame, bottom: str, top: str, after: str, until: str) -> DataFrame:
    """``left`` with every bar j in (after, until) whose low to high meets [bottom, top].

    Bins of ``BIN`` bars carry their least low and greatest high; only the bars of
    bins that can hold a match are looked at. A null ``until`` is no limit.
    """
    key = ["symbol", "tf"]
    series = bars.withColumn("__bin", F.floor(F.col("j") / BIN))
    bins = series.groupBy(*key, "__bin").agg(F.min("low").alias("__low"), F.max("high").alias("__high"))
    end = F.coalesce(F.col(until), F.lit(2**62))
    some = (
        left.join(bins, key)
        .where((F.col("__bin") >= F.floor(F.col(after) / BIN)) & (F.col("__bin") <= F.floor(end / BIN)))
        .where((F.col("__low") <= F.col(top)) & (F.col("__high") >= F.col(bottom)))
        .drop("__low", "__high")
    )
    return (
        some.join(series, [*key, "__bin"])
        .where((F.col("j") > F.col(after)) & (F.col("j") < end) & (F.col("low") <= F.col(top)) & (F.col("high") >= F.col(bottom)))
        .drop("__bin")
    )


def held_window(left: DataFrame, bars: DataFrame, start: str, horizon: int, columns: Sequence[str]) -> DataFrame:
    """Each left row with every bar i in [start, start + horizon), by equi-join on bins."""
    bins = F.sequence(F.floor(F.col(start) / horizon), F.floor((F.col(start) + horizon - 1) / horizon))
    spread = left.withColumn("__bin", F.explode(bins))
    series = bars.select("symbol", "tf", "i", F.floor(F.col("i") / horizon).alias("__bin"), *columns)
    return (
        spread.join(series, ["symbol", "tf", "__bin"])
        .where((F.col("i") >= F.col(start)) & (F.col("i") < F.col(start) + horizon))
        .drop("__bin")
    )


def fold_series(frame: DataFrame, step, schema: str, key: Sequence[str] = ("symbol", "tf")) -> DataFrame:
    """A recurrence that feeds back on its own output: one pandas pass per series."""
    return frame.groupBy(*key).applyInPandas(step, schema)


def first_beyond(
    left: DataFrame, bars: DataFrame, up: Column, up_metric: Column, up_level: str, down_metric: Column, down_level: str,
    after: str = "after", name: str = "hit", reach: bool = False,
) -> DataFrame:
    """``left`` with the first bar i > after that is beyond a level: rows that are ``up``
    look for ``up_metric`` above ``up_level``, others for ``down_metric`` below ``down_level``.

    Both sides are one search: downward ones are turned by their sign, and the side is
    part of the key, so that no two plans are joined after a union.
    """
    sides = F.array(F.struct(F.lit(True).alias("up"), up_metric.alias("m")), F.struct(F.lit(False).alias("up"), (-down_metric).alias("m")))
    series = bars.select("symbol", "tf", "i", F.explode(sides).alias("__s"))
    series = series.select(F.concat_ws("|", "symbol", F.col("__s.up").cast("string")).alias("symbol"), "tf", "i", F.col("__s.m").alias("__metric"))
    facts = left.withColumn("__plain", F.col("symbol")).withColumn("__level", F.when(up, F.col(up_level)).otherwise(-F.col(down_level)))
    facts = facts.withColumn("symbol", F.concat_ws("|", "symbol", up.cast("string")))
    found = first_crossing(facts, series, F.col("__metric"), "__level", True, after=after, name=name, reach=reach)
    return found.withColumn("symbol", F.col("__plain")).drop("__plain", "__level")


def _power(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def active_blocks(first: Column, end: Column, depth: Column) -> Column:
    """The dyadic blocks (k, block) that make up the whole numbers of [first, end)."""
    size = _power
    low = lambda k: F.floor((first + size(k) - 1) / size(k))
    high = lambda k: F.floor(end / size(k))
    block = lambda k, at, held: F.when(held & (low(k) < high(k)), F.struct(k.alias("k"), at.cast("long").alias("block")))
    ends = F.transform(
        F.sequence(F.lit(0), depth), lambda k: F.array(block(k, low(k), low(k) % 2 == 1), block(k, high(k) - 1, high(k) % 2 == 1))
    )
    return F.array_compact(F.flatten(ends))


def nearest_active(wanted: DataFrame, levels: DataFrame, step: Column, name: str = "target") -> DataFrame:
    """``wanted`` (symbol, tf, long, price, as_of) with the nearest level beyond its price
    that is active then: above it among the HIGH levels for a long row, else below it among
    the LOW ones; null if none.

    ``levels`` are (symbol, tf, kind, level, known, gone): active in [known, gone), for ever
    with a null ``gone``. ``step`` is the seconds between two times of a series.

    A level's interval is cut into dyadic blocks of the series' steps, some two for each
    power of two; a row lies in one block of each. Within a block every level is active for
    every row, so the nearest one comes from an as-of join in order of price. No row meets
    a level in vain: both sides grow by the logarithm of the series' length.
    """
    key = ["symbol", "tf"]
    asked = wanted.select(*key, "long", "price", "as_of").distinct()
    span = asked.groupBy(*key).agg(F.min("as_of").alias("__lo"), F.max("as_of").alias("__hi"))
    span = span.withColumn("__n", F.floor((F.col("__hi") - F.col("__lo")) / step) + 1)
    span = span.withColumn("__depth", F.ceil(F.log2(F.col("__n") + 1)).cast("int"))
    place = lambda c: F.ceil((F.col(c) - F.col("__lo")) / step)
    sign = F.when(F.col("kind") == "HIGH", -1.0).otherwise(1.0)
    held = (
        levels.join(span, key)
        .withColumns({"__a": F.greatest(place("known"), F.lit(0)), "__b": F.least(F.coalesce(place("gone"), "__n"), F.col("__n"))})
        .where("__a < __b")
        .select(*key, "kind", "level", F.explode(active_blocks(F.col("__a"), F.col("__b"), F.col("__depth"))).alias("at"))
        .select(*key, "kind", "level", "at.k", "at.block", (sign * F.col("level")).alias("__order"))
    )
    rows = (
        asked.join(span, key)
        .withColumn("kind", F.when(F.col("long"), "HIGH").otherwise("LOW"))
        .withColumn("__q", F.floor((F.col("as_of") - F.col("__lo")) / step))
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("__depth"))))
        .select(*key, "long", "price", "as_of", "kind", "k", F.floor(F.col("__q") / _power(F.col("k"))).alias("block"), (sign * F.col("price")).alias("__order"))
    )
    met = asof(rows, held, [*key, "kind", "k", "block"], "__order", "__order", ["level"], strict=True)
    best = F.when(F.col("long"), F.min("level")).otherwise(F.max("level"))
    found = met.where("level is not null").groupBy(*key, "long", "price", "as_of").agg(best.alias(name))
    return wanted.join(found, [*key, "long", "price", "as_of"], "left")
