"""Line dedup: a suffix array over line sequences by distributed prefix doubling.

Every document is a sequence of line ids. Ranks at depth h number the suffixes by
their first h lines, equal ones alike; two neighbouring ranks make the ranks at depth
2h. Suffixes of one rank are an interval of the suffix array whose longest common
prefix is at least h lines. A suffix whose rank is alone has left every interval and is
dropped, so the rounds shrink to the repeated runs and end after log2 of the longest one.

A place's run is the longest common prefix that it has with any earlier place in
(id, line) order. Doubling gives its power of two; the intervals between h and 2h are
then halved: a part of an interval that shares the longer prefix goes up, and of each
part the first place alone goes down, as the other places have at least that length.
A run inside the one that starts before it is not maximal and left out. Maximal runs
are copies of their first places, and their lines are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, together

#: A repeated single line counts from this many words on; two lines and more always.
MIN_WORDS = 5
_PLACE = ["id", "tid", "k"]
_RUN = "id long, tid long, k int, length int, first struct<id:long,tid:long,k:int>"


def _lines(text: Column) -> Column:
    """The lines with their numbers, without blank ones."""
    numbered = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    return F.filter(numbered, lambda x: F.trim(x["line"]) != "")


def _words(line: Column) -> Column:
    return F.size(F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def _keys(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """A document's key: its id, the least long where null, and a hash of its text."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _place() -> Column:
    return F.struct(*_PLACE)


def _classes(rows: DataFrame, *key: str) -> DataFrame:
    """(key, rank, first): the keys of two rows or more, with their first place.

    The number of this place is the class's rank; equal ranks are one class, and their
    order says nothing.
    """
    found = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct(*_PLACE, "number")).alias("at")).where("n > 1")
    return found.select(*key, F.col("at.number").alias("rank"), F.struct(*[F.col(f"at.{c}") for c in _PLACE]).alias("first"))


def suffix_ranks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[DataFrame]]:
    """(lines, ranks): all lines, and for the depths 1, 2, 4, ... the repeated suffixes.

    ``lines`` has id, tid, k (number among the non-blank lines), pos (line number),
    words. ``ranks[j]`` has id, tid, k, rank, first, depth, number: the suffixes whose
    first depth = 2 ** j lines stand at two places or more, with their rank and the first
    of these places. ``number`` is the place's own. A round is one written table and one
    join, as the driver plans again whenever a shuffle ends.
    """
    ident, tid = _keys(docs, id_col, text_col)
    lines = materialize(
        docs.select(ident.alias("id"), tid.alias("tid"), F.posexplode(_lines(F.col(text_col))).alias("k", "x")).select(
            "id", "tid", "k", F.col("x.pos").alias("pos"), F.xxhash64("x.line").alias("h1"),
            F.xxhash64(F.lit(1), "x.line").alias("h2"), _words(F.col("x.line")).alias("words"),
            F.monotonically_increasing_id().alias("number"),
        ),
        "lines",
    )
    columns = [*_PLACE, "rank", "first", "depth"]
    found = lines.join(_classes(lines, "h1", "h2"), ["h1", "h2"]).withColumn("depth", F.lit(1))
    # Rows that repeat id and text have the same places, and each place one number.
    now = materialize(found.groupBy(*columns).agg(F.min("number").alias("number")), "line-ranks")
    ranks = []
    while not now.isEmpty():
        ranks.append(now)
        depth = 1 << (len(ranks) - 1)
        ahead = Window.partitionBy("id", "tid").orderBy("k").rangeBetween(depth, depth)
        pairs = now.select(
            *_PLACE, (F.col("depth") * 2).alias("depth"), "number", F.col("rank").alias("a"), F.max("rank").over(ahead).alias("b")
        ).where("b is not null")
        now = materialize(pairs.join(_classes(pairs, "a", "b"), ["a", "b"]).select(*columns, "number"), "line-ranks")
    return lines, ranks


def _later(ranks: DataFrame) -> DataFrame:
    """Places whose first ``depth`` lines also stand at an earlier place, and the first such place."""
    return ranks.where(_place() > F.col("first")).select(*_PLACE, F.col("depth").alias("length"), "first")


def _halved(ranks: list[DataFrame]) -> DataFrame | None:
    """Lengths between powers of two: id, tid, k, length, first, of which a place's largest counts.

    A part is (depth, low, head): the places of the interval of ``low`` lines that
    starts at ``head``. All depths are halved together; a round is one written table.
    """
    if len(ranks) < 2:
        return None
    key, rounds, parts = ["depth", "low", "head"], [], None
    columns = [*key, *_PLACE, "step"]
    later = F.col("first").isNotNull() & (_place() > F.col("first"))
    # Later copies of twice the depth have at least that length.
    longest = F.max(F.when(later, F.col("depth"))).over(Window.partitionBy(*_PLACE))
    every = together(ranks).select("depth", *_PLACE, "rank", "first", (F.coalesce(longest, F.lit(0)) <= F.col("depth")).alias("open"))
    every = materialize(every, "line-parts")
    # Depth h has the steps h / 2, h / 4, ..., 1.
    for j in range(len(ranks) - 1, 0, -1):
        fresh = every.where(F.col("open") & (F.col("depth") == 1 << j)).select(
            "depth", F.col("depth").alias("low"), F.col("first").alias("head"), *_PLACE, F.shiftright("depth", 1).alias("step")
        )
        parts = fresh if parts is None else parts.unionByName(fresh)
        known = every.where(F.col("depth") >= 1 << j).select("depth", "id", "tid", F.col("k").alias("at"), F.col("rank").alias("next"))
        due = parts.withColumn("at", F.col("k") + F.col("low") + F.col("step") - F.col("depth"))
        there = F.max("next").over(Window.partitionBy("depth", "id", "tid", "at"))
        told = due.unionByName(known, allowMissingColumns=True).withColumn("next", there).where("low is not null").drop("at")
        groups = (
            told.where("next is not null").groupBy(*key, "next")
            .agg(F.count("*").alias("n"), F.min(_place()).alias("first")).where("n > 1").drop("n")
        )
        # Places that share the longer prefix with others have the first of these.
        halves = materialize(told.join(groups, [*key, "next"], "left").drop("next"), "line-halves")
        rounds.append(halves)
        up = halves.where("first is not null").select("depth", (F.col("low") + F.col("step")).alias("low"), F.col("first").alias("head"), *_PLACE, "step")
        parts = up.unionByName(halves.where(~later).select(*columns)).withColumn("step", F.shiftright("step", 1))
    return together(rounds).where(later).select(*_PLACE, (F.col("low") + F.col("step")).alias("length"), "first")


def maximal_runs(ranks: list[DataFrame], docs: DataFrame) -> DataFrame:
    """(id, tid, k, length, first): the maximal runs that also stand at an earlier place.

    ``length`` lines from k on stand at ``first`` and on, the earliest such place; no
    longer run from k does, and the run does not lie in one that starts before it.
    """
    if not ranks:
        return docs.sparkSession.createDataFrame([], _RUN)
    copies = _later(together(ranks))
    if (between := _halved(ranks)) is not None:
        copies = copies.unionByName(between)
    best = copies.groupBy(*_PLACE).agg(F.max_by("first", "length").alias("first"), F.max("length").alias("length"))
    before = F.max(F.col("k") + F.col("length")).over(Window.partitionBy("id", "tid").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    ends = best.withColumn("before", F.coalesce(before, F.lit(0)))
    return ends.where(F.col("k") + F.col("length") > F.col("before")).select(*_PLACE, "length", "first")


def deleted_lines(lines: DataFrame, runs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, tid, pos): the lines of runs of two lines or more, and single ones of ``min_words`` words."""
    # Each run marks the lines that no run before it has marked.
    series = Window.partitionBy("id", "tid").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("k") + F.col("length")
    until = F.coalesce(F.max(F.when(F.col("length") > 1, end)).over(series), F.lit(0))
    marks = runs.withColumn("from", F.greatest("k", until)).select(
        "id", "tid", F.explode(F.sequence(F.col("from"), end - 1)).alias("k"), (F.col("length") > 1).alias("long")
    )
    return lines.join(marks, _PLACE).where(F.col("long") | (F.col("words") >= min_words)).select("id", "tid", "pos")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated line runs cut out of the text.

    Adds n_lines (non-blank lines), n_removed, longest_run (lines of the longest
    maximal run, 0 if none) and runs (text: ``k+length<id:k`` of each maximal run,
    in order, with the id and line of its first place; empty if none). A run counts
    from two lines on, or as one line of at least ``min_words`` words; shorter ones
    are told but not deleted. Blank lines neither part runs nor are deleted. A null
    text stays null. Texts that lose every line keep their blank lines. Rows that
    repeat id and text are one document and are cut alike; a null id comes before
    all others. An empty table gives no rows. Input columns with the added names
    are replaced; all others are kept.
    """
    docs = docs.drop("n_lines", "n_removed", "longest_run", "runs")
    lines, ranks = suffix_ranks(docs, id_col, text_col)
    runs = materialize(maximal_runs(ranks, docs), "line-runs")
    gone = deleted_lines(lines, runs, min_words)
    # A few numbers for each document that has runs.
    origin = F.when(F.col("first.id") == -(2**63), "null").otherwise(F.col("first.id").cast("string"))
    item = F.struct("k", F.concat("k", F.lit("+"), "length", F.lit("<"), origin, F.lit(":"), "first.k").alias("told"))
    told = runs.groupBy("id", "tid").agg(
        F.max("length").alias("__longest"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["told"]), " ").alias("__runs")
    )
    cuts = materialize(
        told.join(gone.groupBy("id", "tid").agg(F.collect_set("pos").alias("__gone")), ["id", "tid"], "left")
        .withColumnsRenamed({"id": "__id", "tid": "__tid"}),
        "line-cuts",
    )
    ident, tid = _keys(docs, id_col, text_col)
    keyed = docs.withColumns({"__k1": ident, "__k2": tid})
    all_docs = keyed.join(cuts, (F.col("__k1") == F.col("__id")) & (F.col("__k2") == F.col("__tid")), "left")
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(F.col("__gone"), i))
    return all_docs.select(
        *[
            F.when(F.col("__gone").isNull(), F.col(c)).otherwise(F.array_join(kept, "\n")).alias(c) if c == text_col else keyed[c]
            for c in docs.columns
        ],
        F.size(_lines(F.col(text_col))).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("__longest", F.lit(0)).cast("long").alias("longest_run"),
        F.coalesce("__runs", F.lit("")).alias("runs"),
    )


#: DuckDB SQL of the query's columns, from all pairs of equal lines.
SQL = rf"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT doc_id, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS pos FROM s),
b AS (
  SELECT doc_id, line, pos, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
    row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k
  FROM l WHERE trim(line) <> ''
),
e AS (
  SELECT p.doc_id, p.k, q.doc_id AS d, p.k - q.k AS lag
  FROM b p JOIN b q ON p.line = q.line AND (q.doc_id < p.doc_id OR q.doc_id = p.doc_id AND q.k < p.k)
),
i AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, d, lag ORDER BY k) AS island FROM e),
x AS (SELECT *, max(k) OVER (PARTITION BY doc_id, d, lag, island) - k + 1 AS length FROM i),
f AS (SELECT doc_id, k, max(length) AS length, arg_min((d, k - lag), (-length, d, k - lag)) AS first FROM x GROUP BY doc_id, k),
m AS (
  SELECT * FROM (SELECT *, max(k + length) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f)
  WHERE before IS NULL OR k + length > before
),
g AS (
  SELECT DISTINCT b.doc_id, b.k FROM b JOIN m ON m.doc_id = b.doc_id AND b.k >= m.k AND b.k < m.k + m.length
  WHERE m.length > 1 OR b.words >= {MIN_WORDS}
),
n AS (
  SELECT b.doc_id, count(*) AS n_lines, count(g.k) AS n_removed
  FROM b LEFT JOIN g ON b.doc_id = g.doc_id AND b.k = g.k GROUP BY b.doc_id
),
r AS (
  SELECT doc_id, max(length) AS longest_run, string_agg(k || '+' || length || '<' || first[1] || ':' || first[2], ' ' ORDER BY k) AS runs
  FROM m GROUP BY doc_id
),
t AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text
  FROM l LEFT JOIN b ON l.doc_id = b.doc_id AND l.pos = b.pos LEFT JOIN g ON b.doc_id = g.doc_id AND b.k = g.k
  WHERE g.k IS NULL GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(longest_run, 0)::BIGINT AS longest_run, coalesce(runs, '') AS runs,
  CASE WHEN d.text IS NOT NULL THEN coalesce(t.text, '') END AS text
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
