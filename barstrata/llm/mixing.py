"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's mean repetition rate is (its target weight x budget) / its size. Each
document's uniform number comes from a seeded hash of its id; inverting the Poisson
distribution with that mean gives its count, the document is exploded by the count,
and a second hash deals all copies over the output at random. Counts depend on the
seed and the id alone, so a recomputed task gives the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A mean above this is the sum of several smaller Poisson numbers, whose
#: distribution functions then need no more than ``_TERMS`` terms in doubles.
_LARGEST_MEAN = 16.0
_TERMS = 96
#: Parts that the rows of a source are dealt over where they are joined by shuffling.
_SALTS = 16


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of the key's MD5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / float(2**52)


def source_rates(
    docs: DataFrame,
    source_col: str = "source",
    size_col: str = "size",
    weights: Mapping[str, float] | None = None,
    temperature: float = 0.5,
    budget: float = 1.0,
) -> DataFrame:
    """(source, size, rate): the mean repetitions that meet the target weights.

    ``weights`` gives relative target weights; a source it does not name has
    weight 0. Without it a source's weight is its size to the power
    ``temperature``. ``budget`` is the wanted size of the output over that of the
    input. A null source is a source of its own; sources of size 0 have rate 0.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).cast("double").alias("size"))
    if weights is None:
        weight = F.when(F.col("size") > 0, F.pow("size", F.lit(temperature))).otherwise(0.0)
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
        weight = F.when(F.col("size") > 0, weight).otherwise(0.0)
    weighed = sizes.withColumn("weight", weight)
    total = weighed.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    # One row of two sums; the side that is broadcast is this row.
    return weighed.join(F.broadcast(total)).select(
        "source",
        "size",
        F.when(
            (F.col("weight") > 0) & (F.col("all_weight") > 0),
            F.col("weight") / F.col("all_weight") * F.col("all_size") * F.lit(float(budget)) / F.col("size"),
        )
        .otherwise(0.0)
        .alias("rate"),
    )


def _with_distribution(rates: DataFrame) -> DataFrame:
    """Adds the parts a mean is split into and one part's distribution function."""
    parts = F.greatest(F.ceil(F.col("rate") / _LARGEST_MEAN), F.lit(1)).cast("int")
    mean = F.col("rate") / F.col("parts")
    term = lambda k: F.exp(-mean + k * F.log(mean) - F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0), lambda s, j: s + F.log(j)))
    steps = F.transform(F.sequence(F.lit(0), F.lit(_TERMS - 1)), term)
    sums = F.aggregate(
        steps,
        F.array().cast("array<double>"),
        lambda seen, p: F.concat(seen, F.array(F.coalesce(F.try_element_at(seen, F.lit(-1)), F.lit(0.0)) + p)),
    )
    return rates.withColumn("parts", parts).withColumn("cdf", F.when(F.col("rate") > 0, sums))


def poisson_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Mapping[str, float] | None = None,
    temperature: float = 0.5,
    budget: float = 1.0,
    seed: str = "mix-1",
) -> DataFrame:
    """``docs`` exploded by Poisson counts, dealt at random over the output partitions.

    Adds ``copy_no`` (0 up to the document's count) and ``mix_key`` (a hash that
    orders the output; rows of a partition are sorted by it). A source's size is
    its texts' characters; null and empty texts have size 0 and are repeated at
    their source's rate. Rows with a null id count as one id; rows that repeat an
    id get the same count each. An empty table gives no rows. An input column named
    ``copy_no`` or ``mix_key`` is replaced; all others are kept as they are.
    """
    docs = docs.drop("copy_no", "mix_key")
    size = F.coalesce(F.length(text_col), F.lit(0)).cast("long")
    sized = docs.select(F.col(source_col).alias("__source"), size.alias("__size"))
    rates = source_rates(sized, "__source", "__size", weights, temperature, budget)
    told = _with_distribution(rates.select("source", "rate"))
    table = materialize(told.select(*[F.col(c).alias(f"__{c}") for c in ("source", "rate", "parts", "cdf")]), "mix-rates")
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    # Spark broadcasts the table while it is small; with very many sources it is salted,
    # so that the rows of a hot one go to many tasks.
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    left = docs.withColumn("__salt", F.pmod(F.xxhash64(ident), F.lit(_SALTS)).cast("int"))
    told = left.join(
        salted, left[source_col].eqNullSafe(salted["__source"]) & (left["__salt"] == salted["__salt"]), "left"
    )
    draws = F.transform(
        F.sequence(F.lit(1), F.col("__parts")),
        lambda j: uniform(F.concat_ws(":", F.lit(seed), j.cast("string"), ident)),
    )
    count = F.aggregate(
        draws, F.lit(0), lambda n, u: n + F.size(F.filter("__cdf", lambda c: c <= u))
    )
    copies = told.withColumn("__count", F.when(F.col("__rate") > 0, count).otherwise(0)).where("__count > 0")
    exploded = copies.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("__count") - 1))).withColumn(
        "mix_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("deal"), ident, F.col("copy_no").cast("string")).cast("binary"))
    )
    kept = exploded.select(*[F.col(f"`{c}`") for c in docs.columns], "copy_no", "mix_key")
    return kept.repartition("mix_key").sortWithinPartitions("mix_key", "copy_no")


#: DuckDB SQL of ``poisson_mix`` with the default options and the columns of op2.
SQL = """
WITH d AS (SELECT doc_id, source, coalesce(length(text), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS size FROM d GROUP BY source),
w AS (SELECT source, size, CASE WHEN size > 0 THEN pow(size, 0.5) ELSE 0 END AS weight FROM s),
r AS (
  SELECT source, CASE WHEN weight > 0 THEN weight / (SELECT sum(weight) FROM w) * (SELECT sum(size) FROM w) / size ELSE 0 END AS rate
  FROM w
),
q AS (SELECT source, rate, greatest(ceil(rate / 16.0), 1)::BIGINT AS parts FROM r WHERE rate > 0),
c AS (
  SELECT source, rate, parts, k, sum(exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1)))
    OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM q, (SELECT unnest(range(0, 96)) AS k)
),
f AS (SELECT source, any_value(parts) AS parts, list(cdf ORDER BY k) AS cdf FROM c GROUP BY source),
u AS (
  SELECT doc_id, d.source, cdf, unnest(range(1, parts + 1)) AS j
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source
),
n AS (
  SELECT doc_id, source, sum(len(list_filter(cdf, lambda x: x <= ('0x' || substr(md5('mix-1:' || j || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0))) AS n
  FROM u GROUP BY doc_id, source
),
e AS (SELECT doc_id, source, unnest(range(0, n::BIGINT)) AS copy_no FROM n)
SELECT doc_id, source, copy_no::INTEGER AS copy_no,
  md5('mix-1:deal:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy_no) AS mix_key
FROM e
"""
