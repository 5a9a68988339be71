"""What Python tasks of the corpus operators get at once."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barstrata.llm.common import BATCH_BYTES
from barstrata.llm.packing import pack
from barstrata.llm.queries import tokenizer_path
from barstrata.llm.toxicity import drop_toxic

LABELS = "doc_id long, toxic long"


@pytest.fixture
def spark(spark):
    """A session whose settings are its own."""
    own = spark.newSession()
    yield own


def _texts(spark, n, words):
    """One partition of ``n`` texts of as many of 5,000 words."""
    long = F.transform(F.sequence(F.lit(1), F.lit(words)), lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("doc_id", k), F.lit(5000)).cast("string")))
    return spark.range(n, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", long).alias("text"))


def _seen():
    """A task that tells the bytes of each batch's texts."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"bytes": [int(frame["text"].str.len().sum())]})

    return run


def _drop(spark, docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], LABELS)
    assert drop_toxic(docs, labels).count() <= docs.count()


def _pack(spark, docs):
    assert pack(docs, tokenizer_path()).select("doc_id").distinct().count() == docs.count()


@pytest.mark.parametrize("stage", [_drop, _pack])
def test_tasks_get_rows_by_bytes(spark, stage):
    docs = _texts(spark, 3000, 600)
    stage(spark, docs.limit(20))
    sizes = [r["bytes"] for r in docs.mapInPandas(_seen(), "bytes long").collect()]
    assert sum(sizes) > 2 * BATCH_BYTES
    assert max(sizes) <= 1.1 * BATCH_BYTES
