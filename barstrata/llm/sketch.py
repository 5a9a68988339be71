"""A bitmap of keys, of one fixed size whatever the data's, that tasks consult before they emit rows.

A key that is in the table always hits; others hit now and then, so rows that pass are
still compared exactly. A full bitmap lets everything pass: it saves shuffles and
decides nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a slot's number: 2 ** 27 bits are 16 MB.
SLOT_BITS = 27


def key_bitmap(keys: DataFrame, bits: int = SLOT_BITS) -> np.ndarray:
    """The bitmap of the one long column of ``keys``; at most 2 ** (bits - 6) words reach the driver."""
    slot = F.col(keys.columns[0]).bitwiseAND(F.lit((1 << bits) - 1))
    words = (
        keys.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("set"))
        .toArrow()
    )
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[words["word"].to_numpy()] = words["set"].to_numpy().view(np.uint64)
    return table


def hits(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key's slot is set."""
    slot = keys.view(np.uint64) & np.uint64(len(table) * 64 - 1)
    return (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
