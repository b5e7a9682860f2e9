"""Sets of hashes as bit maps of a fixed size: a wrong bit is possible, a missing one is not."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 25
FACTOR = 0x3F4A7C15


def slot(value: Column, bits: int = BITS) -> Column:
    """Place of a 64-bit value in the map, the same that ``holds`` computes; no product exceeds 62 bits."""
    low, high = F.shiftrightunsigned(F.shiftleft(value, 32), 32), F.shiftrightunsigned(value, 32)
    return F.pmod(low.bitwiseXOR(high * F.lit(FACTOR)), F.lit(1 << bits))


def bit_map(values: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """``2**(bits - 3)`` bytes, gathered as one row for each 4 KB of them."""
    at = slot(F.col(column), bits)
    rows = values.groupBy(F.bitmap_bucket_number(at + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at + 1)).alias("bits")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for bucket, raw in rows:  # buckets count from 1
        out[(bucket - 1) * len(raw): bucket * len(raw)] = np.frombuffer(raw, np.uint8)[: len(out) - (bucket - 1) * len(raw)]
    return out


def holds(map_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the map has the place of each unsigned 64-bit value."""
    low, high = values & np.uint64(0xFFFFFFFF), values >> np.uint64(32)
    place = (low ^ (high * np.uint64(FACTOR))) % np.uint64(len(map_) * 8)
    return (map_[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
