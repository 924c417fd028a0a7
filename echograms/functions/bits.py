"""Bit tables: a set of 64-bit values of any size as a bounded number of bits, gathered by aggregation and sent to the tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 15


class Bits:
    """A set of 64-bit values as one bit for each value's low part; it may let others pass."""

    def __init__(self, size: int):
        self.size, self.table = size, np.zeros(size // 8, dtype=np.uint8)

    def test(self, values: np.ndarray) -> np.ndarray:
        place = values.astype(np.uint64) & np.uint64(self.size - 1)
        return (self.table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bit_table(df: DataFrame, column: str, n: int) -> Bits:
    """The values of a long column, about n distinct ones, as Bits: 32 to 64 bits for each value, and at most 2^27 bits (16 MB) whatever n is.

    The bits are gathered in pieces of 4 KB by aggregation; at most 4096 of them reach the driver."""
    bits = Bits(1 << min(27, max(15, (32 * max(1, n)).bit_length())))
    place = F.col(column).bitwiseAND(bits.size - 1)
    pieces = df.groupBy(F.floor(place / PIECE).alias("piece")).agg(F.bitmap_construct_agg(place.bitwiseAND(PIECE - 1)).alias("map"))
    for r in pieces.collect():
        bits.table[r.piece * PIECE // 8 : (r.piece + 1) * PIECE // 8] = np.frombuffer(bytes(r["map"]), np.uint8)
    return bits
