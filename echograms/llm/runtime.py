"""What the operators share: tables written to the shared folder, bit tables for tasks, and equal-depth key ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echograms.functions.bits import Bits, bit_table
from echograms.sources.shared import cut, shared_folder

__all__ = ["Bits", "bit_table", "cut", "equal_depth_cuts", "range_index", "shared_folder"]


def equal_depth_cuts(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most `parts` values of the long column key that split the rows into ranges of about equal size, in order; a value that fills several ranges
    comes as often. The first is the smallest value. The list is bounded by parts, whatever the table's size."""
    if parts < 1:
        raise ValueError("parts must be positive")
    shares = [i / parts for i in range(1, parts)]
    row = df.agg(F.min(key).alias("lo"), F.percentile_approx(key, F.array(*[F.lit(s) for s in shares]), 20 * parts).alias("q") if shares else F.array().alias("q")).first()
    if row.lo is None:
        return []
    return sorted([row.lo, *row.q])


def range_index(key: Column, cuts: list[int]) -> Column:
    """0-based index of the last cut that is at most key, by binary search over a literal array."""
    if len(cuts) < 2:
        return F.lit(0)
    table = F.array(*[F.lit(c).cast("long") for c in cuts])
    steps, s = [], 1
    while s < len(cuts):
        steps.append(s)
        s *= 2
    jumps = F.array(*[F.lit(x) for x in reversed(steps)])
    return F.aggregate(jumps, F.lit(0), lambda at, jump: F.when((at + jump < F.lit(len(cuts))) & (F.get(table, F.least(at + jump, F.lit(len(cuts) - 1))) <= key), at + jump).otherwise(at))
