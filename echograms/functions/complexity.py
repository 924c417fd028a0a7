"""Measures of texts from symbol counts and common prefixes: entropy, complexity sums, distances."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echograms.functions.suffix_kernels import SuffixOrder, text_runs, widths


def symbols(texts: DataFrame) -> DataFrame:
    """(text_id, pos, sym) for every character."""
    return texts.where(F.length("body") > 0).select("text_id", F.posexplode(F.split("body", "")).alias("pos", "sym"))


def symbol_frequency(texts: DataFrame) -> DataFrame:
    """(text_id, sym, n)."""
    return symbols(texts).groupBy("text_id", "sym").agg(F.count("*").alias("n"))


def entropy(frequency: DataFrame) -> DataFrame:
    """(text_id, n, bits, total_bits, est_bytes): bits a symbol, bits in all, and the size in bytes that arithmetic coding comes near."""
    p = F.col("n") / F.col("total")
    per = frequency.withColumn("total", F.sum("n").over(Window.partitionBy("text_id"))).groupBy("text_id").agg(F.first("total").alias("n"), F.sum(-p * F.log2(p)).alias("bits"))
    total = F.round(F.col("bits") * F.col("n"), 6)  # so that a whole number of bits is not one more by rounding
    return per.withColumn("total_bits", F.col("bits") * F.col("n")).withColumn("est_bytes", F.floor((F.ceil(total) + 7) / 8))


def repeated_symbols(rows: DataFrame, order: str = "pos") -> DataFrame:
    """(text_id, zeros): how many symbols equal the one before; a first symbol of code 0 counts too. This is the number of zeros that moving
    symbols to the front gives."""
    w = Window.partitionBy("text_id").orderBy(order)
    same = rows.withColumn("before", F.coalesce(F.lag("sym").over(w), F.lit("\u0000")))
    return same.groupBy("text_id").agg(F.count_if(F.col("sym") == F.col("before")).alias("zeros"))


def repeated_symbols_of(texts: DataFrame) -> DataFrame:
    """repeated_symbols(symbols(texts)) without a row for each character: a text loses the characters that the next one equals, and is that much shorter. Only a
    count for each text is shuffled; texts that share an id are summed."""
    kept = F.regexp_replace("body", r"(?s)(.)(?=\1)", "")
    zeros = F.length("body") - F.length(kept) + F.startswith("body", F.lit("\u0000")).cast("int")
    return texts.where(F.length("body") > 0).select("text_id", zeros.alias("zeros")).groupBy("text_id").agg(F.sum("zeros").alias("zeros"))


def bwt_symbols(suffixes: DataFrame, texts: DataFrame) -> DataFrame:
    """(text_id, rank, sym): the transform that belongs to a suffix order, with the row of the low terminator as rank -1; the terminator itself is code 0."""
    last = texts.where(F.length("body") > 0).select("text_id", F.lit(-1).cast("long").alias("rank"), F.right("body", F.lit(1)).alias("sym"))
    return suffixes.select("text_id", "rank", F.when(F.col("left") == "", F.lit("\u0000")).otherwise(F.col("left")).alias("sym")).union(last)


def _prefix_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, _, texts in text_runs(batch, 1):
            order = SuffixOrder(texts)
            text, prefixes = order.text[order.order], order.common_prefixes()
            inner = np.concatenate([text[1:] == text[:-1], [False]]) if len(text) else np.zeros(0, bool)  # the last rank of a text has no neighbour
            wide = int(prefixes.max(initial=0)) + 1
            keys, n = np.unique(text[inner] * wide + prefixes[inner], return_counts=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a).take(pa.array(keys // wide)), pa.array(keys % wide), pa.array(n)], ["text_id", "lcp", "n"])


def lcp_counts(texts: DataFrame) -> DataFrame:
    """(text_id, lcp, n): the multiset of common prefixes of neighbours in each text's suffix order (the last rank has none). One map pass."""
    return texts.select("text_id", "body").mapInArrow(_prefix_counts, "text_id long, lcp long, n long")


def _rectangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, _, texts in text_runs(batch, 1):
            order = SuffixOrder(texts)
            prefixes = order.common_prefixes()
            text = order.text[order.order]
            base = widths(prefixes, np.diff(order.offsets))
            at = np.flatnonzero(np.concatenate([text[1:] == text[:-1], [False]])) if len(text) else text  # the last rank of a text has no neighbour
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a).take(pa.array(text[at])), pa.array(at - order.offsets[text[at]]), pa.array(prefixes[at]), pa.array(base[at])], ["text_id", "rank", "lcp", "base"])


def rectangles(texts: DataFrame) -> DataFrame:
    """(text_id, rank, lcp, base) for each rank but the last: base is how many suffixes in a row, this and the next among them, share lcp characters. lcp
    times base is the score of low complexity. One map pass."""
    return texts.select("text_id", "body").mapInArrow(_rectangles, "text_id long, rank long, lcp long, base long")


def in_lcp_class(lcp: Column, n: Column, kind: str) -> Column:
    """Whether a common prefix is in a class, given the length n of its text and k, the least whole number with 4^k >= n: "long" (at least k), "below"
    (k - 1), "half" (k / 2, rounded down) or "ten" (10)."""
    k = F.ceil(F.round(F.log2(n.cast("double")) / 2, 9))
    return {"long": lcp >= k, "below": lcp == k - 1, "half": lcp == F.floor(k / 2), "ten": lcp == 10}[kind]


def lcp_array(counts: DataFrame) -> DataFrame:
    """(text_id, i, lcp): the multiset spread out in ascending order, i from 0."""
    w = Window.partitionBy("text_id").orderBy("lcp")
    placed = counts.withColumn("first", F.sum("n").over(w) - F.col("n"))
    return placed.select("text_id", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("i"), "lcp")


def complexity(counts: DataFrame, ids: DataFrame) -> DataFrame:
    """(text_id, k): 1 plus the sum of 1 / (lcp + 1) over neighbours; 1 for a text of one character, 0 for none."""
    sums = counts.groupBy("text_id").agg(F.sum(F.col("n") / (F.col("lcp") + 1)).alias("s"))
    return ids.select("text_id", F.length("body").alias("n")).join(sums, "text_id", "left").select("text_id", F.when(F.coalesce("n", F.lit(0)) > 0, 1 + F.coalesce("s", F.lit(0.0))).otherwise(F.lit(0.0)).alias("k"))


def complexity_by(array: DataFrame, f: Callable[[Column, Column], Column], name: str = "k") -> DataFrame:
    """1 plus the sum of f(i, lcp) over the ascending array."""
    return array.groupBy("text_id").agg((1 + F.sum(f(F.col("i"), F.col("lcp")))).alias(name))


def half_digits(i: Column) -> Column:
    """floor(log4(i + 1)) from binary digits."""
    return F.floor((F.length(F.bin(i + 1)) - 1) / 2)


def inverse(i: Column, v: Column) -> Column:
    return 1 / (v + 1)


def normalised(i: Column, v: Column) -> Column:
    return (i - v) / (i + 1)


def de_bruijn(i: Column, v: Column) -> Column:
    """1 / (v - l + 1) with l = floor(log4(i + 1)), or 0 where that is above v."""
    low = half_digits(i)
    return 1 / (v - F.when(low > v, 0).otherwise(low) + 1)


def squared(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda i, v: f(i, v) * f(i, v)


def six_measures(array: DataFrame) -> DataFrame:
    """(text_id, k_offset, k_offset2, k_norm, k_norm2, k_inv, k_inv2): 1 plus sums over the ascending array, with l = least(floor(log4(i + 1)), lcp):
    1 / (lcp - l + 1), (i - lcp) / (i - l + 1), 1 / (lcp + 1), and their squares."""
    v, i = F.col("lcp"), F.col("i")
    low = F.least(half_digits(i), v)
    terms = {"k_offset": 1 / (v - low + 1), "k_norm": (i - v) / (i - low + 1), "k_inv": 1 / (v + 1)}
    sums = [x for n, t in terms.items() for x in ((1 + F.sum(t)).alias(n), (1 + F.sum(t * t)).alias(f"{n}2"))]
    return array.groupBy("text_id").agg(*sums)


def log_complexity(starts: DataFrame, base: float = 4.0) -> DataFrame:
    """(text_id, k_log): sum of log_base((r + 2) / (r + 1)) over positions, r being the longest repeat that starts there."""
    return starts.groupBy("text_id").agg((F.sum(F.ln((F.col("len") + 2) / (F.col("len") + 1))) / F.ln(F.lit(base))).alias("k_log"))


def log_curve(starts: DataFrame, base: float = 4.0) -> DataFrame:
    """(text_id, pos, curve): the running sum of the terms of log_complexity."""
    w = Window.partitionBy("text_id").orderBy("pos")
    return starts.select("text_id", "pos", (F.sum(F.ln((F.col("len") + 2) / (F.col("len") + 1))).over(w) / F.ln(F.lit(base))).alias("curve"))


def prefix_ratios(counts: DataFrame, base: int) -> DataFrame:
    """(text_id, n, k, bound, ratio) for a list of values (text_id, n, z), n from 1: k is the largest z so far, bound n / ln n, ratio
    (2 (n - 1) / ln(n - 1) + 1 / ((k + 1) ln base)) / bound; null where a logarithm is not positive."""
    w = Window.partitionBy("text_id").orderBy("n")
    f = lambda n: F.when(n > 1, n / F.ln(n))
    rows = counts.withColumn("k", F.greatest(F.lit(0), F.max("z").over(w))).withColumn("bound", f(F.col("n")))
    return rows.select("text_id", "n", "k", "bound", ((2 * f(F.col("n") - 1) + 1 / ((F.col("k") + 1) * F.ln(F.lit(float(base))))) / F.col("bound")).alias("ratio"))


def distance(ab: Column, a: Column, b: Column) -> Column:
    """(value of both together - the smaller) / the larger."""
    return (ab - F.least(a, b)) / F.greatest(a, b)


def zero_gain(ab: Column, a: Column, b: Column) -> Column:
    """What both together have more than apart, at least 0."""
    return F.greatest(F.lit(0).cast("long"), ab - a - b)


def zero_norm(ab: Column, a: Column, b: Column, n: Column) -> Column:
    return 1 - zero_gain(ab, a, b) / n
