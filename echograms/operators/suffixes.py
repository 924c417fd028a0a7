"""Suffix order, its inverse, common prefixes and the Burrows-Wheeler transform of every text of a table.

A text is a row (id, text); positions and lengths count code points from 0. The suffix order has a row for each suffix, so everything that
follows from it is a window, join or aggregate over rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from echograms.functions.suffix_kernels import SuffixOrder, as_text, code_points, text_runs

SUFFIXES = "rank long, pos long, lcp long, left string"


def _suffixes(rotations: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, texts in text_runs(batch, 1):
                order = SuffixOrder(texts, rotations=rotations)
                text = order.text[order.order]
                rank = np.arange(len(text)) - order.offsets[:-1][text] if len(text) else np.zeros(0, np.int64)
                ids = batch.column(0).slice(a).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([ids, pa.array(rank), pa.array(order.position), pa.array(order.common_prefixes()), pa.array(as_text(order.lefts()), pa.string())], ["text_id", "rank", "pos", "lcp", "left"])

    return run


def text_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """(text_id, body) from any table; rows whose id is null are left out."""
    return df.select(df[f"`{key}`"].cast("long").alias("text_id"), df[f"`{text}`"].alias("body")).where("text_id is not null")


def suffix_array(texts: DataFrame, rotations: bool = False) -> DataFrame:
    """(text_id, rank, pos, lcp, left) for each suffix of each text (text_id, body).

    Ranks are in code point order, a proper prefix first, as with a terminator below all characters that has no row of its own. lcp is the
    common prefix with the next rank, 0 for the last. left is the character before, empty at the start. With rotations=True, rotations are
    sorted instead, equal ones by position (lcp is then without meaning). text_id may be of any type."""
    return texts.select("text_id", "body").mapInArrow(_suffixes(rotations), StructType([texts.schema["text_id"], *StructType.fromDDL(SUFFIXES)]))


def inverse_suffix_array(suffixes: DataFrame) -> DataFrame:
    """(text_id, pos, rank): the same rows, read the other way round."""
    return suffixes.select("text_id", "pos", "rank")


def capped_lcp(suffixes: DataFrame, cap: int = 255) -> DataFrame:
    """Common prefixes that stop at cap."""
    return suffixes.withColumn("lcp", F.least("lcp", F.lit(cap).cast("long")))


def _transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in text_runs(batch, 1):
            done = SuffixOrder(texts, rotations=True).transforms()
            full = pa.array([i for i, t in enumerate(texts) if t], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([x for x, _ in done], pa.string()), pa.array([r for _, r in done], pa.int64())], ["text_id", "bwt", "prim"]).take(full)


def burrows_wheeler(texts: DataFrame) -> DataFrame:
    """(text_id, bwt, prim): characters before the sorted rotations, and the rank of the text itself; empty texts have no row. One map pass."""
    return texts.select("text_id", "body").mapInArrow(_transform, "text_id long, bwt string, prim long")


def _unwind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follow the last-to-first map by pointer doubling: the map's powers give all positions in log steps."""
    for batch in batches:
        out = []
        for bwt, prim in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            points, _ = code_points([bwt or ""])
            n = len(points)
            if not n:
                out.append("")
                continue
            jump = np.argsort(points, kind="stable")  # from the rank of a rotation to the rank of the one that starts a place later
            rows = np.array([prim])
            while len(rows) < n:
                rows = np.concatenate([rows, jump[rows]])
                jump = jump[jump]
            out.append(points[np.argsort(points, kind="stable")][rows[:n]].tobytes().decode("utf-32-le"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["text_id", "body"])


def inverse_burrows_wheeler(transformed: DataFrame) -> DataFrame:
    """(text_id, body) from (text_id, bwt, prim)."""
    return transformed.select("text_id", "bwt", "prim").mapInArrow(_unwind, "text_id long, body string")


def split_texts(texts: DataFrame, separator: str) -> DataFrame:
    """(text_id, part, start, body): pieces of each text between separators, as texts of their own, so that no pattern crosses one. Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, body in enumerate(batch.column(1).to_pylist()):
                if body is None:
                    continue
                parts = body.split(separator)
                sizes = np.array([len(p) + len(separator) for p in parts])
                ids = batch.column(0).take(pa.array([i] * len(parts)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(len(parts))), pa.array(np.cumsum(sizes) - sizes), pa.array(parts, pa.string())], ["text_id", "part", "start", "body"])

    return texts.select("text_id", "body").mapInArrow(run, StructType([texts.schema["text_id"], *StructType.fromDDL("part long, start long, body string")]))
