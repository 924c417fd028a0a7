"""The sizes that distances by compression compare, of every text in one map pass: each text is sorted once as suffixes and once as rotations, and only numbers
leave the task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from echograms.functions import codecs
from echograms.functions.suffix_kernels import RepeatTree, SuffixOrder, greedy_costs, text_runs

SIZES = "n long, zeros long, est_bytes long, cost8 long, cost3 long, cost3_free long, k double"
CODED = "falls long, lzw_codes long, est_size long, huf_bits long, huf_tbl_bit long, prim long"
COSTS = ((8, True), (3, True), (3, False))


def _complexity(order: SuffixOrder, sizes: np.ndarray) -> np.ndarray:
    """1 plus the sum of 1 / (common prefix + 1) over neighbours; a text's last rank has none."""
    terms = 1 / (order.common_prefixes() + 1)
    full = np.flatnonzero(sizes)
    out = np.zeros(len(sizes))
    terms[order.offsets[1:][full] - 1] = 1
    if len(full):
        out[full] = np.add.reduceat(terms, order.offsets[full])
    return out


def _phrase_sizes(text: str) -> tuple[int, int, int, int]:
    """Of a text's phrase codes: how many, bytes by entropy, bits of their prefix codes, and bits of the description of those."""
    known, counts = np.unique(np.array(codecs.phrases(text.encode()), dtype=np.int64), return_counts=True)
    lengths = codecs.code_lengths(dict(zip(known.tolist(), counts.tolist(), strict=True)))
    bits = np.fromiter((lengths[s] for s in known.tolist()), np.int64, len(known))
    return int(counts.sum()), codecs.coded_bytes(counts), int((counts * bits).sum()), codecs.table_bits(known, bits, codecs.DICTIONARY)


def _sizes(coded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.num_columns - 1
            for a, b, texts in text_runs(batch, given):
                done = SuffixOrder(texts, rotations=True).transforms()
                front = codecs.front_sizes([x.encode() for x, _ in done])
                order = SuffixOrder(texts)
                length, distance = RepeatTree(order).previous()
                costs = [greedy_costs(length, distance, order.offsets, char, far) for char, far in COSTS]
                columns = [front["n"], front["zeros"], front["est_bytes"], *costs, _complexity(order, np.diff(order.offsets))]
                if coded:
                    columns += [front["falls"], *zip(*(_phrase_sizes(x) if x else (0,) * 4 for x, _ in done), strict=True), [r for _, r in done]]
                full = pa.array([i for i, t in enumerate(texts) if t], pa.int64())
                kinds = [*[pa.int64()] * 6, pa.float64(), *[pa.int64()] * (len(columns) - 7)]
                arrays = [*(batch.column(i).slice(a, b - a) for i in range(given)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=[f"c{i}" for i in range(len(arrays))]).take(full)

    return run


def sizes(texts: DataFrame, coded: bool = False) -> DataFrame:
    """The columns of texts but `body`, with SIZES of each text that is not empty: its move-to-front codes after the transform (how many, how many 0, bytes that
    arithmetic coding comes near), bits of three greedy codes by previous repeats, and its complexity. coded adds CODED: falls to 0 among the former, the
    phrase codes of the transform (how many, bytes by entropy, bits of prefix codes and of their table), and the rank of the text among its rotations."""
    rest = [c for c in texts.columns if c != "body"]
    rows = texts.select(*rest, "body")
    return _named(rows.mapInArrow(_sizes(coded), _schema(rows, coded)), rest)


def _schema(rows: DataFrame, coded: bool) -> StructType:
    fields = [*rows.schema.fields[:-1], *StructType.fromDDL(SIZES + (f", {CODED}" if coded else "")).fields]
    return StructType.fromDDL(", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)))


def _named(rows: DataFrame, rest: list[str]) -> DataFrame:
    names = [*rest, *[x.split()[0] for x in f"{SIZES}, {CODED}".split(", ")]]
    return rows.toDF(*names[: len(rows.columns)])
