"""Token-ID output: documents are encoded, split where they exceed the context, and packed by best-fit decreasing into fixed-width id matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from echograms.llm.tokens import VOCABULARY, encoder, read_vocabulary

CONTEXT, BLOCK_TOKENS = 2048, 2_000_000
PACKED = "pack_id long, n_tokens int, doc_ids array<long>, doc_starts array<int>, cu_seqlens array<int>, ids binary, positions binary"


class Capacities:
    """The open rows by free capacity, in a segment tree over capacities: the least capacity of at least n that some row has is found in log steps."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        i = self.leaves + capacity
        while i:
            self.counts[i] += by
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, row) of the fullest row with at least that capacity, which is removed; None if there is none."""
        i = self.leaves + least
        while not self.counts[i]:
            while i & 1:  # up until a right neighbour exists
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.leaves:
            i *= 2
            i += not self.counts[i]
        capacity = i - self.leaves
        self._change(capacity, -1)
        return capacity, self.rows[capacity].pop()


def best_fit(sizes: list[int], context: int) -> list[list[int]]:
    """Rows of item numbers. Items in order of size, largest first, ties in order; each goes to the fullest row that holds it. Sizes are 1 to context."""
    rows: list[list[int]] = []
    free = Capacities(context)
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = free.take(sizes[item])
        capacity, row = found or (context, len(rows))
        if not found:
            rows.append([])
        rows[row].append(item)
        if capacity > sizes[item]:
            free.add(capacity - sizes[item], row)
    return rows


def _pack(vocabulary, context: int, width):
    def emit(base: int, done: int, segments: list[tuple[int | None, int, np.ndarray]], end: int) -> pa.RecordBatch:
        rows = best_fit([len(x[2]) for x in segments], context)
        ids, positions = np.full((len(rows), context), end, dtype=width), np.zeros((len(rows), context), dtype=width)
        docs, starts, lengths = [], [], []
        for r, items in enumerate(rows):
            at, cu = 0, [0]
            for i in items:
                part = segments[i][2]
                ids[r, at : at + len(part)] = part
                positions[r, at : at + len(part)] = np.arange(len(part))
                at += len(part)
                cu.append(at)
            docs.append([segments[i][0] for i in items])
            starts.append([segments[i][1] for i in items])
            lengths.append(cu)
        matrix = lambda m: pa.array([x.tobytes() for x in m], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows)) + base + done), pa.array([x[-1] for x in lengths], pa.int32()), pa.array(docs, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int32())), pa.array(lengths, pa.list_(pa.int32())), matrix(ids), matrix(positions)], ["pack_id", "n_tokens", "doc_ids", "doc_starts", "cu_seqlens", "ids", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary.value)
        base, done, held, segments = TaskContext.get().partitionId() << 40, 0, 0, []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = enc.ids(text.as_py() or "").astype(width)
                if not len(tokens):
                    continue
                tokens = np.append(tokens, width(enc.size))
                for s in range(0, len(tokens), context):
                    segments.append((doc, s, tokens[s : s + context]))
                held += len(tokens)
                if held >= BLOCK_TOKENS:
                    out = emit(base, done, segments, enc.size)
                    done, held, segments = done + out.num_rows, 0, []
                    yield out
        if segments:
            yield emit(base, done, segments, enc.size)

    return run


def packed_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, context: int = CONTEXT) -> DataFrame:
    """Rows of a matrix of token ids, `context` wide.

    Each document that has tokens is encoded and ends with one end-of-text id (the vocabulary's size). A longer one is split into segments of
    context ids and a last one; doc_starts tells where in the document each begins, so nothing is lost. ids and positions hold little-endian integers,
    16 bits where they suffice, else 32; places after the last segment hold the end-of-text id. positions start from 0 in each segment;
    cu_seqlens are the cumulative segment lengths, from 0. Null and empty texts give no segment; repeated rows give repeated segments.

    A task packs its own rows, in blocks of about 2 M tokens, so nothing is shuffled and memory is bounded; only the last rows of a block are part empty."""
    raw = read_vocabulary(vocabulary)
    width = np.uint16 if max(encoder(raw).size, context) < 1 << 16 else np.uint32
    ranks = docs.sparkSession.sparkContext.broadcast(raw)
    return docs.select(docs[f"`{key}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].alias("text")).mapInArrow(_pack(ranks, context, width), PACKED)


def write_packed(packed: DataFrame, folder: str) -> None:
    """The matrix as Parquet files, one row each; reading them back gives the same bytes."""
    packed.write.parquet(folder)


def op6_packed_ids(spark, sf_dir: str) -> DataFrame:
    """packed_ids of all documents, with its rules for nulls, empty and long texts and repeated rows; documents without an id are packed with a null id,
    other columns are ignored, and an empty table gives an empty result."""
    return packed_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"))
