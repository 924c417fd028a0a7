"""Substring dedup: words covered by a window of 35 words that starts more than once are removed. A count-min sketch goes first.

Words are runs of anything but space and \\x09-\\x0D, unchanged; a window is 35 consecutive words of one text.

1. The anchor of a window is the leftmost of its 8-word grams with the least hash (top 32 bits), so equal windows have equal anchors at equal offsets, and
   two starts of one window are two places of one anchor. Each place is counted once, in a count-min sketch of two rows: tasks send the cells that they
   touched, sorted, and the tasks that own a piece of the table add them up. An anchor's estimate is at least its count, so at least that of any window
   around it: windows whose anchor is estimated once are unique, and no repeated one is lost.
2. The second pass keeps only windows estimated repeated, as one row for each anchor place with the 96-bit digests of its windows. Places meet by anchor, and
   windows are grouped by digest there. Where the sketch puts an anchor above HOT places, its windows are rows of their own, counted by digest with
   map-side sums and looked up again in a join that Spark may split; the estimate depends on the anchor alone, so all its places go the same way.
3. Repeated windows become spans of words for each distinct word sequence. Documents that a bit table of the marked sequences rules out are finished where they
   are; only the rest is joined with its spans.

The sketch has CELLS_AN_ANCHOR cells for each anchor expected and at most 2^MOST_BITS a row, 2 bits each when merged (128 MB in all): a bound that a broadcast
needs. Beyond some 10 GB of text more and more single windows pass it, which costs time and no result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echograms.llm.runtime import Bits, bit_table, cut
from echograms.llm.wordhash import NOT_SPACE, U, Words, mix, slices, window_hashes

WINDOW, GRAM, MOST_BITS, CELLS_AN_ANCHOR, HOT, PIECE_BITS, FLUSH = 35, 8, 28, 8, 4096, 16, 2_000_000
ROW_KEYS = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
SECOND, LOW_32 = U(0x165667B19E3779F9), U(0xFFFFFFFF)
DIGEST = np.dtype([("a", "<u8"), ("b", "<u4")])  # 12 bytes of a window


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    out, step = values, 1
    while 2 * step <= width:
        out, step = np.minimum(out[:-step], out[step:]), 2 * step
    rest = width - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchor_runs(words: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, anchor): the windows of all texts as runs of starts [start, stop) with one anchor place, and the hash of the anchor."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    grams = window_hashes(words, gram)
    order = (grams & ~LOW_32) | np.arange(len(grams), dtype=U)  # ties of the top halves go to the left
    place = (_least(order, window - gram + 1) & LOW_32).astype(np.int64)
    inside = (np.arange(len(words)) + window <= np.repeat(first[1:], np.diff(first)))[:n]
    edge = np.ones(n + 1, dtype=bool)
    edge[1:n] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])
    edges = np.flatnonzero(edge)
    start, stop = edges[:-1], edges[1:]
    keep = inside[start]
    return start[keep], stop[keep], grams[place[start[keep]]]


def _cells(anchors: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each anchor in each row of the sketch; rows follow each other in one range of cells."""
    return [(mix(anchors ^ key) >> U(64 - bits)).astype(np.int64) + (r << bits) for r, key in enumerate(ROW_KEYS)]


def _partial_sketches(bits: int, window: int, gram: int):
    """Pieces (piece, cells, counts) of the sketch of a task's texts; at most FLUSH anchors are held."""

    def pieces(anchors: list[np.ndarray]) -> pa.RecordBatch:
        cell, count = np.unique(np.concatenate(_cells(np.concatenate(anchors), bits)), return_counts=True)
        piece = cell >> PIECE_BITS
        first = np.flatnonzero(np.diff(piece, prepend=-1))
        edges = np.append(first, len(cell))
        low, many = (cell & ((1 << PIECE_BITS) - 1)).astype("<u2"), count.astype("<u4")
        spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(piece[first]), pa.array([low[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([many[a:b].tobytes() for a, b in spans], pa.binary())], ["piece", "cells", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                words = Words(data, offsets, NOT_SPACE, fold=False)
                anchors = anchor_runs(words.hashes(), words.first, window, gram)[2]
                held.append(anchors)
                size += len(anchors)
                if size >= FLUSH:
                    yield pieces(held)
                    held, size = [], 0
        if size:
            yield pieces(held)

    return run


def _merged(hot: int):
    """Codes of the cells of each piece from its partial sketches, which come one after the other: cells of at least 2 and those of at least `hot`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, out = None, np.zeros(1 << PIECE_BITS, np.int64), []

        def close() -> None:
            if now is not None:
                twice = np.flatnonzero(sums >= 2)
                out.append((now, twice.astype("<u2").tobytes(), np.packbits(sums[twice] >= hot).tobytes()))
                sums.fill(0)

        def flush() -> pa.RecordBatch:
            rows = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))]
            out.clear()
            return pa.RecordBatch.from_arrays(rows, ["piece", "twice", "hot"])

        for batch in batches:
            for piece, cells, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if piece != now:
                    close()
                    now = piece
                sums[np.frombuffer(cells.as_buffer(), "<u2")] += np.frombuffer(counts.as_buffer(), "<u4")
            if out:
                yield flush()
        close()
        if out:
            yield flush()

    return run


class Sketch:
    """The merged sketch, two bits a cell: estimated at least 2, estimated at least hot."""

    def __init__(self, bits: int):
        self.bits = bits
        self.tables = [Bits(len(ROW_KEYS) << bits) for _ in range(2)]

    def put(self, piece: int, twice: bytes, hot: bytes) -> None:
        cells = np.frombuffer(twice, "<u2").astype(np.int64)
        hot_cells = cells[np.unpackbits(np.frombuffer(hot, np.uint8), count=len(cells)) > 0]
        size = 1 << PIECE_BITS
        for table, on in zip(self.tables, (cells, hot_cells), strict=True):
            flags = np.zeros(size, np.uint8)
            flags[on] = 1
            table.table[piece * size // 8 : (piece + 1) * size // 8] = np.packbits(flags, bitorder="little")

    def codes(self, anchors: np.ndarray) -> np.ndarray:
        """0: once, 1: perhaps more often, 2: perhaps more often than hot; the least of the rows."""
        return sum(np.minimum.reduce([t.test(c).astype(np.int8) for c in _cells(anchors, self.bits)]) for t in self.tables)


def window_sketch(docs: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, most_bits: int = MOST_BITS) -> Sketch:
    """The count-min sketch of the anchors of all windows. What reaches the driver is a list of its cells above 1, less than its bounded size."""
    texts = docs.select(docs[f"`{text}`"].alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(most_bits, max(PIECE_BITS, (CELLS_AN_ANCHOR * size // (3 * (window - gram + 2))).bit_length()))  # about 6 bytes a word, two anchors for each stretch of window - gram + 2 words
    parts = texts.mapInArrow(_partial_sketches(bits, window, gram), "piece long, cells binary, counts binary")
    merged = parts.repartition("piece").sortWithinPartitions("piece").mapInArrow(_merged(hot), "piece long, twice binary, hot binary")
    sketch = Sketch(bits)
    for row in merged.toLocalIterator():
        sketch.put(row.piece, bytes(row.twice), bytes(row.hot))
    return sketch


def _joined(raw: bytes) -> bytes:
    return b" ".join(raw.split())


def _key(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All integers of the ranges, one after the other."""
    size = stop - start
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


CANDIDATES = "hot boolean, anchor long, k1 long, k2 long, start long, windows binary, w1 long, w2 int, starts binary"


def _candidates(sketch, window: int, gram: int):
    """Places of anchors that may be repeated, with the digests of their windows; for hot ones a row for each distinct window of a text with its starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                found = Words(data, offsets, NOT_SPACE, fold=False)
                words, first = found.hashes(), found.first
                start, stop, anchor = anchor_runs(words, first, window, gram)
                code = counts.codes(anchor)
                if not code.any():
                    continue
                digest = np.empty(len(words) - window + 1, DIGEST)
                digest["a"], digest["b"] = window_hashes(words, window), window_hashes(mix(words ^ SECOND), window) & LOW_32
                text = np.searchsorted(first, start, side="right") - 1
                keys = np.zeros((len(offsets) - 1, 2), "<i8")
                raw = data.tobytes()
                for t in np.unique(text[code > 0]).tolist():
                    keys[t] = np.frombuffer(_key(_joined(raw[offsets[t] : offsets[t + 1]])), "<i8")
                yield from (x for x in (_by_place(start, stop, anchor, text, first, keys, digest, code == 1), _by_window(start, stop, text, first, keys, digest, code == 2)) if x.num_rows)

    return run


def _table(n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    schema = {"hot": pa.bool_(), "anchor": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "start": pa.int64(), "windows": pa.binary(), "w1": pa.int64(), "w2": pa.int32(), "starts": pa.binary()}
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, t)) for c, t in schema.items()], list(schema))


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values cut from one array; sizes in entries."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _by_place(start, stop, anchor, text, first, keys, digest, on) -> pa.RecordBatch:
    a, b, t = start[on], stop[on], text[on]
    return _table(len(a), {"hot": pa.array(np.zeros(len(a), bool)), "anchor": pa.array(anchor[on].view(np.int64)), "k1": pa.array(keys[t, 0]), "k2": pa.array(keys[t, 1]), "start": pa.array(a - first[t]), "windows": _binary(digest[_ranges(a, b)], b - a)})


def _by_window(start, stop, text, first, keys, digest, on) -> pa.RecordBatch:
    at, t = _ranges(start[on], stop[on]), np.repeat(text[on], (stop - start)[on])
    order = np.lexsort((at, digest["b"][at], digest["a"][at], t))
    at, t = at[order], t[order]
    d = digest[at]
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])])) if len(at) else at
    size = np.diff(np.append(new, len(at)))
    u = t[new]
    return _table(len(new), {"hot": pa.array(np.ones(len(new), bool)), "k1": pa.array(keys[u, 0]), "k2": pa.array(keys[u, 1]), "w1": pa.array(d["a"][new].view(np.int64)), "w2": pa.array(d["b"][new].view(np.int32)), "starts": _binary((at - first[t]).astype("<i8"), size)})


SPANS = "k1 long, k2 long, start long, end long"


def _spans(k: np.ndarray, at: np.ndarray, window: int) -> pa.RecordBatch:
    """Spans [start, end) of words under windows at (text, start), in any order: windows that overlap or touch the one before become one span with it."""
    if len(at):
        new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1) | (at[1:] < at[:-1]) | (at[1:] > at[:-1] + window)]))
        last = np.append(new[1:], len(at)) - 1
        k, at, end = k[new], at[new], at[last] + window
    else:
        end = at
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(k[:, 0])), pa.array(np.ascontiguousarray(k[:, 1])), pa.array(at), pa.array(end)], ["k1", "k2", "start", "end"])


def _repeated_at_places(window: int):
    """Spans under windows that occur twice, from places sorted by anchor. Places of one anchor are kept until the next anchor comes: HOT at most, but
    for what two cells of the sketch share."""

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        col = lambda c: t.column(c).to_numpy()
        windows = t.column("windows").combine_chunks()
        size = np.diff(np.frombuffer(windows.buffers()[1], np.int32)[windows.offset : windows.offset + len(windows) + 1]) // DIGEST.itemsize
        d = np.frombuffer(b"".join(windows.to_pylist()), DIGEST)
        row = np.repeat(np.arange(len(size)), size)
        anchor, k1, k2 = col("anchor")[row], col("k1")[row], col("k2")[row]
        at = col("start")[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        order = np.lexsort((d["b"], d["a"], anchor))
        same = (np.diff(anchor[order]) == 0) & (d["a"][order][1:] == d["a"][order][:-1]) & (d["b"][order][1:] == d["b"][order][:-1])
        twice = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        k1, k2, at = k1[twice], k2[twice], at[twice]
        order = np.lexsort((at, k2, k1))
        k, at = np.stack([k1[order], k2[order]], axis=1), at[order]
        fresh = np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1) | (at[1:] != at[:-1])]) if len(at) else np.zeros(0, bool)
        return _spans(k[fresh], at[fresh], window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column(0).to_numpy()
            whole = int(np.searchsorted(anchor, anchor[-1]))  # rows of the last anchor wait for the next batch
            if whole:
                yield solve([*held, batch.slice(0, whole)])
                held = []
            elif held and held[-1].column(0)[-1].as_py() != anchor[0]:
                yield solve(held)
                held = []
            held.append(batch.slice(whole))
        if held:
            yield solve(held)

    return run


def repeated_spans(docs: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, most_bits: int = MOST_BITS) -> DataFrame:
    """(k1, k2, spans): for each distinct word sequence, named by a 128-bit digest, the spans of its words that lie under windows of `window` words that start
    anywhere else too. Sequences without such windows have no row; each copy of a text is a text of its own here. spans are distinct and sorted."""
    if not 1 <= gram <= window:
        raise ValueError("a gram is part of a window")
    sketch = docs.sparkSession.sparkContext.broadcast(window_sketch(docs, text, window, gram, hot, most_bits))
    found = cut(docs.select(docs[f"`{text}`"].alias("text")).mapInArrow(_candidates(sketch, window, gram), CANDIDATES), "windows")
    places = found.where("not hot").select("anchor", "k1", "k2", "start", "windows").repartition("anchor").sortWithinPartitions("anchor")
    cool = places.mapInArrow(_repeated_at_places(window), SPANS)
    rows = found.where("hot").select("k1", "k2", "w1", "w2", "starts")
    twice = rows.groupBy("w1", "w2").agg(F.sum(F.octet_length("starts") / 8).alias("n")).where("n > 1").select("w1", "w2")
    warm = rows.join(twice, ["w1", "w2"]).select("k1", "k2", "starts").mapInArrow(_starts(window), SPANS)
    return cool.unionByName(warm).distinct().groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _starts(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column(2)
            size = np.array([x.as_buffer().size // 8 for x in starts], dtype=np.int64)
            row = np.repeat(np.arange(len(size)), size)
            k = np.stack([batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row]], axis=1).reshape(-1, 2)
            yield _spans(k, np.frombuffer(b"".join(starts.to_pylist()), "<i8"), window)

    return run


REST = "doc_id long, k1 long, k2 long, n_words long, kept_sha256 string, text string"


def _unmarked(marked):
    """Documents that cannot have a span are done; the others keep their text. The done ones have keys of their own, so that they are dealt evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = marked.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                words = raw.split()
                joined = b" ".join(words)
                k1, k2 = np.frombuffer(_key(joined), "<i8").tolist()
                if len(words) and bits.test(np.array([k1]))[0]:
                    rows.append((doc, k1, k2, len(words), None, raw.decode()))
                else:
                    rows.append((doc, doc or 0, len(rows), len(words), hashlib.sha256(joined).hexdigest(), None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in REST.split(", ")])

    return run


KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _kept(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests, texts = [], [], []
            starts, ends = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            for i, (text, done) in enumerate(zip(batch.column(3), batch.column(2).to_pylist(), strict=True)):
                if not text.is_valid:
                    removed.append(0)
                    digests.append(done)
                    texts.append(None)
                    continue
                words, kept, at, gone = text.as_buffer().to_pybytes().split(), [], 0, 0
                for a, b in zip(starts[i] or (), ends[i] or (), strict=True):
                    kept += words[at : max(at, a)]
                    gone += max(0, b - max(at, a))
                    at = max(at, b)
                kept += words[at:]
                joined = b" ".join(kept)
                removed.append(gone)
                digests.append(hashlib.sha256(joined).hexdigest())
                texts.append(joined.decode() if with_text else None)
            out = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(texts, pa.string())] if with_text else []), ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text)

    return run


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, with_text: bool = False, **sketch) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of docs, and with_text=True also kept: the words that are left, joined by one space, where any was
    removed or may have been (null: all words are left).

    Every word under a window of `window` words that starts more than once in the table, in other rows or in the same text, is removed; windows are judged on
    the input. Null and empty texts have no words. Texts of fewer words than a window keep all. Repeated rows are rows of their own, so they lose what they
    share with each other; null and repeated ids make no difference. Other columns are ignored, whatever their names; an empty table gives an empty
    result. Parameters of the sketch (gram, hot, most_bits) change no result."""
    spans = cut(repeated_spans(docs, text, window, **sketch), "spans")
    marked = docs.sparkSession.sparkContext.broadcast(bit_table(spans, "k1", spans.count()))
    rest = docs.select(docs[f"`{key}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].alias("text")).mapInArrow(_unmarked(marked), REST)
    full = rest.join(spans.withColumnsRenamed({"k1": "of1", "k2": "of2"}), F.col("text").isNotNull() & (F.col("k1") == F.col("of1")) & (F.col("k2") == F.col("of2")), "left")
    rows = full.select("doc_id", "n_words", "kept_sha256", "text", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
    return rows.mapInArrow(_kept(with_text), KEPT + (", kept string" if with_text else ""))


def op12_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """substring_dedup of all documents, windows of 35 words."""
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
