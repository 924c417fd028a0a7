"""Periodic run detection: stretches of words that repeat with one period at least four times, found in tiles sized by the period.

Words are runs of anything but space and \\x09-\\x0D. A run is a stretch [start, end) of words with smallest period q (words q apart are identical) and length
of at least max(6, 4 * q) that no neighbouring word extends.

1. Periods are split into octaves [Q, 2Q). A run of such a period that starts at s passes the first multiple c of Q from s on, and there at least 2Q words agree
   with those q further on. Chained hashes of 2Q words, doubled from octave to octave, find the pairs (c, q) that may agree; a document without any
   has no run and is finished where it is.
2. The others are exploded into tiles: for each octave those stretches of 17Q words, 8Q apart, that hold such a pair. Tiles are dealt out by document, octave
   and place, so one long document is work for many tasks.
3. In a tile, Z-functions to the right and to the left of the boundary c tell how far each period of the octave reaches; what a tile finds is compared word
   by word, never by hash. A fragment whose period is not its smallest is left to the octave of that one.
4. Fragments meet by document and period. Those that overlap by a period are one run; tiles overlap by more. Documents that share a word sequence share
   its runs: the sequence is named by a 128-bit digest."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echograms.llm.runtime import cut
from echograms.llm.wordhash import BASE, U, mix

LEAST, EXPONENT, STEP, GROUP = 6, 4, 8, 1_000_000


def z_function(words: list) -> list[int]:
    """For each place how far the words from there on agree with those from the start; 0 at place 0."""
    n = len(words)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and words[k] == words[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def smallest_period(words: list) -> int:
    z, n = z_function(words), len(words)
    return next((p for p in range(1, n) if p + z[p] == n), n)


def octaves(ids: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(Q, c, q) for each octave: the multiples c of Q and periods q from Q to 2Q - 1 such that a run may have started less than Q words before c: 2Q words
    (4 at least) from c on, and those at the middle and the end of what such a run has left, seem to agree with those q further on. ids may be those of several
    documents, if no two documents share an id; longest is the length of the longest."""
    h, width, size = ids.astype(U), 1, 1
    while EXPONENT * size <= longest:
        while width < max(4, 2 * size):
            if len(h) <= width:
                return
            h, width = mix(h[:-width] * BASE + h[width:]), 2 * width
        if len(h) > size:
            y = np.flatnonzero(h[size:] == np.repeat(h[:-size:size], size)[: len(h) - size])
            c, q = y // size * size, y % size + size
            rest = np.maximum(LEAST, EXPONENT * q) - q - size + 1 - width  # where the last window starts that must agree
            live = np.flatnonzero(c + q + rest < len(h))
            c, q, rest = c[live], q[live], rest[live]
            live = np.flatnonzero((h[c + rest] == h[c + q + rest]) & (h[c + rest // 2] == h[c + q + rest // 2]))
            if len(live):
                yield size, c[live], q[live]
        size *= 2


def word_ids(words: list[bytes], first: int = 0) -> np.ndarray:
    """A number for each word, equal for equal words, from `first` on."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64) + first


def _raw(text) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def _key(words: list[bytes]) -> list[int]:
    return np.frombuffer(hashlib.blake2b(b" ".join(words), digest_size=16).digest(), "<i8").tolist()


JUDGED = "doc_id long, n_words long, k1 long, k2 long, collapsed_sha256 string, text string"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that cannot hold a run are done; the others keep their text and get the name of their word sequence."""
    for batch in batches:
        raws, a = batch.column(1), 0
        while a < batch.num_rows:
            b, total, words, ids, bounds = a, 0, [], [], [0]
            while b < batch.num_rows and (b == a or total < GROUP):  # so many words at once
                words.append(_raw(raws[b]).split())
                ids.append(word_ids(words[-1], total))
                total += len(words[-1])
                bounds.append(total)
                b += 1
            open_ = np.zeros(b - a, dtype=bool)
            for _, c, _ in octaves(np.concatenate(ids), max(map(len, words))):
                open_[np.searchsorted(bounds, c, side="right") - 1] = True
            keys = [_key(w) if o else (None, None) for w, o in zip(words, open_.tolist(), strict=True)]
            done = [None if o else hashlib.sha256(b" ".join(w)).hexdigest() for w, o in zip(words, open_.tolist(), strict=True)]
            texts = pa.array([_raw(raws[a + i]).decode() if o else None for i, o in enumerate(open_.tolist())], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(w) for w in words], pa.int64()), pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64()), pa.array(done, pa.string()), texts], [x.split()[0] for x in JUDGED.split(", ")])
            a = b


TILES = "k1 long, k2 long, octave long, lo long, ids binary, pairs binary"


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of an octave that hold a pair (c, q): the ids of their words, and the pairs with c counted from the tile's start."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    names = [x.split()[0] for x in TILES.split(", ")]
    for batch in batches:
        for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            ids, rows = word_ids(_raw(text).split()), []
            n, small = len(ids), ids.astype("<i4")
            for size, c, q in octaves(ids, n):
                tile = c // (STEP * size)
                first = np.flatnonzero(np.diff(tile, prepend=-1))
                for a, b in zip(first.tolist(), [*first[1:].tolist(), len(c)], strict=True):
                    lo = max(0, (STEP * int(tile[a]) - 1) * size)
                    hi = min(n, STEP * (int(tile[a]) + 2) * size)
                    rows.append((k1, k2, size, lo, small[lo:hi].tobytes(), np.stack([c[a:b] - lo, q[a:b]], axis=1).astype("<i4").tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def tile_fragments(words: list[int], pairs: np.ndarray, octave: int) -> list[tuple[int, int, int]]:
    """(period, start, end) of the stretches of a tile that reach over one of the given boundaries with one of the given periods, which is the smallest.

    To the right of a boundary c, Z-values of words[c:] tell how far a period reaches; to the left, those of the reversed words before c, followed by the
    reversed words before c + 2Q - 1."""
    reach: dict[int, int] = {}
    periods: dict[tuple[int, int], int] = {}
    found = []
    first = np.flatnonzero(np.diff(pairs[:, 0], prepend=-1)).tolist()
    for a, b in zip(first, [*first[1:], len(pairs)], strict=True):
        c = int(pairs[a, 0])
        todo = [q for q in pairs[a:b, 1].tolist() if reach.get(q, 0) < c + q]  # others belong to a stretch that is known
        if not todo:
            continue
        far = min(len(words), c + 2 * octave - 1)
        right, left = z_function(words[c:]), z_function([*words[:c][::-1], -1, *words[:far][::-1]])
        for q in todo:
            start, end = c - left[c + 1 + far - c - q], c + q + right[q]
            reach[q] = end
            if end - start >= 2 * q:
                if (start, end) not in periods:
                    periods[start, end] = smallest_period(words[start:end])
                if periods[start, end] == q:
                    found.append((q, start, end))
    return found


FRAGMENTS = "k1 long, k2 long, period long, start long, end long"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for k1, k2, octave, lo, ids, pairs in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            for q, start, end in tile_fragments(np.frombuffer(ids, "<i4").tolist(), np.frombuffer(pairs, "<i4").reshape(-1, 2), octave):
                rows.append((k1, k2, q, lo + start, lo + end))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], [x.split()[0] for x in FRAGMENTS.split(", ")])


def stitched(fragments: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """(k1, k2, start, length, period) from fragments (k1, k2, period, start, end): fragments of one period that overlap by a period are one run."""
    w = Window.partitionBy("k1", "k2", "period").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.when(F.col("before") - F.col("start") >= F.col("period"), 0).otherwise(1)).over(w)
    runs = fragments.distinct().withColumn("before", before).withColumn("part", part).groupBy("k1", "k2", "period", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    length = F.col("end") - F.col("start")
    return runs.where(length >= F.greatest(F.lit(least), exponent * F.col("period"))).select("k1", "k2", "start", length.alias("length"), "period")


REPORT = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _report(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = [batch.column(i) if i == 2 else batch.column(i).to_pylist() for i in range(6)]
            for doc, n, text, starts, lengths, periods in zip(*columns, strict=True):
                runs = sorted(zip(starts or (), lengths or (), periods or (), strict=True), key=lambda r: (r[0], r[2]))
                words = _raw(text).split()
                step = np.zeros(len(words) + 1, dtype=np.int64)
                for start, length, q in runs:
                    step[start + q] += 1
                    step[start + length] -= 1
                kept = b" ".join([words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)])
                best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
                digest = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
                rows.append((doc, n, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            kinds = (*[pa.int64()] * 7, pa.string(), pa.string(), pa.string())
            names = [*[x.split()[0] for x in REPORT.split(", ")], "collapsed"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)][: 9 + with_text], names[: 9 + with_text])

    return run


def sequence_runs(judged: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """(k1, k2, start, length, period): the runs of each word sequence of judged rows (k1, k2, text); rows without text are left out."""
    tiles = judged.where("text is not null").select("k1", "k2", "text").mapInArrow(_explode, TILES).repartition("k1", "k2", "octave", "lo")
    return stitched(tiles.mapInArrow(_solve, FRAGMENTS), least, exponent)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, exponent: int = EXPONENT, with_text: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_runs; start, length, period and exponent_milli of its longest run (ties: smallest start, then period; null
    without runs); digests of the list of runs and of the words that are left when each run is cut to its first period. with_text=True adds
    collapsed, those words joined by one space, for rows that may hold runs (null: all words are left).

    exponent, how often a period must be repeated, is 4 or more; least, the length of the shortest run, is 6 or more. Null and empty texts have no words and no runs.
    Repeated rows are judged each, null and repeated ids make no difference, other columns are ignored, whatever their names, and an empty table
    gives an empty result. Any length of text will do: tiles of a long one are dealt to many tasks."""
    if exponent < EXPONENT or least < LEAST:
        raise ValueError(f"runs of less than {EXPONENT} periods or {LEAST} words are not found")
    judged = cut(docs.select(docs[f"`{key}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].alias("text")).mapInArrow(_judge, JUDGED), "judged")
    runs = cut(sequence_runs(judged, least, exponent).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs")), "runs")
    full = judged.where("text is not null").join(runs, ["k1", "k2"], "left")
    found = full.select("doc_id", "n_words", "text", F.col("runs.start").alias("s"), F.col("runs.length").alias("l"), F.col("runs.period").alias("p")).mapInArrow(_report(with_text), REPORT + (", collapsed string" if with_text else ""))
    none = [F.lit(None).cast("long").alias(c) for c in ("start", "length", "period", "exponent_milli")]
    rest = judged.where("text is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_runs"), *none, F.lit(hashlib.sha256(b"").hexdigest()).alias("runs_sha256"), "collapsed_sha256")
    return found.unionByName(rest, allowMissingColumns=True)


def planted_text(doc_id: int, words: list[bytes]) -> list[bytes]:
    """The words of a document with the periodic tail that the query plants in a tenth of the documents."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if doc is None or zlib.crc32(str(doc).encode()) % 10 or not text.is_valid:
                out.append(text.as_py())
            else:
                out.append(b" ".join(planted_text(doc, _raw(text).split())).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """periodic_runs of all documents, a tenth of which get a periodic tail first. A document without an id gets none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").mapInArrow(_plant, "doc_id long, text string")
    return periodic_runs(docs).drop("n_words")
