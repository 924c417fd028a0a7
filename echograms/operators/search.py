"""Where patterns occur in texts: anchored gram join, chunked search, rank ranges, backward search, and stored suffix tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from echograms.functions.bits import Bits, bit_table
from echograms.functions.suffix_kernels import SuffixOrder, code_points

U = np.uint64
BROADCAST_PATTERNS, PATTERNS_A_TASK, RUN_BYTES, OFFER_BYTES, LENGTHS, COUNTED = 200_000, 10_000, 1 << 22, 160, 8, 200_000  # an offer is three Python objects beside its bytes


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (two rounds of multiply and shift)."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _grams(data: np.ndarray, last: int) -> Iterator[tuple[int, np.ndarray]]:
    """(size, hashes of the `size` bytes at each offset) for size 1, 2, 4, ... up to last: a gram's hash is made of those of its halves."""
    size, h = 1, _mix(data.astype(U) + U(1))
    while size <= last and len(h):
        yield size, h
        h = _mix(h[:-size] * U(3) + h[size:]) if len(h) > size else h[:0]
        size *= 2


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pattern_id, owner, bytes) with the pattern's anchor: the hash of its first bytes, as many as the largest power of two that it has."""
    for batch in batches:
        out = []
        for owner, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            size = 1 << (len(raw).bit_length() - 1)
            found = next(h[0] for k, h in _grams(np.frombuffer(raw, np.uint8)[:size], size) if k == size)
            out.append((int(_owned(found, size, owner).astype(np.int64)), size))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in out], pa.int64()), pa.array([k for _, k in out], pa.int64())], ["pattern_id", "owner", "bytes", "anchor", "size"])


def _owned(grams, size: int, owner: int | None):
    """An anchor: a gram's hash with its size, and with the text that it is looked for in, if that is only one."""
    with np.errstate(over="ignore"):
        return _mix(np.asarray(grams + U(size) + (U(owner & (1 << 64) - 1) * U(0x9E3779B97F4A7C15) if owner is not None else U(0)), dtype=U))


def _offers(known, sizes: list[int], own: bool):
    """(text_id, pos, anchor, found) for the offsets of rows (text_id, owner, body) where an anchor may be: pos counts characters, found is the bytes from
    there on, twice the anchor's size, which is more than any pattern with that anchor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: Bits = known.value
        for batch in batches:
            rows, place, anchors, found, held = [], [], [], [], 0

            def packed() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(place, pa.int64()), pa.array(anchors, pa.int64()), pa.array(found, pa.binary())], ["text_id", "pos", "anchor", "found"])

            owners = batch.column(1).to_pylist() if own else None
            for i, text in enumerate(batch.column(2)):
                raw = (text.as_py() or "").encode()
                data = np.frombuffer(raw, np.uint8)
                before = np.cumsum((data & 0xC0) != 0x80) - 1  # characters before each that starts here
                for size, grams in _grams(data, sizes[-1] if sizes else 0):
                    if size in sizes:
                        anchor = _owned(grams, size, owners[i] if own else None)
                        at = np.flatnonzero(bits.test(anchor))
                        rows += [i] * len(at)
                        place += before[at].tolist()
                        anchors += anchor[at].astype(np.int64).tolist()
                        found += [raw[x : x + 2 * size] for x in at.tolist()]
                        held += (2 * size + OFFER_BYTES) * len(at)
                if held > RUN_BYTES:
                    yield packed()
                    rows, place, anchors, found, held = [], [], [], [], 0
            yield packed()

    return run


def _occurrences(texts: DataFrame, patterns: DataFrame, own: bool = False) -> DataFrame:
    """(text_id, pattern_id, pos) for texts (text_id, owner, body) and patterns (pattern_id, owner, pattern). Every byte offset offers the hashes of the
    1, 2, 4, ... bytes there; only those that a bit table of the patterns' anchors lets through leave the task, and are joined and compared in full."""
    shaped = patterns.where(F.length("pattern") > 0).select("pattern_id", "owner", F.encode("pattern", "UTF-8").alias("bytes"))
    anchored = shaped.mapInArrow(_anchors, StructType([*shaped.schema.fields, *StructType.fromDDL("anchor long, size long")]))
    sizes = sorted(anchored.groupBy("size").agg(F.count("*").alias("n")).collect())  # at most one row for each power of two
    n = sum(r.n for r in sizes)
    known = texts.sparkSession.sparkContext.broadcast(bit_table(anchored, "anchor", n))
    offers = texts.select("text_id", "owner", "body").mapInArrow(_offers(known, [r["size"] for r in sizes], own), StructType([texts.schema["text_id"], *StructType.fromDDL("pos long, anchor long, found binary")]))
    side = anchored.select("pattern_id", "anchor", "bytes")
    met = offers.join(F.broadcast(side) if n <= BROADCAST_PATTERNS else side, "anchor")
    return met.where(F.substring("found", 1, F.octet_length("bytes")) == F.col("bytes")).select("text_id", "pattern_id", "pos")


def pattern_occurrences(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text_id, pattern_id, pos) of every occurrence, overlapping ones too, of patterns (pattern_id, pattern) in texts (text_id, body).

    Patterns of any length and number; pos counts code points. Empty and null patterns occur nowhere, nothing occurs in a null text."""
    nobody = F.lit(None).cast("long").alias("owner")
    return _occurrences(texts.select("text_id", nobody, "body"), patterns.select("pattern_id", nobody, "pattern"))


def chunks(texts: DataFrame, size: int, overlap: int) -> DataFrame:
    """(text_id, chunk, start, body): pieces of `size` characters that reach `overlap` characters into the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, parts, held = [], [], [], 0

            def packed() -> pa.RecordBatch:
                start = np.array(starts, dtype=np.int64)
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(start // size), pa.array(start), pa.array(parts, pa.string())], ["text_id", "chunk", "start", "body"])

            for i, body in enumerate(batch.column(1)):
                text = body.as_py() or ""
                for s in range(0, len(text), size):
                    rows.append(i)
                    starts.append(s)
                    parts.append(text[s : s + size + overlap])
                    held += size + overlap
                    if held > RUN_BYTES:
                        yield packed()
                        rows, starts, parts, held = [], [], [], 0
            yield packed()

    return texts.select("text_id", "body").mapInArrow(run, StructType([texts.schema["text_id"], *StructType.fromDDL("chunk long, start long, body string")]))


def chunked_search(texts: DataFrame, patterns: DataFrame, size: int = 4096, overlap: int | None = None) -> DataFrame:
    """The same occurrences, found chunk by chunk; a hit belongs to the chunk that it starts in. overlap defaults to the longest pattern less one."""
    if overlap is None:
        overlap = max(0, (patterns.agg(F.max(F.length("pattern"))).first()[0] or 1) - 1)
    parts = chunks(texts, size, overlap)
    hits = pattern_occurrences(parts.select(F.struct("text_id", "start").alias("text_id"), "body"), patterns).where(F.col("pos") < size)
    return hits.select(F.col("text_id.text_id").alias("text_id"), "pattern_id", (F.col("text_id.start") + F.col("pos")).alias("pos"))


def _whole(data: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hashes of that many code points at each place): made of those of two grams that cover them."""
    for size, grams in _grams(data, lengths[-1] if lengths else 0):
        for length in lengths:
            n = len(data) - length + 1
            if size <= length < 2 * size and n > 0:
                yield length, _mix(grams[:n] * U(3) + grams[length - size : length - size + n] + U(length))


def _whole_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [int(next(_whole(code_points([x])[0], [len(x)]))[1][0].astype(np.int64)) for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["hash"])


def _counted(known, lengths: list[int]):
    """(found, occs, texts) for the strings of these lengths that the bit table lets through: how often they are in the texts of a task, and in how many of
    them. Strings leave when COUNTED different ones are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occs: Counter = Counter()
        texts: Counter = Counter()

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(occs), pa.string()), pa.array(list(occs.values()), pa.int64()), pa.array([texts[k] for k in occs], pa.int64())], ["found", "occs", "texts"])

        for batch in batches:
            for text in batch.column(0):
                body = text.as_py() or ""
                here: list[str] = []
                for length, hashes in _whole(code_points([body])[0], lengths):
                    here += [body[x : x + length] for x in np.flatnonzero(known.value.test(hashes)).tolist()]
                occs.update(here)
                texts.update(set(here))
                if len(occs) > COUNTED:
                    yield packed()
                    occs.clear()
                    texts.clear()
        yield packed()

    return run


def pattern_counts(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern_id, occs, texts) for every pattern (their ids are unique), 0 where it does not occur.

    Patterns of a few lengths are counted by string where the texts are, so equal patterns are counted once and no row for each occurrence leaves a task.
    Patterns of more than LENGTHS lengths, or texts that share ids, are counted by their occurrences."""
    sized = patterns.where(F.length("pattern") > 0).select("pattern")
    lengths = sorted(r.n for r in sized.select(F.length("pattern").alias("n")).distinct().limit(LENGTHS + 1).collect())
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    if len(lengths) > LENGTHS or not texts.groupBy("text_id").agg(F.count("*").alias("n")).where("text_id is null or n > 1").isEmpty():
        found = pattern_occurrences(texts, patterns).groupBy("pattern_id").agg(F.count("*").alias("occs"), F.countDistinct("text_id").alias("texts"))
        return patterns.select("pattern_id").join(found, "pattern_id", "left").select("pattern_id", zero("occs"), zero("texts"))
    hashes = sized.distinct().mapInArrow(_whole_hashes, "hash long")
    known = texts.sparkSession.sparkContext.broadcast(bit_table(hashes, "hash", hashes.count()))
    counted = texts.select("body").mapInArrow(_counted(known, lengths), "found string, occs long, texts long").groupBy("found").agg(F.sum("occs").alias("occs"), F.sum("texts").alias("texts"))
    return patterns.select("pattern_id", F.col("pattern").alias("found")).join(counted, "found", "left").select("pattern_id", zero("occs"), zero("texts"))


def classified(counts: DataFrame, bounds: list[int]) -> DataFrame:
    """counts with the class of occs: the number of bounds that it reaches."""
    reached = [(F.col("occs") >= b).cast("long") for b in bounds]
    out = reached[0]
    for r in reached[1:]:
        out = out + r
    return counts.withColumn("class", out)


def sampled_reads(texts: DataFrame, size: int, per_text: int, seed: int = 1) -> DataFrame:
    """(pattern_id, pattern): per_text pieces of `size` characters from hashed places of each text that is long enough."""
    room = F.length("body") - size + 1
    rows = texts.where(F.length("body") >= size).select("text_id", "body", room.alias("room"), F.explode(F.sequence(F.lit(1), F.lit(per_text))).alias("k"))
    at = F.pmod(F.xxhash64(F.lit(seed), "text_id", "k"), F.col("room")) + 1
    return rows.select(F.concat_ws(":", "text_id", "k").alias("pattern_id"), F.substring(F.col("body"), at.cast("int"), F.lit(size)).alias("pattern"))


def rank_ranges(texts: DataFrame, suffixes: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text_id, pattern_id, from, to): the half-open range of ranks whose suffixes start with the pattern, for patterns (text_id, pattern_id,
    pattern) that occur in their text. The text is part of a pattern's anchor, so patterns meet their own text only."""
    wanted = patterns.where("text_id is not null").select(F.struct("text_id", "pattern_id").alias("pattern_id"), F.col("text_id").alias("owner"), "pattern")
    hits = _occurrences(texts.select("text_id", F.col("text_id").alias("owner"), "body"), wanted, own=True)
    own = hits.where(F.col("pattern_id.text_id") == F.col("text_id")).select("text_id", F.col("pattern_id.pattern_id").alias("pattern_id"), "pos")
    return own.join(suffixes.select("text_id", "pos", "rank"), ["text_id", "pos"]).groupBy("text_id", "pattern_id").agg(F.min("rank").alias("from"), (F.max("rank") + 1).alias("to"))


class _Index:
    """The transform of one text by symbol: the sorted rows that hold it, and how many symbols are smaller. Row 0 is that of the text's end."""

    def __init__(self, text: str):
        order = SuffixOrder([text])
        points, _ = code_points([text])
        rows = np.concatenate([points[-1:], order.lefts()])
        by = np.argsort(rows, kind="stable")
        symbols, first, counts = np.unique(rows[by], return_index=True, return_counts=True)
        self.rows = {int(c): by[a : a + n] for c, a, n in zip(symbols, first, counts, strict=True)}
        self.smaller = {int(c): int(np.searchsorted(np.sort(points), c)) + 1 for c in symbols}
        self.size = len(rows)

    def ranks(self, pattern: str) -> tuple[int, int] | None:
        """The range of ranks, from the last letter of the pattern to the first."""
        low, high = 0, self.size
        for c in reversed(pattern):
            at = self.rows.get(ord(c))
            if at is None:
                return None
            low, high = (self.smaller[ord(c)] + int(x) for x in np.searchsorted(at, (low, high)))
            if low == high:
                return None
        return low - 1, high - 1


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text_id, part, pattern_id, value, is_pattern) in order; a text comes before its patterns."""
    index: _Index | None = None
    for batch in batches:
        keep, low, high = [], [], []
        for i, (value, is_pattern) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
            if not is_pattern:
                index = _Index(value) if value else None
            elif index and value and (found := index.ranks(value)):
                keep.append(i)
                low.append(found[0])
                high.append(found[1])
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["text_id", "pattern_id", "from", "to"])


def backward_search(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text_id, pattern_id, from, to) by the last-to-first map, for patterns (text_id, pattern_id, pattern) of any length that occur in their text.

    A text and its patterns meet in one task, which sorts the text once; a text with many patterns meets them in several, PATTERNS_A_TASK in each.
    Ranks follow suffix_array. Texts share no ids; empty and null patterns occur nowhere."""
    salts = patterns.groupBy("text_id").agg(F.ceil(F.count("*") / PATTERNS_A_TASK).cast("int").alias("salts"))
    asked = patterns.join(salts, "text_id").select("text_id", F.pmod(F.xxhash64("pattern_id"), "salts").cast("int").alias("part"), "pattern_id", F.col("pattern").alias("value"), F.lit(True).alias("is_pattern"))
    kind = patterns.schema["pattern_id"].dataType
    held = texts.join(salts, "text_id").select("text_id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("part"), F.lit(None).cast(kind).alias("pattern_id"), F.col("body").alias("value"), F.lit(False).alias("is_pattern"))
    rows = held.unionByName(asked).repartition("text_id", "part").sortWithinPartitions("text_id", "part", "is_pattern")
    return rows.mapInArrow(_backward, StructType([StructField("text_id", texts.schema["text_id"].dataType), StructField("pattern_id", kind), *StructType.fromDDL("`from` long, `to` long")]))


def store_suffixes(suffixes: DataFrame, folder: str) -> DataFrame:
    """Write a suffix table, dealt by text and sorted by rank, and return it as read back, so that later look-ups skip files by rank."""
    suffixes.repartition("text_id").sortWithinPartitions("text_id", "rank").write.mode("overwrite").parquet(folder)
    return suffixes.sparkSession.read.parquet(folder)


def open_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def positions_of_ranges(suffixes: DataFrame, ranges: DataFrame) -> DataFrame:
    """(text_id, pattern_id, pos) for half-open rank ranges (text_id, pattern_id, from, to)."""
    ranks = ranges.select("text_id", "pattern_id", F.explode(F.sequence("from", F.col("to") - 1)).alias("rank"))
    return ranks.join(suffixes.select("text_id", "rank", "pos"), ["text_id", "rank"]).select("text_id", "pattern_id", "pos")
