"""Indexes that are written once and searched later, without the texts.

Prefix index: the first characters of each suffix (the head) with its text and place, packed by runs of texts, in numbered parts by ranges of heads; bounds of
the parts are a small table of their own. A pattern is cut into pieces of at most a head's width; a piece is looked up in the parts that can hold it, which are folders, so the others
are never opened. Pieces of one pattern meet by text and place. With a step above 1, only suffixes at each step-th place are written, each with the step - 1
characters before it: wherever a piece begins, such a place follows within a step, so every occurrence is still found, and once.

Transform index: the characters before the sorted suffixes of each text, in blocks, with the counts of each character before a block and the places of
some suffixes. Backward search, places of what it finds, the texts themselves and the merged order of two texts follow from it."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from echograms.functions.bits import bit_table
from echograms.functions.suffix_kernels import SuffixOrder, code_points, text_runs
from echograms.operators.search import _mix

WIDTH, BLOCK, SAMPLE, ROWS = 12, 1024, 32, 256
RUN_POINTS, HEADS_A_PART, BROADCAST_GRAMS, HITS = 1 << 20, 200, 200_000, 1 << 20
START = 0xFFFFFFFF  # stands before the first character of a text


# --- prefix index -----------------------------------------------------------------------------------------------------------

PACKED = "part int, low string, high string, width int, step int, owners binary, serials binary, counts binary, firsts binary, texts binary, places binary, prefixes binary, sizes binary, tails binary, befores binary"


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers, first all their low bytes, then all the next, as many as the largest has. Packed here, since rows wait for their part in the memory of the task
    that writes them."""
    count = (int(values.max(initial=0)).bit_length() + 7) // 8
    raw = b"".join((values >> values.dtype.type(8 * k)).astype(np.uint8).tobytes() for k in range(count))
    return bytes([count]) + len(values).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _from_planes(packed: bytes) -> np.ndarray:
    count, n = packed[0], int.from_bytes(packed[1:9], "little")
    planes = np.frombuffer(pa.decompress(packed[9:], count * n, "zstd", asbytes=True), np.uint8).reshape(count, n)
    out = np.zeros(n, np.uint32)
    for k, plane in enumerate(planes):
        out |= plane.astype(np.uint32) << np.uint32(8 * k)
    return out


def _windows(texts: list[str], width: int, step: int) -> tuple[np.ndarray, ...]:
    """(text, place, window) for each step-th place of texts, the last of which is that of the last character or past it. A window is the code points and 1 from
    step - 1 before the place to the end of its head, 0 beyond either end of the text, and a column."""
    points, offsets = code_points(texts)
    sizes, room = np.diff(offsets), width + 2 * step
    starts = offsets[:-1] + room * np.arange(1, len(texts) + 1)
    spaced = np.zeros(len(points) + room * (len(texts) + 1), np.uint32)
    spaced[np.arange(len(points)) + np.repeat(starts - offsets[:-1], sizes)] = points + np.uint32(1)
    counts = np.where(sizes > 0, (sizes + 2 * step - 2) // step, 0)
    text = np.repeat(np.arange(len(texts)), counts)
    place = (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * step
    first = starts[text] + place - step + 1
    return text, place, np.stack([spaced[first + k] for k in range(step - 1 + width)])


def _by_head(heads: np.ndarray, step: int) -> np.ndarray:
    """Columns in the order of their heads; with step 1, equal ones as they come. Characters are numbered and packed into as few keys as hold them; columns that
    are alike in one key are put in order by the next."""
    width, n = heads.shape
    known = np.zeros(int(heads.max(initial=0)) + 1, dtype=bool)
    known[heads[:step]] = known[0] = True  # between them, the first `step` characters of all heads are all characters of theirs
    name = (np.cumsum(known) - 1).astype(np.uint64)
    bits = max(1, int(known.sum()).bit_length())
    keys, room = [], 64 // bits
    for a in range(0, width, room):
        key = name[heads[a]]
        for k in range(a + 1, min(a + room, width)):
            key = key << np.uint64(bits) | name[heads[k]]
        keys.append((key, bits * min(room, width - a)))
    if step == 1:
        return np.lexsort([key for key, _ in keys[::-1]])
    by, group, live = np.argsort(keys[0][0]), np.zeros(n, np.uint64), np.arange(n)
    for (key, _), (further, size) in zip(keys, keys[1:], strict=False):
        at = by[live]
        new = np.concatenate([[True], (key[at[1:]] != key[at[:-1]]) | (group[1:] != group[:-1])])
        alike = ~(new & np.append(new[1:], True))
        live, at, group = live[alike], at[alike], (np.cumsum(new) - 1).astype(np.uint64)[alike]
        if not len(live):
            break
        order = np.argsort(group << np.uint64(size) | further[at]) if int(group[-1]).bit_length() + size <= 64 else np.lexsort([further[at], group])
        by[live] = at[order]
    return by


def _spelled(points: np.ndarray) -> str:
    return (points[points > 0] - 1).astype("<u4").tobytes().decode("utf-32-le")


def _packed(width: int, edges: list[str], step: int = 1):
    """The suffixes of a run of texts by part, those of a part in one row: in the order of their heads, with what each head shares with the one before and the
    rest of it, and the number in the row of each suffix's text. Texts have serial numbers, as ids may be shared. Ranks are not stored: those of a text that are in
    a part follow each other, the first is. With a step above 1 there are none, and no order of whole suffixes is made."""

    def rows(ids: list, serials: np.ndarray, texts: np.ndarray, places: np.ndarray, ranks: np.ndarray, windows: np.ndarray) -> list[tuple]:
        by = _by_head(windows[step - 1 :], step)
        texts, places, ranks, windows = texts[by], places[by], ranks[by], np.take(windows, by, axis=1)
        heads = windows[step - 1 :]
        shared, equal = np.zeros(len(by), np.int64), np.ones(len(by) - 1, bool)
        for column in heads:
            equal &= column[1:] == column[:-1]
            shared[1:] += equal
        bounds = [0, *(bisect_left(range(len(by)), e, key=lambda i: _spelled(heads[:, i])) for e in edges), len(by)]
        out = []
        for part, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if a < b:
                prefix, head = np.concatenate([[0], shared[a + 1 : b]]), np.ascontiguousarray(heads[:, a:b].T)
                holds = np.zeros(len(ids), bool)
                holds[texts[a:b]] = True
                held, number = np.flatnonzero(holds), (np.cumsum(holds) - 1)[texts[a:b]]
                owners = np.array([ids[t] for t in held.tolist()], "<i8").tobytes()
                order = (b"", b"")
                if step == 1:
                    first = np.zeros(len(held), np.int64)
                    first[number[::-1]] = np.arange(b - a)[::-1]
                    order = _planes(np.bincount(number)), _planes(ranks[a:b][first])
                tails = head[(np.arange(width, dtype=np.uint16) >= prefix.astype(np.uint16)[:, None]) & (head > 0)] - np.uint32(1)
                packed = (number, places[a:b], prefix, np.count_nonzero(heads[:, a:b], axis=0), tails, windows[: step - 1, a:b].ravel())
                out.append((part, _spelled(head[0]), _spelled(head[-1]), width, step, owners, serials[held].astype("<i8").tobytes(), *order, *map(_planes, packed)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PACKED.split(", ")]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 10]
        task = TaskContext.get()
        serial = (task.partitionId() if task else 0) << 40

        def made(ids: list, found: list[tuple]) -> pa.RecordBatch:
            got = rows(ids, serial + np.arange(len(ids)), *(np.concatenate([f[k] for f in found], axis=-1) for k in range(4)))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in got], kind) for k, kind in enumerate(kinds)], names)

        for batch in batches:
            ids, found, size = batch.column(0).to_pylist(), [], 0
            for a, _, texts in text_runs(batch, 1):
                text, place, windows = _windows(texts, width, step)
                if not len(text):
                    continue
                ranks = place
                if step == 1:
                    order = SuffixOrder(texts)
                    text, place, windows = text[order.order], order.position, np.take(windows, order.order, axis=1)
                    ranks = np.arange(len(text)) - order.offsets[:-1][text]
                found.append((a + text, place, ranks, windows))
                size += windows.size // width
                if size >= RUN_POINTS:
                    yield made(ids, found)
                    found, size = [], 0
            if found:
                yield made(ids, found)
            serial += len(ids)

    return run


def _edges(texts: DataFrame, width: int, parts: int) -> list[str]:
    """Heads at which parts begin, from about HEADS_A_PART hashed places for each: they only say how evenly the parts are filled."""
    total = texts.agg(F.sum(F.length("body"))).first()[0] or 0
    if not total or parts < 2:
        return []
    draws = (F.length("body") * (parts * HEADS_A_PART / total) + F.pmod(F.xxhash64("text_id"), F.lit(1 << 20)) / (1 << 20)).cast("int")
    drawn = texts.where("body <> ''").select("body", "text_id", draws.alias("draws")).where("draws > 0").select("body", F.explode(F.transform(F.sequence(F.lit(1), "draws"), lambda k: F.pmod(F.xxhash64("text_id", k), F.length("body")))).alias("at"))
    heads = sorted(r.head for r in drawn.select(F.substring(F.col("body"), (F.col("at") + 1).cast("int"), F.lit(width)).alias("head")).collect())
    return sorted({heads[i * len(heads) // parts] for i in range(1, parts)} - {""}) if heads else []


def store_prefix_index(texts: DataFrame, folder: str, width: int = WIDTH, parts: int | None = None, step: int = 1) -> None:
    """Write the prefix index of texts (text_id, body), text_id a long. parts: how many at most; the session's number of shuffle partitions if not given. step:
    how far the places of written suffixes are apart; above 1 the index is smaller and sooner made, finds the same places, and has no ranks.
    Nothing is shuffled: each task writes what it has for a part, so a frequent head makes a part larger, but no file or row. Null and empty texts have no
    suffixes."""
    spark = texts.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.select(F.col("text_id").cast("long"), "body").mapInArrow(_packed(width, _edges(texts, width, parts), step), PACKED)
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(f"{folder}/suffixes")
    kept = spark.read.schema(PACKED).parquet(f"{folder}/suffixes")
    kept.groupBy("part").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.first("width").alias("width"), F.first("step").alias("step")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/bounds")


def _hashes(heads: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(size, hashes of the first `size` characters) for rows of code points and 1."""
    h = np.zeros(len(heads), np.uint64)
    for k in range(sizes[-1] if sizes else 0):
        h = _mix(h * np.uint64(3) + heads[:, k].astype(np.uint64))
        if k + 1 in sizes:
            yield k + 1, h


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram) with the gram's size and hash."""
    for batch in batches:
        grams = batch.column(0).to_pylist()
        points = [np.frombuffer(g.encode("utf-32-le"), "<u4").astype(np.uint32)[None] + np.uint32(1) for g in grams]
        found = [int(next(h for _, h in _hashes(p, [p.shape[1]]))[0].astype(np.int64)) for p in points]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.shape[1] for p in points], pa.int32()), pa.array(found, pa.int64())], ["gram", "size", "hash"])


def _unpacked(row: dict, width: int) -> tuple[np.ndarray, ...]:
    """(text number, place, rank, heads) of the suffixes of a row of the index; without ranks, all are 0."""
    prefixes, sizes, tails = (_from_planes(row[k]) for k in ("prefixes", "sizes", "tails"))
    n, column = len(sizes), np.arange(width, dtype=np.uint16)
    heads, rows = np.zeros((n, width), np.uint32), np.arange(n, dtype=np.uint32)
    heads[(column >= prefixes.astype(np.uint16)[:, None]) & (column < sizes.astype(np.uint16)[:, None])] = tails + np.uint32(1)
    heads = np.ascontiguousarray(heads.T)
    # What a head shares with the one before stands in the last row that spells that column out, or ends before it.
    for k, points in enumerate(heads):
        points[:] = points[np.maximum.accumulate(np.where(prefixes <= k, rows, np.uint32(0)))]
    number, places, ranks = _from_planes(row["texts"]).astype(np.int64), _from_planes(row["places"]).astype(np.int64), np.zeros(n, np.int64)
    if row["counts"]:
        counts, firsts = (_from_planes(row[k]).astype(np.int64) for k in ("counts", "firsts"))
        ranks[np.argsort(number, kind="stable")] = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(firsts, counts)
    return number, places, ranks, heads.T


def _keys(points: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings of the same order."""
    return np.ascontiguousarray(points, ">u4").view(f"S{4 * points.shape[1]}").ravel()


class Asked:
    """Grams to look up in sorted heads. A gram may begin at each of the `step` places up to a written one: what it has from there on, its rest, is searched for
    among the heads, once for all grams that share it, and the characters before tell which of them is there. With a step above 1, grams shorter than a head would
    leave rests of a letter or none; they are read off the characters before and the heads, along a tree of such grams."""

    def __init__(self, grams: list[str], width: int, step: int):
        self.grams, self.step = grams, step
        known: dict[tuple[str, int], list[int]] = {}
        edges: dict[tuple[int, int], int] = {}
        ends = [-1]
        for i, gram in enumerate(grams):
            if step == 1 or len(gram) >= max(step, width):
                for shift in range(step):
                    known.setdefault((gram[shift:], shift), []).append(i)
                continue
            node = 0
            for letter in gram:
                node = edges.setdefault((node, ord(letter) + 1), len(ends))
                ends += [-1] * (node == len(ends))
            ends[node] = i
        groups = sorted(known)
        self.rests, self.shifts = [rest for rest, _ in groups], np.array([shift for _, shift in groups], np.int64)
        self.low, self.high = (np.full((len(groups), width), x, np.uint32) for x in (0, 0xFFFFFFFF))
        sizes = np.array([len(known[g]) for g in groups], np.int64)
        at, which = np.repeat(np.arange(len(groups)), sizes), np.array([i for g in groups for i in known[g]], np.int64)
        befores = np.zeros((len(at), step - 1), np.uint32)
        for k, (rest, _) in enumerate(groups):
            self.low[k, : len(rest)] = self.high[k, : len(rest)] = code_points([rest])[0] + np.uint32(1)
        for row, i, shift in zip(befores, which.tolist(), self.shifts[at].tolist(), strict=True):
            row[step - 1 - shift :] = code_points([grams[i][:shift]])[0] + np.uint32(1)
        self.low, self.high = _keys(self.low), _keys(self.high)
        keys = self._members(at, befores)
        by = np.argsort(keys, kind="stable")
        self.members, self.which = keys[by], which[by]
        self.asks = np.arange(step - 1) >= (step - 1 - self.shifts)[:, None]  # the characters before that tell the grams of a group
        starts = np.cumsum(sizes) - sizes
        least, most = (np.array([f.reduceat(column, starts) for column in befores.T]) if len(at) else befores.T for f in (np.minimum, np.maximum))
        self.common = np.where(least == most, least, np.uint32(0))  # those that all grams of a group share
        self.first = np.zeros(max((c for node, c in edges if not node), default=0) + 2, np.int64)  # the last stands for all characters beyond
        for (node, c), to in edges.items():
            if not node:
                self.first[c] = to
        self.edges = np.sort(np.array([node << 21 | c for node, c in edges], np.int64))
        self.onto = np.array([edges[e >> 21, e & (1 << 21) - 1] for e in self.edges.tolist()], np.int64)
        self.ends = np.array(ends, np.int64)

    def _members(self, groups: np.ndarray, befores: np.ndarray) -> np.ndarray:
        return _keys(np.hstack([groups[:, None].astype(np.uint32) + np.uint32(1), befores]))

    def _told(self, groups: np.ndarray, at: np.ndarray, befores: np.ndarray) -> tuple[np.ndarray, ...]:
        """(suffix, gram, shift) of the suffixes that begin with a group's rest, for those that have a gram of it."""
        for before, common in zip(befores, self.common, strict=True):
            asked = common[groups]
            alike = (asked == 0) | (before[at] == asked)
            groups, at = groups[alike], at[alike]
        keys = self._members(groups, np.where(self.asks[groups], befores[:, at].T, np.uint32(0)))
        found = np.minimum(np.searchsorted(self.members, keys), len(self.members) - 1)
        right = np.flatnonzero(self.members[found] == keys)
        return at[right], self.which[found[right]], self.shifts[groups[right]]

    def _along_tree(self, windows: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        """(suffix, gram, shift) of the grams of the tree in windows, of which each column is given."""
        for start in range(self.step):
            node = self.first[np.minimum(windows[start], len(self.first) - 1)]
            at = np.flatnonzero(node)
            node = node[at]
            for k, column in enumerate(windows[start:]):
                if k:
                    keys = node << 21 | column[at]
                    edge = np.minimum(np.searchsorted(self.edges, keys), len(self.edges) - 1)
                    on = np.flatnonzero(self.edges[edge] == keys)
                    at, node = at[on], self.onto[edge[on]]
                if not len(at):
                    break
                ended = np.flatnonzero(self.ends[node] >= 0)
                if len(ended):
                    yield at[ended], self.ends[node[ended]], np.full(len(ended), self.step - 1 - start)

    def found(self, low: str, high: str, heads: np.ndarray, befores: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(suffix, gram, shift) for sorted heads from low to high and the characters before them, one row for each of the step - 1 places."""
        spans = [(bisect_left(self.rests, low[:k]), bisect_right(self.rests, low[:k])) for k in range(1, len(low))]
        spans.append((bisect_left(self.rests, low), bisect_right(self.rests, high)))
        groups = np.concatenate([np.arange(a, b) for a, b in spans])
        keys = _keys(heads)
        first = np.searchsorted(keys, self.low[groups])
        sizes = np.searchsorted(keys, self.high[groups], side="right") - first
        groups, first, sizes = (x[sizes > 0] for x in (groups, first, sizes))
        run = (np.cumsum(sizes) - sizes) // HITS
        for r in np.unique(run).tolist():
            g, a, n = (x[run == r] for x in (groups, first, sizes))
            yield self._told(np.repeat(g, n), np.arange(n.sum()) + np.repeat(a - np.cumsum(n) + n, n), befores)
        if len(self.edges):
            yield from self._along_tree([*befores, *heads.T])


OFFERED = "text_id long, serial long, pos long, rank long, gram string"


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(row, suffixes as unpacked, characters before them, what makes a batch of offers of some suffixes) for each row of the index."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
            number, places, ranks, heads = _unpacked(row, row["width"])
            befores = _from_planes(row["befores"]).reshape(row["step"] - 1, -1) if row["step"] > 1 else np.zeros((0, len(places)), np.uint32)
            owners, serials = (np.frombuffer(row[k], "<i8") for k in ("owners", "serials"))

            def offers(at, shift, grams, row=row, number=number, places=places, ranks=ranks, owners=owners, serials=serials) -> pa.RecordBatch:
                rank = pa.array(ranks[at]) if row["counts"] else pa.nulls(len(at), pa.int64())
                columns = [pa.array(owners[number[at]], pa.int64()), pa.array(serials[number[at]], pa.int64()), pa.array(places[at] - shift, pa.int64()), rank, grams]
                return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in OFFERED.split(", ")])

            yield row, heads, befores, offers


def _searched_for(asked):
    """Offers of the suffixes in rows of the index that have a gram, by binary search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = pa.array(asked.value.grams, pa.string())

        def made(found: list[tuple], offers) -> pa.RecordBatch:
            at, which, shift = (np.concatenate([f[k] for f in found]) for k in range(3))
            return offers(at, shift, grams.take(pa.array(which, pa.int64())))

        for row, heads, befores, offers in _rows_of(batches):
            found, size = [], 0
            for some in asked.value.found(row["low"], row["high"], heads, befores):
                found.append(some)
                size += len(some[0])
                if size > HITS:
                    yield made(found, offers)
                    found, size = [], 0
            if size:
                yield made(found, offers)

    return run


def _offered(known, sizes: list[int]):
    """Offers of the suffixes in rows of the index whose characters the bit table lets through, for more grams than a task should hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, heads, befores, offers in _rows_of(batches):
            windows = np.hstack([befores.T, heads])
            for shift in range(row["step"]):
                own = windows[:, row["step"] - 1 - shift :]
                for k, h in _hashes(own, [s for s in sizes if s <= row["width"]]):
                    at = np.flatnonzero((own[:, 0] > 0) & (own[:, k - 1] > 0) & known.value.test(h))
                    spelled = (own[at, :k] - np.uint32(1)).astype("<u4").tobytes().decode("utf-32-le")
                    yield offers(at, shift, pa.array([spelled[j : j + k] for j in range(0, len(spelled), k)], pa.string()))

    return run


def _parts(bounds: list[tuple[int, str, str]], width: int, step: int):
    """Rows (gram) with each part that may hold heads which begin with the gram, or with what is left of it at one of the next step - 1 places. Bounds are in
    order; Python compares strings by code point, as Spark does by UTF-8 byte."""
    numbers, lows, highs = ([b[i] for b in bounds] for i in range(3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rests = {gram[k:] for gram in batch.column(0).to_pylist() for k in range(step)}
            found = {numbers[p] for rest in rests for p in range(bisect_left(highs, rest), bisect_right(lows, rest + "\U0010ffff" * width))}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], ["part"])

    return run


def look_up(spark: SparkSession, folder: str, patterns: DataFrame) -> DataFrame:
    """(text_id, pattern_id, pos, rank) of every occurrence of patterns (pattern_id, pattern) in the texts of a prefix index; rank is that of the suffix there, null
    if the index has none.

    Only parts whose heads a piece of some pattern may begin are opened; their numbers, at most one for each part, reach the driver. Up to BROADCAST_GRAMS pieces
    are sent to the tasks and searched for; of more, a bit table is, and suffixes that it lets through meet the pieces in a join. A pattern longer than a head is the
    pieces of a head's width that cover it, and occurs where all of them do. Empty and null patterns occur nowhere."""
    bounds = sorted(tuple(r) for r in spark.read.parquet(f"{folder}/bounds").collect())
    width, step = bounds[0][3:] if bounds else (WIDTH, 1)
    size = F.length("pattern")
    last = size - width
    shifts = F.when(last <= 0, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(width)), F.array(last))))
    pieces = patterns.where(size > 0).select(F.monotonically_increasing_id().alias("asked"), "pattern_id", "pattern", shifts.alias("shifts")).select("asked", "pattern_id", F.size("shifts").alias("pieces"), F.explode("shifts").alias("shift"), "pattern")
    grams = pieces.select("asked", "pattern_id", "pieces", "shift", F.substring(F.col("pattern"), F.col("shift") + 1, F.lit(width)).alias("gram"))
    distinct = grams.select("gram").distinct()
    needed = sorted(r.part for r in distinct.mapInArrow(_parts([b[:3] for b in bounds], width, step), "part int").distinct().collect())
    opened = (spark.read.schema(PACKED).parquet(f"{folder}/suffixes").where(F.col("part").isin(needed)) if bounds else spark.createDataFrame([], PACKED)).drop("part")
    held = [r.gram for r in distinct.limit(BROADCAST_GRAMS + 1).collect()]
    if few := len(held) <= BROADCAST_GRAMS:
        offers = opened.mapInArrow(_searched_for(spark.sparkContext.broadcast(Asked(held, width, step))), OFFERED)
    else:
        hashed = distinct.mapInArrow(_hashed, "gram string, size int, hash long")
        counts = hashed.groupBy("size").agg(F.count("*").alias("n")).collect()  # at most one row for each size up to a head's
        known = spark.sparkContext.broadcast(bit_table(hashed, "hash", sum(r.n for r in counts)))
        offers = opened.mapInArrow(_offered(known, sorted(r["size"] for r in counts)), OFFERED)
    met = offers.join(F.broadcast(grams) if few else grams, "gram").select("text_id", "serial", "asked", "pattern_id", (F.col("pos") - F.col("shift")).alias("pos"), "rank", "pieces", "shift").where("pos >= 0")
    first = F.max(F.when(F.col("shift") == 0, F.col("rank"))).alias("rank")
    whole = met.groupBy("serial", "asked", "text_id", "pattern_id", "pieces", "pos").agg(F.count("*").alias("n"), first).where("n = pieces")
    return whole.select("text_id", "pattern_id", "pos", "rank")


def looked_up_ranges(occurrences: DataFrame) -> DataFrame:
    """(text_id, pattern_id, from, to): half-open ranges of ranks, from rows of look_up."""
    return occurrences.groupBy("text_id", "pattern_id").agg(F.min("rank").alias("from"), (F.max("rank") + 1).alias("to"))


# --- transform index --------------------------------------------------------------------------------------------------------

BLOCKS = "text_id long, block long, n_rows long, alphabet binary, before binary, symbols binary, sampled binary, places binary"


def _blocks(block: int, sample: int):
    """The rows of a text's suffixes in order, that of its end first: the character before each, in blocks. before: how often each character of the alphabet
    stands in earlier blocks. Of each sample-th place of the text, the row in the block and the place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, _, texts in text_runs(batch, 1):
                order = SuffixOrder(texts)
                lefts, rows = order.lefts(), []
                for i, text in enumerate(texts):
                    low, high = int(order.offsets[i]), int(order.offsets[i + 1])
                    if low == high:
                        continue
                    symbols = np.concatenate([order.points[high - 1 : high], lefts[low:high]]).astype("<u4")
                    places = np.concatenate([[high - low], order.position[low:high]]).astype("<i8")
                    alphabet, which = np.unique(symbols, return_inverse=True)
                    counts = np.zeros(len(alphabet), dtype="<i8")
                    for s in range(0, len(symbols), block):
                        here = np.flatnonzero(places[s : s + block] % sample == 0)
                        rows.append((ids[a + i], s // block, len(symbols), alphabet.tobytes(), counts.tobytes(), symbols[s : s + block].tobytes(), here.astype("<u4").tobytes(), places[s + here].tobytes()))
                        counts = counts + np.bincount(which[s : s + block], minlength=len(alphabet))
                kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in BLOCKS.split(", ")])

    return run


def store_transform_index(texts: DataFrame, folder: str, block: int = BLOCK, sample: int = SAMPLE) -> None:
    """Write the transform index of texts (text_id, body); null and empty texts have none. sample: of how many places one is kept."""
    texts.select(F.col("text_id").cast("long"), "body").mapInArrow(_blocks(block, sample), BLOCKS).write.mode("overwrite").parquet(folder)


class Transform:
    """The transform of one text from its blocks, in order. Row 0 is that of the text's end; the row of a suffix is its rank and one."""

    def __init__(self, blocks: list[dict]):
        first = blocks[0]
        self.alphabet = np.frombuffer(first["alphabet"], "<u4")
        self.before = np.stack([np.frombuffer(b["before"], "<i8") for b in blocks])
        self.parts = [np.frombuffer(b["symbols"], "<u4") for b in blocks]
        self.block = len(self.parts[0])
        self.sampled = [(np.frombuffer(b["sampled"], "<u4").astype(np.int64) + i * self.block, np.frombuffer(b["places"], "<i8")) for i, b in enumerate(blocks)]
        totals = self.before[-1] + np.array([np.count_nonzero(self.parts[-1] == c) for c in self.alphabet.tolist()])
        totals = np.where(self.alphabet == START, 0, totals)  # it stands before no suffix
        self.smaller = 1 + np.cumsum(totals) - totals  # the first row of a suffix that begins with each character
        self.index = {c: i for i, c in enumerate(self.alphabet.tolist())}
        self.n = int(first["n_rows"])

    def count(self, c: int, row: int) -> int:
        """How often the character number c stands in rows below row."""
        if row >= self.n:
            return int(self.before[-1, c]) + int(np.count_nonzero(self.parts[-1] == self.alphabet[c]))
        b = row // self.block
        return int(self.before[b, c]) + int(np.count_nonzero(self.parts[b][: row - b * self.block] == self.alphabet[c]))

    def ranks(self, pattern: str) -> tuple[int, int] | None:
        """The range of ranks of the suffixes that begin with the pattern, from its last letter to its first."""
        low, high = 0, self.n
        for letter in reversed(pattern):
            c = self.index.get(ord(letter))
            if c is None:
                return None
            low, high = int(self.smaller[c]) + self.count(c, low), int(self.smaller[c]) + self.count(c, high)
            if low >= high:
                return None
        return low - 1, high - 1

    def steps(self) -> np.ndarray:
        """For each row that of the suffix one place earlier; for the row of the whole text itself, its own."""
        out = []
        for b, part in enumerate(self.parts):
            by = np.argsort(part, kind="stable")
            _, first, which = np.unique(part[by], return_index=True, return_inverse=True)
            within = np.empty(len(part), dtype=np.int64)
            within[by] = np.arange(len(part)) - first[which]
            c = np.searchsorted(self.alphabet, part)
            out.append(np.where(part == START, np.arange(len(part)) + b * self.block, self.smaller[c] + self.before[b, c] + within))
        return np.concatenate(out)

    def places(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes of some rows: steps back until a sampled one, whose place is known."""
        known = np.full(self.n, -1, dtype=np.int64)
        for at, place in self.sampled:
            known[at] = place
        back, at, moved = self.steps(), rows.copy(), np.zeros(len(rows), dtype=np.int64)
        live = np.flatnonzero(known[at] < 0)
        while len(live):
            at[live] = back[at[live]]
            moved[live] += 1
            live = live[known[at[live]] < 0]
        return known[at] + moved

    def walk(self) -> tuple[list[int], list[int]]:
        """(rows, characters) from the end of the text to its start: the row of each suffix but the whole text's, and the character before it."""
        back, symbols = self.steps().tolist(), np.concatenate(self.parts).tolist()
        rows, characters, row = [], [], 0
        while symbols[row] != START:
            rows.append(row)
            characters.append(symbols[row])
            row = back[row]
        return rows, characters


def _of_texts(index: DataFrame) -> DataFrame:
    """(text_id, blocks): the blocks of each text in order."""
    columns = [x.split()[0] for x in BLOCKS.split(", ")][1:]
    return index.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("blocks"))


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, blocks, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            index = Transform(blocks)
            found = [(a["pattern_id"], *r) for a in asked if (r := index.ranks(a["pattern"]))]
            places = [index.places(np.arange(low + 1, high + 1)) for _, low, high in found]
            yield pa.RecordBatch.from_arrays([pa.array([text] * len(found), pa.int64()), pa.array([f[0] for f in found], batch.schema.field(2).type.value_type.field("pattern_id").type), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([np.sort(p).tolist() for p in places], pa.list_(pa.int64()))], ["text_id", "pattern_id", "from", "to", "places"])


def search_index(index: DataFrame, patterns: DataFrame, patterns_a_row: int = 1000) -> DataFrame:
    """(text_id, pattern_id, from, to, places) for patterns (text_id, pattern_id, pattern) that occur in their text: the range of ranks and the places in order, from
    the rows of a transform index alone. A text's blocks meet its patterns, patterns_a_row at a time; those of texts without patterns are not read out."""
    asked = patterns.where("text_id is not null and pattern <> ''").withColumn("salt", F.pmod(F.xxhash64("pattern_id"), F.ceil(F.count("*").over(_by_text()) / patterns_a_row)))
    lists = asked.groupBy("text_id", "salt").agg(F.collect_list(F.struct("pattern_id", "pattern")).alias("asked"))
    rows = _of_texts(index).join(lists, "text_id").select("text_id", "blocks", "asked")
    return rows.mapInArrow(_searched, StructType([StructField("text_id", StructType.fromDDL("x long")["x"].dataType), StructField("pattern_id", patterns.schema["pattern_id"].dataType), *StructType.fromDDL("`from` long, `to` long, places array<long>")]))


def _by_text():
    from pyspark.sql import Window

    return Window.partitionBy("text_id")


def _recovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):  # the blocks of a few texts are spelled out at a time
            part = batch.slice(start, ROWS)
            bodies = pa.array((np.array(Transform(b.as_py()).walk()[1][::-1], dtype="<u4").tobytes().decode("utf-32-le") for b in part.column(1)), pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), bodies], ["text_id", "body"])


def stored_texts(index: DataFrame) -> DataFrame:
    """(text_id, body): the texts of a transform index, read out of it."""
    return _of_texts(index).mapInArrow(_recovered, "text_id long, body string")


def merged_order(base: Transform, other: Transform) -> np.ndarray:
    """Ranks of the suffixes of `other`, by place, among the suffixes of both; of equal ones those of base come first.

    The suffixes of other are met from the shortest on. k, the number of base's suffixes (with the empty one) that are not larger, is known for the empty one; a
    character more in front, it is what stands before the first k rows of base as that character, and all that begins with a smaller one."""
    rows, characters = other.walk()
    n = len(characters)
    symbols = np.concatenate(base.parts)
    by = np.argsort(symbols, kind="stable")
    edges = np.searchsorted(symbols[by], base.alphabet, side="left").tolist()
    held = {c: by[a:b].tolist() for c, a, b in zip(base.alphabet.tolist(), edges, [*edges[1:], len(by)], strict=True) if c != START}
    letters = [c for c in base.alphabet.tolist() if c != START]
    first = {c: int(base.smaller[base.index[c]]) for c in letters}
    ranks, k = np.zeros(n, dtype=np.int64), 1
    own = [*rows[1:], int(other.steps()[rows[-1]])] if n else []
    for i, c in enumerate(characters):  # the suffix that begins with this character, n - 1 - i
        if c in held:
            k = first[c] + bisect_left(held[c], k)
        else:
            below = bisect_left(letters, c)
            k = base.n if below == len(letters) else first[letters[below]]
        ranks[n - 1 - i] = own[i] - 1 + k - 1
    return ranks


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base_id, other_id, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            base, other = Transform(a), Transform(b)
            ranks = merged_order(base, other)
            total = base.n - 1 + len(ranks)
            is_other, place = np.zeros(total, dtype=bool), np.zeros(total, dtype=np.int64)
            is_other[ranks] = True
            place[ranks] = np.arange(len(ranks))
            place[~is_other] = base.places(np.arange(1, base.n))
            ids = [pa.array(np.full(total, x, dtype=np.int64)) for x in (base_id, other_id)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(np.arange(total)), pa.array(is_other), pa.array(place)], ["base_id", "other_id", "rank", "is_other", "pos"])


def merged_suffixes(index: DataFrame, relation: DataFrame) -> DataFrame:
    """(base_id, other_id, rank, is_other, pos): the suffixes of both texts of each pair (base_id, other_id) in one order, of equal ones the base's first, from their
    stored transforms: the two orders are interleaved by counting, and no suffix is compared with another."""
    texts = _of_texts(index)
    base, other = (texts.select(F.col("text_id").alias(f"{s}_id"), F.col("blocks").alias(f"{s}_blocks")) for s in ("base", "other"))
    rows = relation.join(base, "base_id").join(other, "other_id").select("base_id", "other_id", "base_blocks", "other_blocks")
    return rows.mapInArrow(_merged, "base_id long, other_id long, rank long, is_other boolean, pos long")
