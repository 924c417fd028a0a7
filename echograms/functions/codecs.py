"""Sequential encodings of a text. Each has state that runs through the text, so a text is encoded by one task, and texts go in parallel.

Texts are encoded as UTF-8 bytes."""

from __future__ import annotations

import heapq
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echograms.functions.suffix_kernels import SuffixOrder

#: Shortest run that is shortened, longest count in one byte, and the size of the code dictionary.
RUN, COUNT, DICTIONARY = 4, 255, 1 << 14
RUN_BYTES, MANY = 1 << 20, 300


def move_to_front(raw: bytes, order: list[int] | None = None) -> bytes:
    """Each byte as its place in a list from which it then moves to the front; the list starts in order of value."""
    table, out = list(order or range(256)), bytearray()
    for x in raw:
        i = table.index(x)
        out.append(i)
        if i:
            table.insert(0, table.pop(i))
    return bytes(out)


def from_front(codes: bytes) -> bytes:
    table, out = list(range(256)), bytearray()
    for i in codes:
        x = table[i]
        out.append(x)
        if i:
            table.insert(0, table.pop(i))
    return bytes(out)


def runs(raw: bytes) -> Iterator[tuple[int, int]]:
    """(value, length) of the runs of equal bytes."""
    data = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff(data)) + 1
    starts = np.concatenate([[0], edges]) if len(data) else edges
    return zip(data[starts].tolist(), np.diff(np.append(starts, len(data))).tolist(), strict=True)


def run_lengths(raw: bytes) -> bytes:
    """Runs of up to three bytes as they are; longer ones as four bytes and the count of the rest. A count of 255 stands for itself, and the run
    goes on as if three bytes had just been written."""
    out = bytearray()
    for value, n in runs(raw):
        out += bytes([value]) * min(n, RUN)
        n -= RUN
        while n >= 0:
            out.append(min(n, COUNT))
            n -= COUNT + 1
            if n >= 0:
                out.append(value)
    return bytes(out)


def from_run_lengths(packed: bytes) -> bytes:
    out, i, same = bytearray(), 0, 0
    while i < len(packed):
        x = packed[i]
        same = same + 1 if out and out[-1] == x and same else 1
        out.append(x)
        i += 1
        if same == RUN and i < len(packed):
            out += bytes([x]) * packed[i]
            i += 1
            same = RUN - 1
    return bytes(out)


class _Phrases:
    """Phrases by code: all bytes, then pairs seeded by small values; when all codes are taken, the least recently used one above the bytes is
    given up.

    The table is seeded once and set back after each text. Seeded codes that were never used are the oldest, in
    order, so until the last of them is given up it is enough to note when each other code was used."""

    def __init__(self):
        pairs = [bytes(p) for i in range(DICTIONARY // 256) for p in [(i, i), *[q for j in range(i + 1, 256) for q in ((i, j), (j, i))]]]
        self.seeds = [bytes([i]) for i in range(256)] + pairs[: DICTIONARY - 256]
        self.seeded = {v: k for k, v in enumerate(self.seeds)}
        self.text, self.code = self.seeds.copy(), self.seeded.copy()
        self.used: dict[int, int] = {}  # when a code above the bytes was used
        self.order: OrderedDict[int, None] | None = None  # those codes from the oldest use to the last, once no others are left
        self.oldest = 256

    def reset(self) -> None:
        if self.oldest - 256 > MANY:  # a copy is then faster
            self.text, self.code = self.seeds.copy(), self.seeded.copy()
        else:
            gone = [k for k in range(256, self.oldest) if self.text[k] is not self.seeds[k]]
            for k in gone:
                del self.code[self.text[k]]
            for k in gone:
                self.text[k] = self.seeds[k]
                self.code[self.seeds[k]] = k
        self.used.clear()
        self.order, self.oldest = None, 256

    def learn(self, phrase: bytes, now: int) -> None:
        """Give the code that was not used for longest to a phrase that has none."""
        used, order = self.used, self.order
        if order is None:
            old = self.oldest
            while old in used:
                old += 1
            if old < DICTIONARY:
                self.oldest = old + 1
            else:
                self.oldest, self.order = old, OrderedDict.fromkeys(sorted(used, key=used.__getitem__))
                order = self.order
        if order is not None:
            old = next(iter(order))
            order.move_to_end(old)
        del self.code[self.text[old]]
        self.text[old], self.code[phrase] = phrase, old
        used[old] = now


_book: _Phrases | None = None


def _fresh() -> _Phrases:
    """The table of this process as it is before any text."""
    global _book
    book, _book = _book or _Phrases(), None  # one that is left halfway is not taken up again
    return book


def _given_back(book: _Phrases) -> None:
    global _book
    book.reset()
    _book = book


def phrases(raw: bytes) -> list[int]:
    """Codes of the longest known phrases in turn; the last two together are learned as a new phrase."""
    book, out, at, last, end = _fresh(), [], 0, b"", len(raw)
    known, used, learn, add = book.code, book.used, book.learn, out.append
    lengths: dict[bytes, int] = {}  # of the phrases that were learned with these first 2 or 4 bytes, a bit for each length: 3 and 4, or more
    while at < end:
        code = None
        for head in (4, 2):
            mask = lengths.get(raw[at : at + head])
            while mask:
                n = mask.bit_length()
                phrase = raw[at : at + n]  # shorter at the end of the text, where a shorter phrase may be found
                if (code := known.get(phrase)) is not None:
                    break
                mask ^= 1 << n - 1
            if code is not None:
                break
        else:
            phrase = raw[at : at + 2]
            if (code := known.get(phrase)) is None:
                phrase = raw[at : at + 1]
                code = phrase[0]
        add(code)
        if code > 255:
            used[code] = 2 * at
            if book.order is not None:
                book.order.move_to_end(code)
        if last:
            new = last + phrase
            if new not in known:
                learn(new, 2 * at + 1)
                size = len(new)
                if size > 2:
                    head = new[:4] if size > 4 else new[:2]
                    lengths[head] = lengths.get(head, 0) | 1 << size - 1
        last = phrase
        at += len(phrase)
    _given_back(book)
    return out


def from_phrases(codes: list[int]) -> bytes:
    book, out, last = _fresh(), [], b""
    known, text, used, learn, add = book.code, book.text, book.used, book.learn, out.append
    for i, code in enumerate(codes):
        phrase = text[code]
        add(phrase)
        if code > 255:
            used[code] = 2 * i
            if book.order is not None:
                book.order.move_to_end(code)
        if last:
            new = last + phrase
            if new not in known:
                learn(new, 2 * i + 1)
        last = phrase
    _given_back(book)
    return b"".join(out)


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Bits of each symbol's prefix code of least total length; one symbol alone takes one bit."""
    if len(counts) < 2:
        return {s: 1 for s in counts}
    heap = [(n, s, i) for i, (s, n) in enumerate(sorted(counts.items()))]
    heapq.heapify(heap)
    up, new = [0] * (2 * len(heap) - 1), len(heap)
    while len(heap) > 1:
        a, i, left = heapq.heappop(heap)
        b, j, right = heap[0]
        up[left] = up[right] = new
        heapq.heapreplace(heap, (a + b, min(i, j), new))
        new += 1
    depth = [0] * new
    for node in range(new - 2, -1, -1):  # what holds a node comes after it
        depth[node] = depth[up[node]] + 1
    return dict(zip(sorted(counts), depth, strict=False))


def prefix_codes(bits: dict[int, int]) -> dict[int, str]:
    """Canonical codes: in order of length, then symbol."""
    out, code, last = {}, 0, 0
    for s in sorted(bits, key=lambda s: (bits[s], s)):
        code <<= bits[s] - last
        last = bits[s]
        out[s] = format(code, f"0{last}b")
        code += 1
    return out


def factors(text: str) -> int:
    """Number of factors when each is the shortest string that does not start earlier; the last may be one that does."""
    longest = SuffixOrder([text]).longest_earlier().tolist()
    n = at = 0
    while at < len(text):
        at += longest[at] + 1
        n += 1
    return n


def _map(function: Callable, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in _runs_of_bytes(batch.column(1)):
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array((function(x) for x in part.column(1).to_pylist()), kind)], ["text_id", "value"])

    return run


def _runs_of_bytes(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, row after the last) for runs of rows of about RUN_BYTES, so that what is made of them does not wait for a whole batch."""
    start = 0
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) or pa.types.is_large_list(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, wide)
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offsets, int(offsets[start]) + RUN_BYTES, side="right")) - 1)
        yield start, stop
        start = stop


def encode_texts(texts: DataFrame, codec: str) -> DataFrame:
    """(text_id, value) with value the text's UTF-8 bytes (null: none) in one of the encodings mtf, rle (binary) or lzw (array of codes)."""
    functions = {"mtf": (move_to_front, pa.binary(), "binary"), "rle": (run_lengths, pa.binary(), "binary"), "lzw": (phrases, pa.list_(pa.int32()), "array<int>")}
    function, kind, sql = functions[codec]
    return texts.select("text_id", "body").mapInArrow(_map(lambda x: function((x or "").encode()), kind), f"text_id long, value {sql}")


def decode_texts(encoded: DataFrame, codec: str) -> DataFrame:
    """(text_id, value string): the inverse of encode_texts."""
    function = {"mtf": from_front, "rle": from_run_lengths, "lzw": from_phrases}[codec]
    return encoded.select("text_id", "value").mapInArrow(_map(lambda x: function(x).decode(), pa.string()), "text_id long, value string")


def front_codes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(move-to-front codes of all texts one after the other, offsets). Only bytes unlike the one before have a code other than 0: how many others were seen
    since the same byte, told symbol by symbol from where each was last seen; before that, its value and how many greater ones were seen in the text."""
    data = np.frombuffer(b"".join(raws), np.uint8)
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    codes = np.zeros(len(data), np.uint8)
    if not len(data):
        return codes, offsets
    head = np.concatenate([[True], data[1:] != data[:-1]])
    begins = offsets[:-1][sizes > 0]
    head[begins] = True
    at = np.flatnonzero(head)
    m = len(at)
    sym = data[at]
    starts = np.searchsorted(at, begins).astype(np.int32)
    begin = np.repeat(starts, np.diff(np.append(starts, m)))
    order = np.argsort(sym, kind="stable").astype(np.int32)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(sym[order])) + 1, [m]])
    since = np.full(m, -1, np.int32)
    since[order[1:]] = order[:-1]
    since[order[edges[:-1]]] = -1
    first = np.flatnonzero(since < begin)
    since[first] = begin[first] - 1
    count, fresh = np.full(m, -1, np.int16), sym[first].astype(np.int16)
    for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
        places, c = order[a:b], sym[order[a]]
        last = np.repeat(np.concatenate([[-1], places]).astype(np.int32), np.diff(np.concatenate([[0], places, [m]])))
        seen = last > since
        count += seen
        fresh += seen[first] & (sym[first] < c)
    count[first] = fresh
    codes[at] = count
    return codes, offsets


def coded_bytes(counts: np.ndarray) -> int:
    """Bytes that arithmetic coding of symbols with these counts comes near."""
    n = int(counts.sum())
    p = counts[counts > 0] / max(1, n)
    return int((np.ceil(round(float(-(p * np.log2(p)).sum()) * n, 6)) + 7) // 8)


def front_sizes(raws: list[bytes]) -> dict[str, list[int]]:
    """n, zeros, falls and est_bytes of each text, as front_statistics says."""
    codes, offsets = front_codes(raws)
    out: dict[str, list[int]] = {"n": [], "zeros": [], "falls": [], "est_bytes": []}
    for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        own = codes[a:b]
        counts, zero = np.bincount(own, minlength=1), own == 0
        for name, value in (("n", b - a), ("zeros", int(counts[0])), ("falls", int(np.count_nonzero(zero[1:] > zero[:-1]))), ("est_bytes", coded_bytes(counts))):
            out[name].append(value)
    return out


def _front_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop in _runs_of_bytes(batch.column(1)):
            part = batch.slice(start, stop - start)
            sizes = front_sizes([(x or "").encode() for x in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, pa.int64()) for v in sizes.values())], ["text_id", *sizes])


def front_statistics(texts: DataFrame) -> DataFrame:
    """(text_id, n, zeros, falls, est_bytes) of each text's move-to-front codes: how many there are, how many are 0, how often a 0 follows another
    code, and the size in bytes that arithmetic coding of the codes comes near. Given transformed texts, these are the usual estimates of a
    block-sorting compressor."""
    return texts.select("text_id", "body").mapInArrow(_front_rows, "text_id long, n long, zeros long, falls long, est_bytes long")


def factor_counts(texts: DataFrame) -> DataFrame:
    return texts.select("text_id", "body").mapInArrow(_map(lambda x: factors(x or ""), pa.int64()), "text_id long, value long")


def run_length_size(texts: DataFrame) -> DataFrame:
    """(text_id, bytes): size of the run-length encoding, by sums over runs alone."""
    raw = F.when(F.length("body") > 0, F.regexp_extract_all(F.hex(F.encode(F.col("body"), "UTF-8")), F.lit("(?:\\G)(..)\\1*+"), F.lit(0)))
    n = (F.length("run") / 2).cast("long")
    size = F.when(n < RUN, n).otherwise(RUN + 1 + 2 * F.floor((n - RUN) / (COUNT + 1)))
    sizes = texts.select("text_id", F.explode_outer(raw).alias("run")).groupBy("text_id").agg(F.sum(F.coalesce(size, F.lit(0))).alias("bytes"))
    return sizes


def huffman_bits(frequency: DataFrame) -> DataFrame:
    """(text_id, bits): total length of the prefix codes, from symbol counts (text_id, sym, n)."""
    per = frequency.groupBy("text_id").agg(F.collect_list("n").alias("n"))

    def total(batches):
        for batch in batches:
            sums = []
            for counts in batch.column(1).to_pylist():
                known = dict(enumerate(counts))
                bits = code_lengths(known)
                sums.append(sum(known[s] * bits[s] for s in known))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64())], ["text_id", "bits"])

    return per.select("text_id", "n").mapInArrow(total, "text_id long, bits long")


def huffman_codes(frequency: DataFrame) -> DataFrame:
    """(text_id, sym, code): canonical prefix codes as strings of 0 and 1."""
    per = frequency.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("sym", "n"))).alias("x"))

    def codes(batches):
        for batch in batches:
            ids, syms, out = [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for s, code in prefix_codes(code_lengths({k: r["n"] for k, r in enumerate(x)})).items():
                    ids.append(i)
                    syms.append(x[s]["sym"])
                    out.append(code)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(syms, pa.string()), pa.array(out, pa.string())], ["text_id", "sym", "code"])

    return per.mapInArrow(codes, "text_id long, sym string, code string")


def table_bits(known: np.ndarray, bits: np.ndarray, alphabet: int) -> int:
    """Size of the description of prefix codes of these lengths, of symbols in ascending order, as huffman_table_bits says."""
    powers = 3 ** np.arange(1, 20)
    codes = np.bincount(bits)
    codes[0] = alphabet - len(known)
    longest = len(codes) - 1
    free = [1]
    for i in range(1, longest - 1):
        free.append(2 * (free[-1] - int(codes[i])) + 1)
    head = 2 * longest.bit_length() + 1 + (1 if longest == 1 else sum(f.bit_length() for f in free[: longest - 1]))
    most = int(codes.argmax())
    order = np.argsort(bits, kind="stable")
    length, symbol = bits[order], known[order]
    new = np.concatenate([[True], length[1:] != length[:-1]])
    gaps = (symbol - np.where(new, -1, np.concatenate([[-1], symbol[:-1]])))[length != most]
    if most:
        gaps = np.append(gaps, np.diff(np.setdiff1d(np.arange(alphabet), known, assume_unique=True), prepend=-1))
    return head + int((np.searchsorted(powers, gaps, side="right") + 2).sum()) * 2


def huffman_table_bits(frequency: DataFrame, alphabet: int) -> DataFrame:
    """(text_id, table_bits): size of the description of the prefix codes, from counts (text_id, sym, n) of whole numbers below `alphabet`.

    The format: the longest length m takes 2 d(m) + 1 bits, d being binary digits. Then the number of codes of each length below m takes d(free) bits,
    where free counts the codes that are still open: 1 at length 1, and 2 (free - codes) + 1 one length further; if m is 1, one bit says it all. Then the
    symbols of each length, 0 for those without a code, are listed by the distances between them from -1 on, in base 3, two bits for each digit
    and two that end a number; the list of the length that most symbols have (of several the shortest) is left out."""
    per = frequency.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("sym", "n"))).alias("x"))

    def size(rows) -> int:
        lengths = code_lengths({r["sym"]: r["n"] for r in rows})
        known = np.array(sorted(lengths), dtype=np.int64)
        return table_bits(known, np.array([lengths[x] for x in known.tolist()], dtype=np.int64), alphabet)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([size(x) for x in batch.column(1).to_pylist()], pa.int64())], ["text_id", "table_bits"])

    return per.mapInArrow(run, "text_id long, table_bits long")


def greedy_cost(previous: DataFrame, char_cost: int, count_delta: bool) -> DataFrame:
    """(text_id, cost): bits of a greedy code over (text_id, pos, len, delta): in order of position, a copy is taken if it reaches beyond what is
    coded and costs less than its new characters would; a character that is not reached costs char_cost."""
    digits = lambda x: F.when(x > 0, F.length(F.bin(x))).otherwise(0).cast("long")
    price = digits(F.col("len")) + (digits(F.col("delta")) if count_delta else 0)
    rows = previous.select("text_id", F.struct("pos", "len", price.alias("price")).alias("x")).groupBy("text_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    zero = F.struct(F.lit(0).cast("long").alias("cost"), F.lit(0).cast("long").alias("done"))

    def step(acc, x):
        reach = x["pos"] + x["len"]
        copy = (x["len"] > 0) & (reach > acc["done"]) & (x["price"] < (reach - acc["done"]) * char_cost)
        done = F.when(copy, reach).otherwise(acc["done"])
        cost = acc["cost"] + F.when(copy, x["price"]).otherwise(0)
        plain = x["pos"] >= done
        return F.struct((cost + F.when(plain, char_cost).otherwise(0)).alias("cost"), F.when(plain, x["pos"] + 1).otherwise(done).alias("done"))

    return rows.select("text_id", F.aggregate("xs", zero, step, lambda acc: acc["cost"]).alias("cost"))
