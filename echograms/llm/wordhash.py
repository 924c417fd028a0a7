"""Words of a batch of texts as 64-bit hashes, found and hashed with numpy over the UTF-8 bytes of an Arrow column.

Words of one length up to 8 bytes never share a hash; longer ones go through a chain of mixed 8-byte pieces, above 64 bytes through a keyed digest. A
hash only proposes: operators that must be exact compare the words themselves where hashes agree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of the words [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, *range(9, 14)]] = False
LETTER_OR_DIGIT = np.zeros(256, dtype=bool)
LETTER_OR_DIGIT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: The low n bytes of a piece, and the longest word that is hashed piece by piece.
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U)
PIECEWISE = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def slices(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them) for runs of rows of about `limit` bytes; a longer text is a run of its own. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(texts.buffers()[1], dtype=wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + limit, side="right")) - 1)
        yield a, b, data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        a = b


class Words:
    """The words of some texts: lower-cased bytes (with 8 spare ones at the end; unchanged ones if not fold), starts and ends of words in them, and for each
    text the index of its first word (one more entry than texts)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: bool = True):
        n = len(data)
        self.lower = np.zeros(n + 8, dtype=np.uint8)
        self.lower[:n] = LOWER[data] if fold else data
        self.pieces = np.ndarray((n + 1,), dtype="<u8", buffer=self.lower, strides=(1,))
        inside = np.zeros(n + 1, dtype=bool)
        inside[:n] = is_word[data]
        border = np.zeros(n + 1, dtype=bool)
        border[offsets] = True  # a word ends where its text does
        before = np.zeros(n + 1, dtype=bool)
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | border))
        self.ends = np.flatnonzero(before & (~inside | border))
        self.first = np.searchsorted(self.starts, offsets)

    def bytes(self, word: int) -> bytes:
        return self.lower[self.starts[word] : self.ends[word]].tobytes()

    def hashes(self) -> np.ndarray:
        size = self.ends - self.starts
        out = mix(size.astype(U) * BASE)
        out = mix(out ^ (self.pieces[self.starts] & LOW_BYTES[np.minimum(size, 8)]))
        live = np.flatnonzero((size > 8) & (size <= PIECEWISE))
        for done in range(8, PIECEWISE, 8):
            live = live[size[live] > done]
            if not len(live):
                break
            out[live] = mix(out[live] ^ (self.pieces[self.starts[live] + done] & LOW_BYTES[np.minimum(size[live] - done, 8)]))
        for i in np.flatnonzero(size > PIECEWISE):
            out[i] = int.from_bytes(hashlib.blake2b(self.bytes(i), digest_size=8, key=b"word").digest(), "little")
        return out

    def prefix_hashes(self, size: int) -> np.ndarray:
        """Hashes of the first `size` bytes (at most 8) of each word, 0 for shorter words."""
        h = mix(mix(self.pieces[self.starts] & LOW_BYTES[size]) + U(size))
        return np.where(self.starts + size <= self.ends, h, U(0))


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the index of its first word (one more entry than texts)."""
    words = Words(data, offsets, is_word)
    return words.hashes(), words.first


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words, one entry for each start."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.full(n, U(k))
    for i in range(k):
        out = out * U(0xD6E8FEB86659FD93) + words[i : i + n]
    return mix(out)


def text_shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of the distinct k-word shingles of each text, sorted; a text of fewer words, but not none, has its whole sequence as one."""
    counts = np.diff(first)
    runs = window_hashes(words, k)
    per = np.maximum(counts - k + 1, 0)
    owner = np.repeat(np.arange(len(counts)), per)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per) + np.repeat(first[:-1], per)
    owners, hashes = [owner], [runs[at] if len(at) else np.zeros(0, U)]
    for short in range(1, k):
        which = np.flatnonzero(counts == short)
        if len(which):
            owners.append(which)
            hashes.append(window_hashes(words, short)[first[:-1][which]])
    owner, value = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    keep = np.ones(len(owner), dtype=bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[keep], value[keep]
