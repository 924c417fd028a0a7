"""Texts of lower complexity: places next to repeats are overwritten so that the repeats grow. One map pass; each text is rewritten where it is.

Both rewrites work from the suffix order of the text as it stands at the start of a round; the repeat at a place is what its suffix shares with the one that sorts
next. Unless every round is asked for, one is kept only if it lowers the complexity 1 + sum of 1 / (lcp + 1), so complexity never rises and every rewrite ends."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from echograms.functions.suffix_kernels import SuffixOrder, text_runs, widths

SCORES = ("area", "length", "height")
CLASSES = ("long", "below", "half", "ten")
LETTERS = ("any", "opposite", "common", "random")
CLAIMS = ("log", "repeat", "one")
OPPOSITE = {"A": "T", "T": "A", "C": "G", "G": "C"}


def least_power(n: int) -> int:
    """The least k with 4^k >= n."""
    return (max(n, 1) - 1).bit_length() + 1 >> 1


def measured(prefixes: np.ndarray) -> float:
    counts = np.bincount(prefixes[:-1]) if len(prefixes) else np.zeros(0)
    return (1.0 if len(prefixes) else 0.0) + math.fsum((counts / np.arange(1, len(counts) + 1)).tolist())


def extended_right(letters: list[str], places: Sequence[int], prefixes: Sequence[int]) -> None:
    """From left to right: the repeat of length a at i is followed, at j = i + a, by one of length b. While a + 1 < b, the letter behind the first repeat becomes
    the one behind its copy, so a grows at the cost of b. It goes on at j; from places without a repeat, one further."""
    n = len(letters)
    if not n:
        return
    order, shared = np.asarray(places), np.zeros(n, np.int64)
    shared[order[:-1]] = np.asarray(prefixes)[: n - 1]
    following = np.zeros(n, np.int64)
    following[order[:-1]] = order[1:]
    repeat, copies, i = shared.tolist(), following.tolist(), 0  # by place
    while i < n:
        a = repeat[i]
        if not a:
            i += 1
            continue
        copy, j = copies[i], i + a
        if j >= n:
            return
        b = repeat[j]
        while a + 1 < b and i + a < n and copy + a < n:
            letters[i + a] = letters[copy + a]
            a, b = a + 1, b - 1
        i = j


def extended_left(score: str, kind: str, letter: str, claim: str, seed: int) -> Callable[[list[str], Sequence[int], Sequence[int]], None]:
    """Neighbour pairs of the class `kind` of common prefixes ("long", "below", "half", "ten", as complexity.in_lcp_class says), in falling order of score (ties: by
    rank): length, height (how many suffixes in a row share that much), or area, their product. A pair of suffixes of which none is claimed takes all unclaimed
    suffixes beside it that share as much, and the letters before them all become one: any (the first of them in suffix order), the one opposite to the
    repeat's first letter, the most common (ties: the least), or a random one of A, C, G, T (a hash of seed and place). The letters before and the first ones
    of each suffix are claimed: k of them for "log", 4^k being the length of the text, the repeat's for "repeat", or one."""

    def run(letters: list[str], places: Sequence[int], prefixes: Sequence[int]) -> None:
        n, k = len(letters), least_power(len(letters))
        places, prefixes = np.asarray(places).tolist(), np.asarray(prefixes).tolist()
        lcp = np.array(prefixes[: n - 1], dtype=np.int64)
        wanted = np.flatnonzero({"long": lcp >= k, "below": lcp == k - 1, "half": lcp == k // 2, "ten": lcp == 10}[kind] & (lcp > 0))
        if not len(wanted):
            return
        height = np.ones(n - 1, np.int64) if score == "length" else widths(np.append(lcp, 0), np.array([n]))[: n - 1]
        points = (lcp if score != "height" else 1) * height
        claimed = bytearray(n)
        for i in wanted[np.argsort(-points[wanted], kind="stable")].tolist():
            if claimed[places[i]] or claimed[places[i + 1]]:
                continue
            least, lo, hi = prefixes[i], i, i + 2
            while lo and prefixes[lo - 1] >= least and not claimed[places[lo - 1]]:
                lo -= 1
            while hi < n and prefixes[hi - 1] >= least and not claimed[places[hi]]:
                hi += 1
            before = [p - 1 for p in places[lo:hi] if p]
            new = letters[before[0]]
            if letter == "opposite":
                new = OPPOSITE.get(letters[places[lo]], new)
            elif letter == "common":
                met: dict[str, int] = {}
                for p in before:
                    met[letters[p]] = met.get(letters[p], 0) + 1
                new = min(met, key=lambda c: (-met[c], c))
            elif letter == "random":
                new = "ACGT"[crc32(f"{seed}:{places[lo]}".encode()) % 4]
            for p in before:
                letters[p] = new
                claimed[p] = 1
            size, done = {"log": k, "repeat": least, "one": 1}[claim], 0
            for p in sorted(places[lo:hi]):
                done, end = max(done, p), min(n, p + size)
                if done < end:
                    claimed[done:end] = b"\1" * (end - done)
                    done = end

    return run


def _rewritten(texts: list[str], rewrite: Callable, rounds: int | None, falling: bool = True) -> list[tuple[str, int, float, float]]:
    """(text, rounds kept, complexity before and after) of each text; the texts that a round changes are sorted together."""

    def ordered(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, float]]:
        order = SuffixOrder(texts)
        prefixes = order.common_prefixes()
        cuts = zip(order.offsets.tolist(), order.offsets[1:].tolist(), strict=False)
        return [(order.position[a:b], prefixes[a:b], measured(prefixes[a:b])) for a, b in cuts]

    orders = dict(enumerate(ordered(texts)))
    found = [(text, 0, orders[i][2], orders[i][2]) for i, text in enumerate(texts)]
    done = 0
    while orders and (rounds is None or done < rounds):
        changed, done = {}, done + 1
        for i, (places, prefixes, _) in orders.items():
            letters = list(found[i][0])
            rewrite(letters, places, prefixes)
            if (new := "".join(letters)) != found[i][0]:
                changed[i] = new
        orders = dict(zip(changed, ordered(list(changed.values())), strict=True))
        orders = {i: o for i, o in orders.items() if not falling or o[2] < found[i][3]}
        for i, (_, _, lower) in orders.items():
            found[i] = changed[i], done, found[i][2], lower
    return found


def _rewrite(texts: DataFrame, rewrite: Callable, rounds: int | None, falling: bool) -> DataFrame:
    if rounds is None and not falling:
        raise ValueError("rounds that need not lower complexity must have a number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, given in text_runs(batch, 1):  # rows leave before the next run is begun
                found = _rewritten(given, rewrite, rounds, falling)
                known = batch.column(1).slice(a, b - a).is_valid().to_pylist()
                changed = [0 if old == f[0] else sum(x != y for x, y in zip(old, f[0], strict=True)) for old, f in zip(given, found, strict=True)]
                rows = [(f[0], n, *f[1:]) if k else (None, 0, 0, None, None) for k, n, f in zip(known, changed, found, strict=True)]
                values = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *values], ["text_id", "body", "changed", "rounds", "k_before", "k_after"])

    return texts.select("text_id", "body").mapInArrow(run, "text_id long, body string, changed long, rounds long, k_before double, k_after double")


def lowered_right(texts: DataFrame, rounds: int | None = 1, falling: bool = True) -> DataFrame:
    """(text_id, body, changed, rounds, k_before, k_after): texts whose repeats are extended to the right (extended_right), how many characters differ, how many
    rounds were kept, and the complexity before and after. rounds: at most so many; None: until one does not lower it. falling=False keeps every one
    of a given number. Null stays null."""
    return _rewrite(texts, extended_right, rounds, falling)


def lowered_left(texts: DataFrame, score: str = "area", kind: str = "long", letter: str = "any", claim: str = "log", rounds: int | None = 1, seed: int = 0, falling: bool = True) -> DataFrame:
    """The same for repeats extended to the left, best scores first (extended_left)."""
    for value, known in ((score, SCORES), (kind, CLASSES), (letter, LETTERS), (claim, CLAIMS)):
        if value not in known:
            raise ValueError(f"{value}: one of {', '.join(known)}")
    return _rewrite(texts, extended_left(score, kind, letter, claim, seed), rounds, falling)
