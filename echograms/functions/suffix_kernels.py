"""Small numpy helpers for one batch of texts: suffix order by prefix doubling, common prefixes, and repeat intervals.

Spark deals the texts out; these helpers see the texts of one Arrow batch as one array of code points, so their cost does not depend on how
the texts are cut into batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BATCH_POINTS = 50_000  # small enough for what is made of them to stay in a core's cache


def text_runs(batch: pa.RecordBatch, text: int, lists: int | None = None) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, row after the last, texts) for runs of rows of about BATCH_POINTS characters, those of a column of lists of texts counted too. Null counts as
    empty."""
    values = [x or "" for x in batch.column(text).to_pylist()]
    more = [sum(len(y or "") for y in x or ()) for x in batch.column(lists).to_pylist()] if lists is not None else [0] * len(values)
    start = size = 0
    for i, value in enumerate(values):
        room = len(value) + more[i]
        if size and size + room > BATCH_POINTS:
            yield start, i, values[start:i]
            start, size = i, 0
        size += room
    if start < len(values):
        yield start, len(values), values[start:]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, offsets)."""
    points = [np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in points])]).astype(np.int64)
    return (np.concatenate(points) if points else np.zeros(0, np.uint32)), offsets


@dataclass
class SortedSuffixes:
    """The order of the suffixes of texts, each in a group of its own, as taken out of a SuffixOrder."""

    offsets: np.ndarray
    text: np.ndarray
    order: np.ndarray
    position: np.ndarray
    prefixes: np.ndarray
    before: np.ndarray

    def common_prefixes(self) -> np.ndarray:
        return self.prefixes

    def lefts(self) -> np.ndarray:
        return self.before


class SuffixOrder:
    """Suffixes (or rotations) of texts, sorted within each group of texts. A suffix that is a prefix of another comes first; equal ones in order of place."""

    def __init__(self, texts: list[str], groups: list[int] | None = None, rotations: bool = False):
        self.points, self.offsets = code_points(texts)
        sizes = np.diff(self.offsets)
        self.text = np.repeat(np.arange(len(texts)), sizes)
        self.group = np.asarray(groups, dtype=np.int64)[self.text] if groups is not None else self.text
        self.ends = self.offsets[1:][self.text] if len(texts) else np.zeros(0, np.int64)
        self.begins = self.offsets[:-1][self.text] if len(texts) else np.zeros(0, np.int64)
        n = len(self.points)
        place = np.arange(n)
        self._left = self.ends - place
        longest = int(sizes.max()) if len(sizes) else 0
        self.rotations = rotations
        self._common: np.ndarray | None = None
        # Names of the strings of 1, 2, 4, ... characters at each place: equal names, equal strings. As many characters as 64 bits hold beside the group are
        # packed and sorted once; only strings that are longer are ranked by the ranks of their halves.
        known = np.zeros(int(self.points.max(initial=0)) + 1, dtype=bool)
        known[self.points] = True
        name = np.cumsum(known).astype(np.uint64)[self.points]
        bits = int(known.sum()).bit_length()
        room = 64 - int(self.group.max(initial=0)).bit_length()
        self.levels, step = [name], 1
        while n and 2 * step * bits <= room:
            name = name << np.uint64(step * bits) | self._ahead(name, step)
            step *= 2
            self.levels.append(name)
        self._packed = name, step, bits
        key = self.group.astype(np.uint64) << np.uint64(step * bits) | name if step * bits < 64 else name
        by = np.argsort(key)
        new = np.concatenate([[True], key[by[1:]] != key[by[:-1]]]) if n else np.zeros(0, dtype=bool)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, n))
        rank = np.empty(n, dtype=np.int64)
        rank[by] = np.repeat(first, size)  # how many sort before
        self.levels[-1] = rank
        live = by[np.repeat(size > 1, size)]
        while len(live) and step < longest:
            second = self._ahead(rank + 1, step, live)
            key = rank[live] * (n + 1) + second
            order = np.argsort(key)
            r, s, at = rank[live][order], second[order], np.arange(len(live))
            old = np.concatenate([[True], r[1:] != r[:-1]])
            new = old | np.concatenate([[True], s[1:] != s[:-1]])
            first = np.maximum.accumulate(np.where(new, at, 0))
            rank = rank.copy()
            rank[live[order]] = r + first - np.maximum.accumulate(np.where(old, at, 0))
            ends = np.append(np.flatnonzero(new)[1:], len(live))
            many = np.repeat(ends - np.flatnonzero(new) > 1, ends - np.flatnonzero(new))
            live = live[order][many]
            self.levels.append(rank)
            step *= 2
        self.order = np.empty(n, dtype=np.int64)
        self.order[rank] = place
        if len(live):  # equal suffixes, in order of place
            live.sort()
            live = live[np.argsort(rank[live], kind="stable")]
            r, at = rank[live], np.arange(len(live))
            self.order[r + at - np.maximum.accumulate(np.where(np.diff(r, prepend=-1) > 0, at, 0))] = live
        self.position = self.order - self.begins[self.order] if n else place

    def _ahead(self, names: np.ndarray, step: int, at: np.ndarray | None = None) -> np.ndarray:
        """names a number of places ahead, 0 beyond the text's end; rotations go round."""
        if at is None and not self.rotations:
            out = np.zeros_like(names)
            np.multiply(names[step:], self._left[:-step] > step, out=out[:-step])
            return out
        place = np.arange(len(names)) if at is None else at
        begins, ends = self.begins[place], self.ends[place]
        ahead = place + step
        if self.rotations:
            return names[begins + (ahead - begins) % np.maximum(1, ends - begins)]
        return np.where(ahead < ends, names[np.minimum(ahead, max(0, len(names) - 1))], 0) if len(names) else names

    def common_prefixes(self) -> np.ndarray:
        """For each rank the length of the common prefix with the suffix of the next rank in its group, 0 for the last."""
        if self._common is not None:
            return self._common
        n = len(self.order)
        out = self._common = np.zeros(n, dtype=np.int64)
        if n < 2:
            return out
        first = self.order[:-1]
        room = np.minimum(self.ends[first] - first, self.ends[self.order[1:]] - self.order[1:])
        whole = next(i for i, x in enumerate(self.levels) if x.dtype == np.int64)  # the first level of ranks; few pairs are equal there, and only they go on
        rank = self.levels[whole][self.order]
        long = np.flatnonzero(rank[1:] == rank[:-1])
        length = np.zeros(n - 1, dtype=np.int64)
        length[long] = self._shared(self.levels[whole:], whole, long, np.zeros(len(long), dtype=np.int64), room)
        # Fewer than `step` characters are left to compare: how many follows from the highest bit in which the packed ones differ. Without the bits below a set one,
        # no float is rounded up.
        name, step, bits = self._packed
        differ = name[np.minimum(first + length, n - 1)] ^ name[np.minimum(self.order[1:] + length, n - 1)]
        high = np.frexp((differ & ~(differ >> np.uint64(1))).astype(np.float64))[1]
        length += (step * bits - high) // bits
        length = np.minimum(length, room)
        out[:-1] = np.where(self.group[first] == self.group[self.order[1:]], length, 0)
        return out

    def _shared(self, levels: list[np.ndarray], lowest: int, ranks: np.ndarray, length: np.ndarray, room: np.ndarray) -> np.ndarray:
        """length, for each rank and the next, with what these levels find to be equal further on."""
        n = len(self.order)
        equal = [np.arange(len(ranks))]  # pairs whose strings of a level are equal, fewer from level to level; no other gains anything there
        for names in levels:
            live = equal[-1]
            equal.append(live[names[self.order[ranks[live]]] == names[self.order[ranks[live] + 1]]])
        for i in range(len(levels) - 1, -1, -1):
            live, names = equal[i + 1], levels[i]
            so_far = length[live]
            a, b = self.order[ranks[live]] + so_far, self.order[ranks[live] + 1] + so_far
            same = (so_far < room[ranks[live]]) & (names[np.minimum(a, n - 1)] == names[np.minimum(b, n - 1)])
            length[live] = so_far + same * (1 << (i + lowest))
        return length

    def of_texts(self, chosen: np.ndarray) -> SortedSuffixes:
        """The order of the suffixes of some texts (a flag for each), of which a group holds one, as if the others were not there: the common prefix of two that come
        to be neighbours is the least on the way from one to the other."""
        ranks = np.flatnonzero(chosen[self.text[self.order]])
        prefixes = self.common_prefixes()
        least = np.minimum.reduceat(prefixes, ranks) if len(ranks) else ranks
        if len(ranks):
            least[-1] = 0
            least[:-1][self.text[self.order[ranks[1:]]] != self.text[self.order[ranks[:-1]]]] = 0
        number = np.cumsum(chosen) - 1
        sizes = np.diff(self.offsets)[chosen]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        text = number[self.text[self.order[ranks]]]
        return SortedSuffixes(offsets, np.repeat(np.arange(len(sizes)), sizes), offsets[text] + self.position[ranks], self.position[ranks], least, self.lefts()[ranks])

    def lefts(self) -> np.ndarray:
        """Code point before each suffix, in order of rank; 0xFFFFFFFF at the start of a text."""
        before = np.full(len(self.points), 0xFFFFFFFF, dtype=np.uint32)
        before[1:] = self.points[:-1]
        before[self.offsets[:-1][np.diff(self.offsets) > 0]] = 0xFFFFFFFF
        return before[self.order]

    def transforms(self) -> list[tuple[str, int]]:
        """For each text, of sorted rotations: their last characters in order, and the rank of the text itself."""
        last = self.points[np.where(self.order == self.begins[self.order], self.ends[self.order], self.order) - 1] if len(self.order) else self.points
        first = np.flatnonzero(self.position == 0)
        rank = dict(zip(self.text[self.order[first]].tolist(), first.tolist(), strict=True))
        bounds = zip(self.offsets.tolist(), self.offsets[1:].tolist(), strict=False)
        return [(last[a:b].tobytes().decode("utf-32-le"), rank.get(i, 0) - a) for i, (a, b) in enumerate(bounds)]

    def longest_starts(self) -> np.ndarray:
        """For each place the longest string that starts there and at another place of its group."""
        prefixes = self.common_prefixes()
        out = np.zeros(len(prefixes), dtype=np.int64)
        out[self.order] = np.maximum(prefixes, np.concatenate([[0], prefixes[:-1]])) if len(prefixes) else prefixes
        return out

    def longest_earlier(self) -> np.ndarray:
        """For each place the longest string that starts there and at an earlier place of its group. Places leave the order from the last to the first, so
        the neighbours of a place that is still there are all earlier ones; a neighbour's common prefix is the least on the way to it."""
        n = len(self.order)
        rank = np.empty(n, dtype=np.int64)
        rank[self.order] = np.arange(n)
        shared = [0, *self.common_prefixes().tolist()]  # with the next rank before
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        out = [0] * n
        for place, r in zip(range(n - 1, -1, -1), rank[::-1].tolist(), strict=True):
            a, b, up, down = before[r], after[r], shared[r], shared[after[r]]
            out[place] = max(up, down)
            shared[b] = min(up, down)
            if a >= 0:
                after[a] = b
            if b < n:
                before[b] = a
        return np.array(out, dtype=np.int64)

    def matches(self, others: np.ndarray) -> np.ndarray:
        """For each place the longest string that starts there and somewhere in the texts of its group that `others` marks (a flag for each text).

        The longest match is with the nearest suffix of such a text above or below, and is the least common prefix on the way there; where none is left
        in the group, the way crosses the group's edge, whose common prefix is 0."""
        prefixes, marked = self.common_prefixes(), others[self.text[self.order]]
        n = len(prefixes)
        out = np.zeros(n, dtype=np.int64)
        if n:
            seen, coming = np.cumsum(marked), np.cumsum(marked[::-1])
            above = np.where(seen > 0, _least_since(np.concatenate([[0], prefixes[:-1]]), seen), 0)
            below = np.where(coming > 0, _least_since(prefixes[::-1], coming), 0)[::-1]
            out[self.order] = np.maximum(above, below)
        return out


class PairMatches:
    """Matching statistics of pairs of texts that are all sorted together once. Of two texts, the nearest suffixes of the other above and below a suffix are found by
    their ranks; what is shared with them is the least common prefix on the way, from two overlapping stretches of a power of two."""

    def __init__(self, texts: list[str]):
        order = SuffixOrder(texts, [0] * len(texts))
        self.sizes, self.offsets = np.diff(order.offsets), order.offsets
        n, text = len(order.order), order.text[order.order]
        self.ranks = np.argsort(text.astype(np.uint16) if len(texts) < 1 << 16 else text, kind="stable")  # of each text, in order
        self.keys = order.text * n + self.ranks
        self.least = order.common_prefixes().astype(np.int32)[None]  # a row for each power of two

    def _shared(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The least common prefix of ranks first to stop - 1; there is one at least."""
        level = np.frexp((stop - first).astype(np.float64))[1] - 1
        if (more := int(level.max(initial=0)) + 1 - len(self.least)) > 0:
            known, n = len(self.least), len(self.keys)
            self.least = np.concatenate([self.least, np.zeros((more, n), np.int32)])
            for k in range(known, known + more):
                step = 1 << k - 1
                np.minimum(self.least[k - 1, : n - step], self.least[k - 1, step:], out=self.least[k, : n - step])
        row = level.astype(np.int64) * len(self.keys)
        flat = self.least.ravel()
        return np.minimum(flat[row + first], flat[row + stop - (np.int64(1) << level)])

    def of(self, pairs: list[tuple[int, int]], most: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(base, other, lengths) for each pair of texts: for each suffix of the base, in order, how long a prefix of it occurs in the other. About `most` places
        are looked up at a time."""
        start = size = 0
        for i in range(len(pairs) + 1):
            if i > start and (i == len(pairs) or size + self.sizes[pairs[i][0]] > most):
                yield from self._of(pairs[start:i])
                start, size = i, 0
            size += int(self.sizes[pairs[i][0]]) if i < len(pairs) else 0

    def _of(self, pairs: list[tuple[int, int]]) -> Iterator[tuple[int, int, np.ndarray]]:
        base, other = np.array(pairs, dtype=np.int64).T
        sizes, n = self.sizes[base], len(self.keys)
        ends = np.cumsum(sizes)
        ranks = self.ranks[np.arange(int(ends[-1])) + np.repeat(self.offsets[base] - ends + sizes, sizes)]
        at = np.searchsorted(self.keys, np.repeat(other * n, sizes) + ranks)
        up, down = np.flatnonzero(at > np.repeat(self.offsets[other], sizes)), np.flatnonzero(at < np.repeat(self.offsets[other + 1], sizes))
        shared = self._shared(np.concatenate([self.ranks[at[up] - 1], ranks[down]]), np.concatenate([ranks[up], self.ranks[at[down]]]))
        out = np.zeros(len(ranks), dtype=np.int32)
        out[up] = shared[: len(up)]
        out[down] = np.maximum(out[down], shared[len(up) :])
        for (i, j), a, b in zip(pairs, (ends - sizes).tolist(), ends.tolist(), strict=True):
            yield i, j, out[a:b]


def _least_since(values: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Running minimum of values that starts anew after each place where `run`, a count that only grows, has grown: that place's own value is not part of it."""
    grown = np.diff(run, prepend=0) > 0
    wide = int(values.max(initial=0)) + 1
    return np.minimum.accumulate(np.where(grown, wide, values) - run * (wide + 1)) + run * (wide + 1)


def spread(lengths: np.ndarray) -> np.ndarray:
    """For each place p the largest lengths[q] of any q with q <= p < q + lengths[q]; 0 where none reaches. Ends q + lengths[q] must not go back, as is so for
    longest matches; then the q that reach p are a run that ends at p, and its maximum comes from two overlapping runs of a power of two."""
    n = len(lengths)
    at = np.arange(n)
    first = np.searchsorted(at + lengths, at, side="right")
    width = at - first + 1
    out, best, step = np.zeros(n, dtype=np.int64), lengths.astype(np.int64), 1
    while step <= width.max(initial=0):  # best[i] is the maximum of lengths[i : i + step]
        now = np.flatnonzero((width >= step) & (width < 2 * step))
        out[now] = np.maximum(best[first[now]], best[at[now] - step + 1])
        best = np.maximum(best[:-step], best[step:])
        step *= 2
    return out


JUMPS, LEAST_STEPS = 16, 1000  # steps for each place, and what a round takes at least


def lower_before(values: np.ndarray, or_equal: bool = False) -> np.ndarray:
    """For each place the nearest earlier one with a smaller value (or an equal one too); -1 where there is none. Values are at least 0.

    What stands between a place and the place that it points at is never smaller, so a place that is blocked by the one it points at goes on to where that one
    points: all at once, and twice as far each time. The few that are left where values rise for long are answered one by one."""
    n = len(values)
    kind = np.int32 if n < 2**31 - 1 and (not n or values.max() < 2**31) else np.int64
    v = np.concatenate([[-1], values]).astype(kind)
    to = np.arange(-1, n, dtype=kind)
    to[0] = 0
    live = np.arange(1, n + 1, dtype=kind)
    steps = 0
    while steps <= JUMPS * n:
        at = to[live]
        before = v[at]
        blocked = np.flatnonzero(before > v[live] if or_equal else before >= v[live])
        live, at = live[blocked], at[blocked]
        if not len(live):
            return to[1:].astype(np.int64) - 1
        to[live] = to[at]
        steps += len(live) + LEAST_STEPS
    given, opened, out = v.tolist(), [0], [0] * (n + 1)
    for i in range(1, n + 1):
        while (given[opened[-1]] > given[i]) if or_equal else (given[opened[-1]] >= given[i]):
            opened.pop()
        out[i] = opened[-1]
        opened.append(i)
    return np.array(out[1:], dtype=np.int64) - 1


def lower_after(values: np.ndarray) -> np.ndarray:
    """For each place the nearest later one with a smaller value; the number of values where there is none."""
    return len(values) - 1 - lower_before(values[::-1])[::-1]


def widths(prefixes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each rank of groups of these sizes, how many suffixes in a row share as much as that rank does with the next; the last rank of a group shares nothing."""
    return np.where(prefixes > 0, lower_after(prefixes) - lower_before(prefixes), np.repeat(sizes, sizes))


def peaks(prefixes: np.ndarray, lefts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, first rank, rank after the last) of every supermaximal repeat: runs of equal common prefixes above both neighbours, whose suffixes are
    all preceded by different characters."""
    n = len(prefixes)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none
    first = np.flatnonzero(np.concatenate([[True], prefixes[1:] != prefixes[:-1]]))
    stop = np.append(first[1:], n)
    high = prefixes[first]
    before, after = np.where(first > 0, prefixes[first - 1], 0), np.where(stop < n, prefixes[np.minimum(stop, n - 1)], 0)
    keep = (high >= max(1, least)) & (high > before) & (high > after)
    first, stop, high = first[keep], stop[keep] + 1, high[keep]
    size = stop - first
    run = np.repeat(np.arange(len(first)), size)
    member = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
    order = np.lexsort((lefts[member], run))
    r, x = run[order], lefts[member][order]
    same = np.flatnonzero((r[1:] == r[:-1]) & (x[1:] == x[:-1]))
    varied = np.ones(len(first), dtype=bool)
    varied[r[same]] = False
    return high[varied], first[varied], stop[varied]


def repeat_intervals(prefixes: np.ndarray, lefts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, first rank, occurrences) of every maximal repeat of some groups one after the other: maximal runs of ranks whose neighbours share at least `length`
    characters, exactly `length` somewhere, and which are preceded by at least two different characters (a text's start differs from all). In order of
    the last rank, shorter runs of ranks first; the last rank of a group shares nothing, so no run goes beyond it."""
    if not len(prefixes):
        return (np.zeros(0, np.int64),) * 3
    before, stop = lower_before(prefixes), lower_after(prefixes)
    varied = np.concatenate([[0], np.cumsum((lefts[1:] != lefts[:-1]) | (lefts[1:] == 0xFFFFFFFF))])
    found = np.flatnonzero((prefixes >= max(1, least)) & (lower_before(prefixes, or_equal=True) == before))  # of equal values in a run, the first
    first, last = before[found] + 1, stop[found]
    mixed = varied[last] > varied[first]
    found, first, last = found[mixed], first[mixed], last[mixed]
    order = np.lexsort((-prefixes[found], last))
    return prefixes[found][order], first[order], (last - first + 1)[order]


CLIMBS, NARROW, WIDE = 24, 16, 12


class RepeatTree:
    """The maximal repeats of groups of texts as a tree of rank intervals: each rank that shares something with the next stands for the run of ranks around it that
    share as much. The run that holds another and shares less is that of the higher of the two ranks at the other's edges. A repeat that starts with a
    repeated string is one of its ancestors, so those of a place are a path to the root; all ancestors of a maximal repeat are maximal repeats."""

    def __init__(self, order: SuffixOrder, least: int = 1):
        self.places, n = order.order.astype(np.int32), len(order.order)
        prefixes, lefts = order.common_prefixes().astype(np.int32), order.lefts()
        before, after = lower_before(prefixes).astype(np.int32), lower_after(prefixes).astype(np.int32)
        self.length, self.first, self.stop = prefixes, before + 1, after + 1
        varied = np.cumsum(np.concatenate([[False], (lefts[1:] != lefts[:-1]) | (lefts[1:] == 0xFFFFFFFF)])[:n], dtype=np.int32)
        inside = np.minimum(after, max(0, n - 1))
        self.known = (prefixes >= max(1, least)) & (varied[inside] > varied[self.first]) if n else np.zeros(0, bool)  # which are maximal repeats
        edge = np.where(before < 0, 0, prefixes[before]) if n else prefixes
        other = np.where(after < n, prefixes[inside], 0) if n else prefixes
        self.parent = np.where(edge >= other, before, after)
        self.parent[np.maximum(edge, other) < max(1, least)] = -1

    def previous(self) -> tuple[np.ndarray, np.ndarray]:
        """(length, distance) for each place: the longest repeat that starts there and at an earlier place too, and how far back its nearest earlier place is; 0, 0
        where there is none.

        All places of a repeat but the least have an earlier one. So a place's repeat is the first on its path to the root that is maximal and has a smaller least
        place."""
        n = len(self.places)
        length, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if not n:
            return length, distance
        least, places, parent = self._least(), self.places, self.parent
        prefixes = self.length
        home = np.arange(n, dtype=np.int32)  # the innermost run of each rank: its own or that of the rank before
        home[1:] -= prefixes[:-1] > prefixes[1:]
        home[(prefixes == 0) & (prefixes[home] == 0)] = -1
        live = np.flatnonzero(home >= 0)
        at = home[live]
        for _ in range(CLIMBS):
            climb = ~self.known[at] | (least[at] >= places[live])
            live = live[climb]
            if not len(live):
                break
            home[live] = at = parent[at[climb]]
            live, at = live[at >= 0], at[at >= 0]
        if len(live):  # a long way: by 2^k steps at once, as long as what they lead to is not yet an answer
            powers = [np.append(parent, -1)]
            while powers[-1].max() >= 0:
                powers.append(powers[-1][powers[-1]])
            for power in reversed(powers):
                to = power[at]
                low = (to >= 0) & (~self.known[to] | (least[to] >= places[live]))
                at = np.where(low, to, at)
            wanting = ~self.known[at] | (least[at] >= places[live])
            home[live] = np.where(wanting, parent[at], at)
        ranks = np.flatnonzero(home >= 0)
        answer, at = home[ranks], places[ranks]
        length[at] = prefixes[answer]
        distance[at] = at - self._nearest(answer, ranks, at)
        return length, distance

    def _least(self) -> np.ndarray:
        """The least place of each rank's run, from two overlapping stretches of a power of two."""
        width = self.stop - self.first
        out, best, step = np.zeros(len(width), np.int32), self.places, 1
        level = np.frexp(width.astype(np.float64))[1].astype(np.uint8)
        out[self.length == 0] = -1
        level[self.length == 0] = 0
        for k in range(1, int(level.max(initial=0)) + 1):
            now = np.flatnonzero(level == k)
            out[now] = np.minimum(best[self.first[now]], best[self.stop[now] - step])
            best = np.minimum(best[:-step], best[step:])
            step *= 2
        return out

    def _nearest(self, runs: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The largest place before `at`, the place of a rank, in a run that holds the rank and an earlier place."""
        first, width = self.first[runs], self.stop[runs] - self.first[runs]
        out = np.full(len(runs), -1, np.int32)
        by = np.argsort(np.minimum(width, NARROW + 1).astype(np.uint8), kind="stable")[::-1]
        wide = int(np.count_nonzero(width > NARROW))
        narrow, by_width = by[wide:], by[:wide]
        size, start, limit = width[narrow], first[narrow], at[narrow]
        best, left = np.full(len(narrow), -1, np.int32), len(narrow)
        counts = np.bincount(size, minlength=NARROW + 1)
        for k in range(NARROW):
            left -= int(counts[k])
            if not left:
                break
            met = self.places[start[:left] + k]
            met[met >= limit[:left]] = -1
            np.maximum(best[:left], met, out=best[:left])
        out[narrow] = best
        if wide:
            out[by_width] = self._far(runs[by_width], ranks[by_width], at[by_width])
        return out

    def _far(self, runs: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """_nearest in wide runs: back along the places that share the first 1, 2 or 4 characters, of which those of the run are many; what is far is sorted."""
        first, width = self.first[runs], (self.stop[runs] - self.first[runs]).astype(np.uint32)
        out, length, left = np.empty(len(runs), np.int32), self.length[runs], []
        rank = np.empty(len(self.places), np.int32)
        rank[self.places] = np.arange(len(rank), dtype=np.int32)
        for size, more in ((1, 2), (2, 4), (4, None)):
            live = np.flatnonzero((length >= size) & (length < more)) if more else np.flatnonzero(length >= size)
            if not len(live):
                continue
            back = self._back(size, rank)
            to = at[live]
            for _ in range(CLIMBS):
                to = back[to]
                met = (rank[to] - first[live]).astype(np.uint32) < width[live]
                out[live[met]] = to[met]
                live, to = live[~met], to[~met]
                if not len(live):
                    break
            left.append(live)
        rest = np.concatenate(left)
        if not len(rest):
            return out
        asked, named = np.unique(runs[rest], return_inverse=True)
        begin, sizes = self.first[asked], (self.stop - self.first)[asked].astype(np.int64)
        if sizes.sum() <= WIDE * len(self.places):  # each run's places in order: the one before is the answer
            offset = np.cumsum(sizes) - sizes
            place = self.places[np.arange(int(sizes.sum())) + np.repeat(begin - offset, sizes)]
            order = np.argsort(np.repeat(np.arange(len(asked)), sizes) * len(self.places) + place)
            earlier = np.empty(len(place), np.int32)
            earlier[order[1:]] = place[order[:-1]]
            out[rest] = earlier[offset[named] + ranks[rest] - begin[named]]
        else:
            out[rest] = RangeOrder(self.places).before(first[rest], self.stop[runs[rest]], at[rest])
        return out

    def _back(self, size: int, rank: np.ndarray) -> np.ndarray:
        """For each place the nearest earlier one that starts with the same `size` characters."""
        name = np.cumsum(np.concatenate([[False], self.length[:-1] < size]))[rank]
        order = np.argsort(name.astype(np.uint16) if len(name) < 1 << 16 else name, kind="stable")  # by radix where 16 bits do
        back = np.empty(len(name), np.int32)
        back[order[1:]] = order[:-1]
        return back


class RangeOrder:
    """Questions on the order of values in ranges of a permutation, all at once: the permutation is sorted by its bits from the highest to the lowest, each
    level keeping its order within equal higher bits, with counts of zero bits before each place."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length()) if len(values) else 1
        self.zeros: list[np.ndarray] = []
        for b in range(self.bits - 1, -1, -1):
            zero = (values >> b) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]).astype(np.int64))
            values = np.concatenate([values[zero], values[~zero]])

    def before(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The largest entry below value in places low to high - 1; there must be one."""
        a, b, below = low, high, np.zeros(len(value), dtype=np.int64)
        for zero, bit in zip(self.zeros, range(self.bits - 1, -1, -1), strict=True):
            za, zb, one = zero[a], zero[b], (value >> bit) & 1 == 1
            below += np.where(one, zb - za, 0)
            a, b = np.where(one, zero[-1] + a - za, za), np.where(one, zero[-1] + b - zb, zb)
        a, b, nth, out = low, high, below - 1, np.zeros(len(value), dtype=np.int64)
        for zero, bit in zip(self.zeros, range(self.bits - 1, -1, -1), strict=True):
            za, zb = zero[a], zero[b]
            one = nth >= zb - za
            out |= one.astype(np.int64) << bit
            nth = np.where(one, nth - (zb - za), nth)
            a, b = np.where(one, zero[-1] + a - za, za), np.where(one, zero[-1] + b - zb, zb)
        return out


def greedy_bits(length: list[int], distance: list[int], char_bits: int, count_distance: bool) -> int:
    """greedy_costs of one text."""
    return greedy_costs(np.asarray(length, dtype=np.int64), np.asarray(distance, dtype=np.int64), np.array([0, len(length)]), char_bits, count_distance)[0]


def greedy_costs(length: np.ndarray, distance: np.ndarray, offsets: np.ndarray, char_bits: int, count_distance: bool) -> list[int]:
    """Bits of a greedy code of each text: in order of place, a copy is taken if it reaches beyond what is coded and costs less than its new characters would;
    a character that is not reached costs char_bits.

    Copies that cost as much as all their characters are never taken; nor is the rest of a copy that was passed over, or taken, one place before, unless it is
    cheaper than that. Only the others are gone through."""
    digits = lambda x: np.frexp(x.astype(np.float64))[1]
    price = digits(length) + (digits(distance) if count_distance else 0)
    end = np.arange(len(length)) + length
    wanted = price < length * char_bits
    rest = (end[1:] == end[:-1]) & (price[1:] >= price[:-1])
    begins = offsets[1:-1]
    rest[begins[(begins > 0) & (begins < len(length))] - 1] = False
    wanted[1:] &= ~rest
    at = np.flatnonzero(wanted)
    ends, prices, split = end[at].tolist(), price[at].tolist(), np.searchsorted(at, offsets).tolist()
    at, costs = at.tolist(), []
    for done, stop, i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), split, split[1:], strict=False):
        cost = 0
        for place, reach, bits in zip(at[i:j], ends[i:j], prices[i:j], strict=True):
            if done < place:
                cost += (place - done) * char_bits
                done = place
            if bits < (reach - done) * char_bits:
                cost += bits
                done = reach
        costs.append(cost + max(0, stop - done) * char_bits)
    return costs


def as_text(points: np.ndarray) -> list[str]:
    """One-character strings; the start of a text is the empty string."""
    distinct, at = np.unique(points, return_inverse=True)
    names = np.array(["" if p == 0xFFFFFFFF else chr(p) for p in distinct.tolist()], dtype=object)
    return names[at].tolist() if len(points) else []
