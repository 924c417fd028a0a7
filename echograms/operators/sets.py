"""Questions about sets of texts: matching statistics, and what is exclusive to a text, common to a set, or marks a set off from others.

A relation (base_id, other_id) says which texts are compared; ids name rows of one text table. The answer for a set is a fold of the answers for
its members, so members can be added later: min over a set that must all hold a string, max over texts that must not."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echograms.functions.suffix_kernels import PairMatches, SuffixOrder, as_text, peaks, text_runs


def _pair_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, other = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        seconds = batch.column(3).to_pylist()
        for a, _, texts in text_runs(batch, 2):
            both = [t for i, x in enumerate(texts) for t in (x, seconds[a + i] or "")]
            order = SuffixOrder(both, [i // 2 for i in range(len(both))])
            text = order.text[order.order]
            bounds = order.offsets[::2]
            rank = np.arange(len(text)) - bounds[text // 2] if len(text) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(base[a:][text // 2], pa.int64()), pa.array(other[a:][text // 2], pa.int64()), pa.array(rank), pa.array(text % 2 == 1), pa.array(order.position), pa.array(order.common_prefixes()), pa.array(as_text(order.lefts()), pa.string())], ["base_id", "other_id", "rank", "is_other", "pos", "lcp", "left"])


def pair_suffixes(texts: DataFrame, relation: DataFrame) -> DataFrame:
    """(base_id, other_id, rank, is_other, pos, lcp, left): the suffixes of both texts of each pair in one order; of equal ones the base's come first."""
    return _joined(texts, relation).mapInArrow(_pair_suffixes, "base_id long, other_id long, rank long, is_other boolean, pos long, lcp long, left string")


def _joined(texts: DataFrame, relation: DataFrame) -> DataFrame:
    """(base_id, other_id, base, other) for each pair of a relation."""
    t = texts.select("text_id", "body")
    return relation.join(t.select(F.col("text_id").alias("base_id"), F.col("body").alias("base")), "base_id").join(t.select(F.col("text_id").alias("other_id"), F.col("body").alias("other")), "other_id").select("base_id", "other_id", "base", "other")


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seconds = batch.column(3).to_pylist()
        for a, _, texts in text_runs(batch, 2):
            both = [t for i, x in enumerate(texts) for t in (x, seconds[a + i] or "")]
            order = SuffixOrder(both, [i // 2 for i in range(len(both))])
            base = np.flatnonzero(order.text % 2 == 0)
            pair = pa.array(order.text[base] // 2)
            length = order.matches(np.arange(len(both)) % 2 == 1)[base]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a).take(pair), batch.column(1).slice(a).take(pair), pa.array(base - order.begins[base]), pa.array(length)], ["base_id", "other_id", "pos", "len"])


def matching_statistics(texts: DataFrame, relation: DataFrame) -> DataFrame:
    """(base_id, other_id, pos, len) for each position of each base text: how long a prefix of what starts there occurs in the other text.

    The suffixes of both texts are sorted together where the pair is; nothing but the texts is shuffled."""
    return pair_statistics(_joined(texts, relation))


def pair_statistics(pairs: DataFrame) -> DataFrame:
    """matching_statistics of pairs (base_id, other_id, base, other) that hold their texts."""
    return pairs.select("base_id", "other_id", "base", "other").mapInArrow(_matches, "base_id long, other_id long, pos long, len long")


BLOCK_BITS, RUN_POINTS, PAIR_POINTS = 6, 60_000, 60_000


def _follower_runs(ids: list[int], sizes: list[int], steps: int) -> Iterator[tuple[int, int, int]]:
    """(first row, row after the last, row after the last that follows one of them) for runs of rows in order of id, of about RUN_POINTS characters."""
    start = size = 0
    for i in range(len(ids) + 1):
        if i > start and (i == len(ids) or size + sizes[i] > RUN_POINTS):
            stop = i
            while stop < len(ids) and ids[stop] <= ids[i - 1] + steps:
                stop += 1
            yield start, i, stop
            start, size = i, 0
        size += sizes[i] if i < len(ids) else 0


def _follower_matches(steps: int, least: int):
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("text_id").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        ids, own, texts = table.column("text_id").to_pylist(), table.column("own").to_pylist(), [x or "" for x in table.column("body").to_pylist()]
        many = Counter(ids)
        found: dict[tuple[int, int], list[int]] = {}
        stop_own = own.index(False) if False in own else len(own)  # rows of the next block come last
        for a, b, c in _follower_runs(ids, list(map(len, texts)), steps):
            a, b = min(a, stop_own), min(b, stop_own)
            pairs = [(i, j) for i in range(a, b) if texts[i] for j in range(i + 1, c) if ids[i] < ids[j] <= ids[i] + steps]
            if not pairs:
                continue
            matches = PairMatches(texts[a:c])
            for i, j, length in matches.of([(i - a, j - a) for i, j in pairs], PAIR_POINTS):
                key = ids[a + i], ids[a + j]
                weight = many[key[0]] * many[key[1]]  # a pair of ids is asked for as often as there are rows of both
                total, longest, places = found.get(key, (0, 0, 0))
                found[key] = total + weight * int(length.sum()), max(longest, int(length.max())), places + weight * int(np.count_nonzero(length >= least))
        rows = [(*k, *v) for k, v in found.items()]
        return pa.table([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], ["base_id", "other_id", "total", "longest", "long_places"])

    return run


def follower_matches(texts: DataFrame, steps: int, least: int) -> DataFrame:
    """(base_id, other_id, total, longest, long_places) for each text that is not empty and each of those whose ids are larger by 1 to `steps`: sum and maximum of
    the matching statistics, and how many places match at least `least` characters. The same as those of matching_statistics by pair.

    A text is sorted once for all its pairs: texts meet in blocks of 2^BLOCK_BITS ids, each with the first `steps` of the next block, in runs that are sorted
    together; only a row for each pair leaves the task. Where ids repeat, every row meets every row."""
    if not 0 < steps < 1 << BLOCK_BITS:
        raise ValueError(f"steps must be from 1 to {(1 << BLOCK_BITS) - 1}")
    block = F.shiftright("text_id", BLOCK_BITS)
    before = F.when(F.col("text_id").bitwiseAND((1 << BLOCK_BITS) - 1) < steps, F.array(block, block - 1)).otherwise(F.array(block))
    dealt = texts.select("text_id", "body", F.explode(before).alias("block"))
    dealt = dealt.select("block", "text_id", "body", (F.col("block") == F.shiftright("text_id", BLOCK_BITS)).alias("own"))
    return dealt.groupBy("block").applyInArrow(_follower_matches(steps, least), "base_id long, other_id long, total long, longest long, long_places long")


def fold(statistics: DataFrame, how: str) -> DataFrame:
    """(base_id, pos, len): the least ("all", held by all others) or largest ("any", held by some other) match of each position."""
    return statistics.groupBy("base_id", "pos").agg((F.min if how == "all" else F.max)("len").alias("len"))


def running_fold(statistics: DataFrame, order: DataFrame) -> DataFrame:
    """(base_id, pos, step, held_by_all, held_by_any) after each other text in turn; order is (base_id, other_id, step)."""
    w = Window.partitionBy("base_id", "pos").orderBy("step")
    return statistics.join(order, ["base_id", "other_id"]).select("base_id", "pos", "step", F.min("len").over(w).alias("held_by_all"), F.max("len").over(w).alias("held_by_any"))


def exclusive(repeats: DataFrame, others: DataFrame) -> DataFrame:
    """Repeats (with first_pos) of a base text that occur in none of its others; others is fold(..., "any")."""
    held = others.select(F.col("base_id").alias("text_id"), F.col("pos").alias("first_pos"), F.col("len").alias("held"))
    return repeats.join(held, ["text_id", "first_pos"], "left").where(F.coalesce("held", F.lit(0)) < F.col("len")).drop("held")


def _exclusive(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = batch.column(2).to_pylist()
            for a, _, texts in text_runs(batch, 1, 2):
                groups = [[x, *(o or "" for o in others[a + i])] for i, x in enumerate(texts)]
                first = np.cumsum([0, *map(len, groups)])[:-1]
                order = SuffixOrder([t for g in groups for t in g], [i for i, g in enumerate(groups) for _ in g])
                base = np.zeros(sum(map(len, groups)), dtype=bool)
                base[first] = True
                held, own = order.matches(~base), order.of_texts(base)
                length, at, stop = peaks(own.common_prefixes(), own.lefts(), least)
                text = own.text[own.order[at]]
                # The place that a repeat is looked up at is its earliest.
                place = np.minimum.reduceat(np.append(own.position, 0), np.stack([at, stop], axis=1).ravel())[::2] if len(at) else at
                free = held[order.offsets[first[text]] + place] < length
                ids = batch.column(0).slice(a).take(pa.array(text[free]))
                columns = (length, stop - at, at - own.offsets[text], place)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c[free], pa.int64()) for c in columns)], ["text_id", "len", "occs", "first_rank", "first_pos"])

    return run


def exclusive_supermaximal(texts: DataFrame, relation: DataFrame, least: int = 1) -> DataFrame:
    """supermaximal_repeats of each text that none of its others holds; a text without others has all of its own. A text and its others meet in one task, are
    sorted once together, and only repeats leave it."""
    t = texts.select("text_id", "body")
    near = relation.join(t.select(F.col("text_id").alias("other_id"), F.col("body").alias("other")), "other_id").groupBy(F.col("base_id").alias("text_id")).agg(F.collect_list("other").alias("others"))
    rows = t.join(near, "text_id", "left").select("text_id", "body", F.coalesce("others", F.array().cast("array<string>")).alias("others"))
    return rows.mapInArrow(_exclusive(least), "text_id long, len long, occs long, first_rank long, first_pos long")


def _outermost(order: SuffixOrder, held: np.ndarray, least: int) -> list[int]:
    """Places whose longest held string, of length held[place], is part of no longer held string, one place for each such string.

    Strings are taken from the longest to the shortest. Ranks that share as many characters are merged on the way, so a group of ranks is the set of a
    string's occurrences, and knows the most that is held at any of them or at the place before."""
    n = len(held)
    prefixes = order.common_prefixes()
    rank = np.empty(n, dtype=np.int64)
    rank[order.order] = np.arange(n)
    before = np.concatenate([[0], held[:-1]])
    most = np.maximum(held, before)[order.order].tolist()
    group = list(range(n))

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = x = group[group[x]]
        return x

    edges = iter(np.argsort(-prefixes, kind="stable").tolist())
    edge = next(edges, None)
    found, seen = [], set()
    starts = np.flatnonzero((held >= max(1, least)) & (before <= held))
    for place in starts[np.argsort(-held[starts], kind="stable")].tolist():
        length = int(held[place])
        while edge is not None and prefixes[edge] >= length:
            a, b = root(edge), root(edge + 1)
            group[b] = a
            most[a] = max(most[a], most[b])
            edge = next(edges, None)
        own = (root(int(rank[place])), length)
        if most[own[0]] <= length and own not in seen:
            seen.add(own)
            found.append(place)
    return found


def _common(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text_id, text, held in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                length = np.array(held, dtype=np.int64)
                rows += [(text_id, text[p : p + int(length[p])], int(length[p])) for p in _outermost(SuffixOrder([text]), length, least)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64()))], ["text_id", "pattern", "len"])

    return run


def common_substrings(texts: DataFrame, everywhere: DataFrame, least: int = 1) -> DataFrame:
    """(text_id, pattern, len): substrings of a base text that all its others hold and that no longer one of them contains.

    everywhere is fold(..., "all"). A text and what is held at its places meet in one task; a held string is part of a longer one exactly where more is
    held at one of its occurrences, or at the place before one."""
    held = everywhere.groupBy("base_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "len"))), lambda x: x["len"]).alias("held"))
    joined = texts.select(F.col("text_id").alias("base_id"), "body").join(held, "base_id").where(F.size("held") > 0)
    return joined.select("base_id", "body", "held").mapInArrow(_common(least), "text_id long, pattern string, len long")


def tags(texts: DataFrame, everywhere: DataFrame, nowhere: DataFrame, mode: str = "minimal") -> DataFrame:
    """(text_id, pattern, len): substrings of a base text that all its others hold (fold "all") and none of its filters (fold "any").

    mode "shortest" gives the first shortest of each base, "all_shortest" all of that length, "minimal" all that contain no other."""
    w = Window.partitionBy("base_id").orderBy("pos")
    both = everywhere.select("base_id", "pos", F.col("len").alias("mc")).join(nowhere.select("base_id", "pos", F.col("len").alias("nc")), ["base_id", "pos"])
    starts = both.withColumn("next", F.lead("nc").over(w)).where("nc < mc").withColumn("len", F.col("nc") + 1)
    if mode == "minimal":
        starts = starts.where(F.col("next").isNull() | (F.col("nc") <= F.col("next")))
    else:
        whole = Window.partitionBy("base_id")
        starts = starts.withColumn("shortest", F.min("len").over(whole)).where("len = shortest")
        if mode == "shortest":
            starts = starts.withColumn("first", F.min("pos").over(whole)).where("pos = first")
    named = starts.join(texts.select(F.col("text_id").alias("base_id"), "body"), "base_id")
    return named.select(F.col("base_id").alias("text_id"), F.substring("body", (F.col("pos") + 1).cast("int"), F.col("len").cast("int")).alias("pattern"), "len").distinct()
