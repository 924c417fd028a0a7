"""Repeats of a text and what they cover: maximal and supermaximal repeats, previous occurrences, coverage, maximal intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echograms.functions.suffix_kernels import RepeatTree, SuffixOrder, greedy_costs, peaks, repeat_intervals, spread, text_runs

REPEATS = "text_id long, pattern string, len long, occs long, first_rank long, first_pos long, n_left long, n_right long"


def _repeats(least: int, with_pattern: bool, paired: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            other = batch.column(2).to_pylist() if paired else None
            for a, _, texts in text_runs(batch, 1):
                both = [t for i, x in enumerate(texts) for t in ((x, other[a + i] or "") if paired else (x,))]
                per = 2 if paired else 1
                order = SuffixOrder(both, [i // per for i in range(len(both))])
                length, first, n = repeat_intervals(order.common_prefixes(), order.lefts(), least)
                start, at = order.order[first], order.position[first]
                row = order.group[start]
                side = np.concatenate([[0], np.cumsum(order.text[order.order] % per)])
                right = side[first + n] - side[first]
                patterns = [both[t][p : p + k] for t, p, k in zip(order.text[start].tolist(), at.tolist(), length.tolist(), strict=True)] if with_pattern else pa.nulls(len(length), pa.string())
                ids = batch.column(0).slice(a).take(pa.array(row, pa.int64()))
                numbers = [pa.array(x, pa.int64()) for x in (length, n, first - order.offsets[::per][row], at, n - right, right)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(patterns, pa.string()), *numbers], ["text_id", "pattern", "len", "occs", "first_rank", "first_pos", "n_left", "n_right"])

    return run


def maximal_repeats(texts: DataFrame, least: int = 1, with_pattern: bool = True) -> DataFrame:
    """(text_id, pattern, len, occs, first_rank, first_pos) of every maximal repeat of each text: it occurs at least twice, and its occurrences are not all
    preceded, nor all followed, by the same character (the ends of a text differ from all characters). Its occurrences are the suffixes with
    ranks first_rank to first_rank + occs - 1, and first_pos is the place of the first of these. with_pattern=False leaves the pattern null, as long repeats nested in each other add up."""
    return texts.select("text_id", "body").mapInArrow(_repeats(least, with_pattern, False), REPEATS).drop("n_left", "n_right")


def pair_repeats(pairs: DataFrame, least: int = 1, with_pattern: bool = True) -> DataFrame:
    """Maximal repeats of pairs of texts (text_id, body, other): occurrences may lie in either text, and none crosses from one into the other.
    n_left and n_right count the occurrences in body and other."""
    return pairs.select("text_id", "body", "other").mapInArrow(_repeats(least, with_pattern, True), REPEATS)


def one_sided(repeats: DataFrame, side: str) -> DataFrame:
    """Repeats of pairs that occur on the named side only ("left", "right"), on "both" sides, or "all"."""
    tests = {"left": "n_right = 0", "right": "n_left = 0", "both": "n_left > 0 and n_right > 0", "all": "true"}
    return repeats.where(tests[side])


def occurrences(repeats: DataFrame, suffixes: DataFrame) -> DataFrame:
    """A row (text_id, len, occs, first_rank, pos) for each occurrence of each repeat."""
    ranks = repeats.select("text_id", "len", "occs", "first_rank", F.explode(F.sequence("first_rank", F.col("first_rank") + F.col("occs") - 1)).alias("rank"))
    return ranks.join(suffixes.select("text_id", "rank", "pos"), ["text_id", "rank"]).drop("rank")


def _supermaximal(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, texts in text_runs(batch, 1):
                order = SuffixOrder(texts)
                length, first, stop = peaks(order.common_prefixes(), order.lefts(), least)
                text = order.text[order.order[first]]
                pos = np.minimum.reduceat(np.append(order.position, 0), np.stack([first, stop], axis=1).ravel())[::2] if len(first) else first
                ids = batch.column(0).slice(a).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([ids, pa.array(length), pa.array(stop - first), pa.array(first - order.offsets[text]), pa.array(pos)], ["text_id", "len", "occs", "first_rank", "first_pos"])

    return run


def supermaximal_repeats(texts: DataFrame, least: int = 1) -> DataFrame:
    """(text_id, len, occs, first_rank, first_pos) of every repeat that is not part of another: a run of equal common prefixes that is higher than
    both its neighbours, whose occurrences are all preceded by different characters. first_pos is its earliest place. One map pass."""
    return texts.select("text_id", "body").mapInArrow(_supermaximal(least), "text_id long, len long, occs long, first_rank long, first_pos long")


def with_pattern(repeats: DataFrame, texts: DataFrame) -> DataFrame:
    """Repeats that know first_pos, with the pattern cut from the text."""
    return repeats.join(texts, "text_id").withColumn("pattern", F.substring("body", (F.col("first_pos") + 1).cast("int"), F.col("len").cast("int"))).drop("body")


def _previous(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of places whose repeats are the rest of one longer copy: the distance stays and the length falls by one from place to place."""
    for batch in batches:
        for a, _, texts in text_runs(batch, 1):
            order = SuffixOrder(texts)
            length, distance = RepeatTree(order).previous()
            at = np.arange(len(length))
            end = np.where(length > 0, at + length, -1)
            new = np.flatnonzero(np.concatenate([[True], (end[1:] != end[:-1]) | (distance[1:] != distance[:-1]) | (order.text[1:] != order.text[:-1])])) if len(at) else at
            size = np.diff(np.append(new, len(at)))
            ids = batch.column(0).slice(a).take(pa.array(order.text[new]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(new - order.begins[new]), pa.array(size), pa.array(length[new]), pa.array(distance[new])], ["text_id", "start", "places", "len", "delta"])


def previous_runs(texts: DataFrame) -> DataFrame:
    """(text_id, start, places, len, delta): every text in runs of positions. Of the first one, len is the longest maximal repeat that starts there and occurred
    before, and delta the distance to its nearest earlier occurrence; of each further one, len is less by one, and delta the same. 0 and 0 where there is
    none. One map pass in n log n steps for a text of n characters, however periodic it is."""
    return texts.select("text_id", "body").mapInArrow(_previous, "text_id long, start long, places long, len long, delta long")


def longest_previous(runs: DataFrame) -> DataFrame:
    """(text_id, pos, len, delta) for every position, from previous_runs."""
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.col("places") - 1)).alias("step")
    return runs.select("text_id", "start", "len", "delta", step).select("text_id", (F.col("start") + F.col("step")).alias("pos"), F.greatest(F.col("len") - F.col("step"), F.lit(0)).alias("len"), "delta")


def _previous_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in text_runs(batch, 1):
            order = SuffixOrder(texts)
            length, distance = RepeatTree(order).previous()
            full = np.flatnonzero(np.diff(order.offsets))
            sums = []
            for fold, values in ((np.add, (length > 0).astype(np.int64)), (np.add, length), (np.maximum, length), (np.add, distance), (np.maximum, distance)):
                out = np.zeros(len(texts), np.int64)
                if len(full):
                    out[full] = fold.reduceat(values, order.offsets[full])
                sums.append(pa.array(out))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *sums], ["text_id", "places", "total", "longest", "distances", "farthest"])


def previous_statistics(texts: DataFrame) -> DataFrame:
    """(text_id, places, total, longest, distances, farthest) for each text: at how many places a repeat starts that occurred before, and sums and largest values of
    its lengths and of the distances to its nearest earlier occurrence, as previous_runs gives them. One map pass, a row for each text."""
    return texts.select("text_id", "body").mapInArrow(_previous_statistics, "text_id long, places long, total long, longest long, distances long, farthest long")


def _code_costs(codes: list[tuple[int, bool]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_runs(batch, 1):
                order = SuffixOrder(texts)
                length, distance = RepeatTree(order).previous()
                costs = [pa.array(greedy_costs(length, distance, order.offsets, char, far), pa.int64()) for char, far in codes]
                full = pa.array([i for i, t in enumerate(texts) if t], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *costs], ["text_id", *[f"cost_{i}" for i in range(len(codes))]]).take(full)

    return run


def code_costs(texts: DataFrame, **codes: tuple[int, bool]) -> DataFrame:
    """(text_id, a column for each code): bits of greedy codes by longest previous repeats, each given as (bits of a plain character, whether distances are
    paid for). The repeats of a text are found once for all codes and do not leave the task; empty texts have no row."""
    out = texts.select("text_id", "body").mapInArrow(_code_costs(list(codes.values())), ", ".join(["text_id long", *[f"cost_{i} long" for i in range(len(codes))]]))
    return out.withColumnsRenamed({f"cost_{i}": name for i, name in enumerate(codes)})


def _starts(ends: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, texts in text_runs(batch, 1):
                order = SuffixOrder([t[::-1] for t in texts] if ends else texts)
                pos = np.arange(len(order.text)) - order.begins
                ids = batch.column(0).slice(a).take(pa.array(order.text))
                yield pa.RecordBatch.from_arrays([ids, pa.array(order.ends - order.begins - 1 - pos if ends else pos), pa.array(order.longest_starts())], ["text_id", "pos", "len"])

    return run


def longest_starts(texts: DataFrame) -> DataFrame:
    """(text_id, pos, len): the longest repeat that starts at each position. One map pass."""
    return texts.select("text_id", "body").mapInArrow(_starts(False), "text_id long, pos long, len long")


def longest_ends(texts: DataFrame) -> DataFrame:
    """(text_id, pos, len): the longest repeat that ends with each position; the same question on the reversed text."""
    return texts.select("text_id", "body").mapInArrow(_starts(True), "text_id long, pos long, len long")


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, _, texts in text_runs(batch, 1):
            order = SuffixOrder(texts)
            cover = spread(order.longest_starts())
            new = np.flatnonzero(np.concatenate([[True], (cover[1:] != cover[:-1]) | (order.text[1:] != order.text[:-1])])) if len(cover) else np.zeros(0, np.int64)
            stop = np.append(new[1:], len(cover)) if len(new) else new
            begins = order.begins[new]
            ids = batch.column(0).slice(a).take(pa.array(order.text[new]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(new - begins), pa.array(stop - begins), pa.array(cover[new])], ["text_id", "start", "end", "cover"])


def covered_runs(texts: DataFrame) -> DataFrame:
    """(text_id, start, end, cover): every text in runs of positions, cover being the length of the longest repeat over each position of the run. One map
    pass; a row for each run, not for each character."""
    return texts.select("text_id", "body").mapInArrow(_covered, "text_id long, start long, end long, cover long")


def covered_positions(runs: DataFrame) -> DataFrame:
    """(text_id, pos, cover): runs spread over their positions."""
    return runs.select("text_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"), "cover")


def coverage(starts: DataFrame) -> DataFrame:
    """(text_id, pos, cover) from (text_id, pos, len): the largest len of any q with q <= pos < q + len; 0 where none reaches.

    Only intervals that no other contains are spread over their places: the longest one over a place is always such an interval."""
    spans = maximal_intervals(starts.where("len > 0").select("text_id", F.col("pos").alias("start"), (F.col("pos") + F.col("len")).alias("end")), "text_id")
    covered = spans.select("text_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"), (F.col("end") - F.col("start")).alias("len")).groupBy("text_id", "pos").agg(F.max("len").alias("cover"))
    return starts.select("text_id", "pos").join(covered, ["text_id", "pos"], "left").select("text_id", "pos", F.coalesce("cover", F.lit(0)).alias("cover"))


def maximal_intervals(intervals: DataFrame, *keys: str) -> DataFrame:
    """Intervals (keys, start, end) that no interval of the same keys with an earlier start (or the same start and a later end) contains."""
    widest = intervals.groupBy(*keys, "start").agg(F.max("end").alias("end"))
    reach = F.max("end").over(Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    return widest.withColumn("reach", reach).where(F.col("reach").isNull() | (F.col("end") > F.col("reach"))).drop("reach")


def fragments(runs: DataFrame, texts: DataFrame, keep: Column) -> DataFrame:
    """(text_id, start, len, body): maximal runs of positions where `keep` (a test of cover) holds, from covered_runs."""
    w = Window.partitionBy("text_id").orderBy("start")
    held = runs.where(keep).withColumn("before", F.lag("end").over(w))
    joined = held.withColumn("run", F.sum(F.when(F.col("before") == F.col("start"), 0).otherwise(1)).over(w)).groupBy("text_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    size = F.col("end") - F.col("start")
    return joined.join(texts, "text_id").select("text_id", "start", size.alias("len"), F.substring("body", (F.col("start") + 1).cast("int"), size.cast("int")).alias("body"))


def repeat_histogram(repeats: DataFrame) -> DataFrame:
    """(len, occs, patterns): how many repeats have each length and number of occurrences."""
    return repeats.groupBy("len", "occs").agg(F.count("*").alias("patterns"))
