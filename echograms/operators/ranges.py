"""Questions about arrays stored as rows (array_id, pos, value), positions from 0: range minima, next and previous values, bit ranks.

Blocks of BLOCK positions make the work parallel inside one long array: sums of blocks are small tables of their own, so only one row for each block of an
array ever meets in a window. Extremes and nearest values are looked up in chunks of CHUNK positions, packed in a row each, that meet their questions once;
these operators write the chunks to the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from echograms.sources.shared import cut

BLOCK, CHUNK = 256, 1024


def _block(c: str | Column) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / BLOCK)


def range_extremes(array: DataFrame, queries: DataFrame) -> DataFrame:
    """(array_id, query_id, low, high): least and largest value at positions start <= pos < end of queries (array_id, query_id, start, end); null for
    an empty range. Values are numbers. A range inside a chunk of CHUNK positions is answered there; one that goes beyond is the rest of the first chunk, the
    beginning of the last, and whole chunks, which are the same question one level up."""
    chunks = _chunked(array)
    return _extremes(chunks, queries.select("array_id", "query_id", "start", "end"), _last_chunk(chunks), array.schema["value"].dataType)


def _extremes(chunks: DataFrame, queries: DataFrame, last: int, kind: DataType) -> DataFrame:
    start, end = F.col("start"), F.least(F.col("end"), F.lit((last + 1) * CHUNK))
    first, final = _chunk(start), _chunk(end - 1)
    wide = (final > first) & (start < end)
    near = queries.select("array_id", "query_id", start.alias("a"), F.when(start < end, end).otherwise(start).alias("b"), wide.alias("wide"))
    edge = _chunk("a") * CHUNK + CHUNK
    ends = F.when(F.col("wide"), F.array(F.struct("a", edge.alias("b")), F.struct((_chunk(F.col("b") - 1) * CHUNK).alias("a"), "b"))).otherwise(F.array(F.struct("a", "b")))
    pieces = near.select("array_id", "query_id", "wide", F.explode(ends).alias("x")).select("array_id", _chunk("x.a").alias("chunk"), "query_id", "wide", F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    schema = StructType([chunks.schema["array_id"], queries.schema["query_id"], *StructType.fromDDL("wide boolean"), StructField("low", kind), StructField("high", kind)])
    names = ["array_id", "query_id", "wide", "low", "high"]
    met = _meeting(chunks, pieces).mapInArrow(_answers(_least_and_largest, names), schema)
    if not last:
        return met.select("array_id", "query_id", "low", "high")
    inner = queries.where(wide & (final - first > 1)).select("array_id", "query_id", (first + 1).alias("start"), final.alias("end"))
    summed = [F.array_min("values").alias("low"), F.array_max("values").alias("high")]
    upper = chunks.select("array_id", F.col("chunk").alias("pos"), *summed)
    both = [_extremes(_chunked(upper.select("array_id", "pos", F.col(c).alias("value"))), inner, last // CHUNK, kind).select("array_id", "query_id", *[(F.col(x) if x == c else F.lit(None).cast(kind)).alias(x) for x in ("low", "high")]) for c in ("low", "high")]
    several = met.where("wide").select("array_id", "query_id", "low", "high").unionByName(both[0]).unionByName(both[1])
    found = several.groupBy("array_id", "query_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return met.where("not wide").select("array_id", "query_id", "low", "high").unionByName(found)


def _chunk(c: str | Column) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / CHUNK)


def _chunked(array: DataFrame) -> DataFrame:
    """(array_id, chunk, places, values), a row for each CHUNK positions of an array, written to the shared folder; values that are null are left out. A sort by
    array and position that the rows already have is enough for it."""
    rows = array.where("value is not null and array_id is not null").groupBy("array_id", _chunk("pos").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("x"))
    return cut(rows.select("array_id", "chunk", F.col("x.pos").cast("array<long>").alias("places"), F.col("x.value").alias("values")), "chunks")


def _last_chunk(chunks: DataFrame) -> int:
    return chunks.agg(F.max("chunk")).first()[0] or 0


def _meeting(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of chunks and what is asked of them (array_id, chunk, ...), each chunk before its questions, which follow it in any number."""
    rows = chunks.withColumn("asked", F.lit(False)).unionByName(asked.withColumn("asked", F.lit(True)), allowMissingColumns=True)
    return rows.repartition("array_id", "chunk").sortWithinPartitions("array_id", "chunk", "asked").select("array_id", "chunk", "asked", "places", "values", *[c for c in asked.columns if c not in ("array_id", "chunk")])


def _answers(answer: Callable, names: list[str]):
    """The questions of each batch of _meeting, all at once: the chunks lie one after the other, so a question is about places low to high - 1 of one array. The
    last chunk of a batch goes on to the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None, np.zeros(0, np.int64), None)
        for batch in batches:
            asked = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            owners = np.flatnonzero(~asked)
            lists = batch.filter(pa.array(~asked))
            places, values = (lists.column(k).flatten().to_numpy(zero_copy_only=False) for k in (3, 4))
            sizes = lists.column(3).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            keys = list(zip(lists.column(0).to_pylist(), lists.column(1).to_pylist(), strict=True))
            if held[0] is not None:
                places, values = np.concatenate([held[2], places]), np.concatenate([held[3], values]) if len(values) else held[3]
            sizes, keys = np.append(len(held[2]), sizes), [held[0], *keys]
            stop = np.cumsum(sizes)
            at = np.flatnonzero(asked)
            which = np.searchsorted(owners, at)  # 0: the chunk that was held
            # A question whose chunk has no row follows another chunk's.
            a = batch.filter(pa.array(asked))
            own = np.array([keys[w] == k for w, k in zip(which.tolist(), zip(a.column(0).to_pylist(), a.column(1).to_pylist(), strict=True), strict=True)], dtype=bool)
            low, high = (stop - sizes)[which], np.where(own, stop[which], (stop - sizes)[which])
            if len(at):
                yield pa.RecordBatch.from_arrays(answer(a, places, values, low, high), names)
            held = (keys[-1], None, places[stop[-1] - sizes[-1] :], values[stop[-1] - sizes[-1] :])

    return run


def _bounds(places: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The first of places[low : high], which rise, that is at least wanted, high where none is; by halves, for all questions at once."""
    low, high = low.copy(), high.copy()
    while (live := np.flatnonzero(low < high)).size:
        middle = (low[live] + high[live]) >> 1
        less = places[middle] < wanted[live]
        low[live[less]] = middle[less] + 1
        high[live[~less]] = middle[~less]
    return low


def _levels(values: np.ndarray, of: np.ufunc, longest: int) -> list[np.ndarray]:
    """of over 1, 2, 4, ... values from each place on, as far as they reach."""
    out, step = [values], 1
    while 2 * step <= longest and 2 * step <= len(values):
        out.append(of(out[-1][:-step], out[-1][step:]))
        step *= 2
    return out


def _least_and_largest(asked: pa.RecordBatch, places, values, low, high) -> list[pa.Array]:
    a, b = (asked.column(asked.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("a", "b"))
    first = _bounds(places, low, high, a)
    stop = _bounds(places, first, high, b)
    size = stop - first
    power = np.array([int(n).bit_length() - 1 for n in range(int(size.max(initial=0)) + 1)])[size]
    found = []
    for of in (np.minimum, np.maximum):
        out = np.zeros(len(size), values.dtype if values is not None else np.int64)
        for k, level in enumerate(_levels(values, of, int(size.max(initial=0))) if size.any() else ()):
            now = np.flatnonzero(power == k)
            out[now] = of(level[first[now]], level[stop[now] - (1 << k)])
        found.append(pa.array(out, asked.schema.field("values").type.value_type, mask=size == 0))
    return [*(asked.column(asked.schema.get_field_index(c)) for c in ("array_id", "query_id", "wide")), *found]


def updated(array: DataFrame, changes: DataFrame) -> DataFrame:
    """array with the values of changes (array_id, pos, value) in place of its own."""
    new = changes.select("array_id", "pos", F.col("value").alias("new"))
    return array.join(new, ["array_id", "pos"], "left").select("array_id", "pos", F.coalesce("new", "value").alias("value"))


def next_at_most(array: DataFrame, queries: DataFrame) -> DataFrame:
    """(array_id, query_id, next, previous): the nearest position from pos on, and the nearest up to pos, whose value is at most the query's bound;
    null where there is none. Queries are (array_id, query_id, pos, bound), values and bounds numbers. A query first looks at its own chunk of CHUNK positions;
    where nothing there passes, the same question is put to the table of the chunks' extremes, one level up, and the chunk that it names is looked at."""
    return _nearest(array, queries, True)


def next_at_least(array: DataFrame, queries: DataFrame) -> DataFrame:
    """The same for values of at least the bound."""
    return _nearest(array, queries, False)


def _nearest(array: DataFrame, queries: DataFrame, least: bool) -> DataFrame:
    chunks = _chunked(array)
    asked = queries.select("array_id", "query_id", F.col("pos").alias("ahead"), F.col("pos").alias("back"), "bound")
    return _both_ways(chunks, asked, least, _last_chunk(chunks), True).select("array_id", "query_id", "next", "previous")


def _both_ways(chunks: DataFrame, queries: DataFrame, least: bool, last: int, together: bool = False) -> DataFrame:
    """(array_id, query_id, bound, next, previous): the nearest place from `ahead` on and up to `back` that passes; queries have either or both. together: both
    are one place."""
    either = F.coalesce("ahead", "back")
    many = F.when(F.col("ahead").isNull() | F.col("back").isNull() | (_chunk("ahead") == _chunk("back")), F.array(F.struct("ahead", "back")))
    none = F.lit(None).cast("long")
    many = many.otherwise(F.array(F.struct("ahead", none.alias("back")), F.struct(none.alias("ahead"), "back")))
    split = queries.select("array_id", "query_id", "bound", F.explode(many).alias("x")).select("array_id", "query_id", "bound", F.col("x.ahead").alias("ahead"), F.col("x.back").alias("back"))
    pieces = split.select("array_id", _chunk(either).alias("chunk"), "query_id", "bound", "ahead", "back")
    names = ["array_id", "query_id", "bound", "ahead", "back", "next", "previous"]
    schema = StructType([chunks.schema["array_id"], *(queries.schema[c] for c in ("query_id", "bound")), *StructType.fromDDL("ahead long, back long, next long, previous long")])
    own = _meeting(chunks, pieces).mapInArrow(_answers(_nearest_that_pass(least), names), schema)
    if not last:
        return own.drop("ahead", "back") if together else _joined_ways(own)
    own = cut(own, "nearest")
    further = lambda c, found, step: F.when(F.col(c).isNotNull() & F.col(found).isNull(), _chunk(c) + step)
    open_ = own.select("array_id", "query_id", "bound", further("ahead", "next", 1).alias("ahead"), further("back", "previous", -1).alias("back")).where("ahead is not null or back is not null")
    upper = chunks.select("array_id", F.col("chunk").alias("pos"), (F.array_min if least else F.array_max)("values").alias("value"))
    named = _both_ways(_chunked(upper), open_, least, last // CHUNK)
    there = named.where("next is not null or previous is not null").select("array_id", "query_id", "bound", (F.col("next") * CHUNK).alias("ahead"), (F.col("previous") * CHUNK + CHUNK - 1).alias("back"))
    split = there.select("array_id", "query_id", "bound", F.explode(F.array(F.struct("ahead", none.alias("back")), F.struct(none.alias("ahead"), "back"))).alias("x")).select("array_id", "query_id", "bound", F.col("x.ahead").alias("ahead"), F.col("x.back").alias("back")).where("ahead is not null or back is not null")
    found = _meeting(chunks, split.select("array_id", _chunk(either).alias("chunk"), "query_id", "bound", "ahead", "back")).mapInArrow(_answers(_nearest_that_pass(least), names), schema)
    return _joined_ways(own.unionByName(found))


def _joined_ways(rows: DataFrame) -> DataFrame:
    return rows.groupBy("array_id", "query_id").agg(F.first("bound").alias("bound"), F.max("next").alias("next"), F.max("previous").alias("previous"))


def _nearest_that_pass(least: bool):
    def answer(asked: pa.RecordBatch, places, values, low, high) -> list[pa.Array]:
        column = lambda c: asked.column(asked.schema.get_field_index(c))
        bound, of = column("bound"), np.minimum if least else np.maximum
        valid = bound.is_valid().to_numpy(zero_copy_only=False)
        given = bound.fill_null(0).to_numpy(zero_copy_only=False)
        levels = _levels(values, of, int((high - low).max(initial=0))) if values is not None and len(values) else []
        out = []
        for c, ahead in (("ahead", True), ("back", False)):
            wanted, known = column(c).fill_null(0).to_numpy(zero_copy_only=False), column(c).is_valid().to_numpy(zero_copy_only=False) & valid
            # Steps of falling size over what does not pass: at stays on the first place that may.
            at = _bounds(places, low, high, wanted + (0 if ahead else 1))
            for k in range(len(levels) - 1, -1, -1):
                for _ in range(2 if k == len(levels) - 1 else 1):
                    live = np.flatnonzero(known & ((at + (1 << k) <= high) if ahead else (at - (1 << k) >= low)))
                    seen = levels[k][at[live] if ahead else at[live] - (1 << k)]
                    past = live[(seen > given[live]) if least else (seen < given[live])]
                    at[past] += (1 << k) if ahead else -(1 << k)
            got = known & ((at < high) if ahead else (at > low))
            spot = np.where(got, at if ahead else at - 1, 0)
            out.append(pa.array(np.asarray(places)[spot] if len(places) else np.zeros(len(spot), np.int64), pa.int64(), mask=~got))
        return [*(column(c) for c in ("array_id", "query_id", "bound", "ahead", "back")), *out]

    return answer


def bit_ranks(bits: DataFrame) -> DataFrame:
    """(array_id, pos, bit, rank1, rank0): ones and zeros before each position of rows (array_id, pos, bit 0 or 1)."""
    rows = bits.withColumn("block", _block("pos"))
    per = rows.groupBy("array_id", "block").agg(F.sum("bit").alias("ones"))
    before = Window.partitionBy("array_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("array_id", "block", F.coalesce(F.sum("ones").over(before), F.lit(0)).alias("offset"))
    inner = Window.partitionBy("array_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ones = F.col("offset") + F.coalesce(F.sum("bit").over(inner), F.lit(0))
    return rows.join(offsets, ["array_id", "block"]).select("array_id", "pos", "bit", ones.alias("rank1"), (F.col("pos") - ones).alias("rank0"))


def bit_select(bits: DataFrame, value: int = 1) -> DataFrame:
    """(array_id, i, pos): the place of the i-th bit of that value, i from 1."""
    ranked = bit_ranks(bits).where(F.col("bit") == value)
    return ranked.select("array_id", (F.col("rank1" if value else "rank0") + 1).alias("i"), "pos")


def set_neighbours(members: DataFrame, queries: DataFrame) -> DataFrame:
    """(array_id, query_id, at_most, at_least): the largest member that is at most the query's value, and the least that is at least it, for members
    (array_id, value) and queries (array_id, query_id, value); null where there is none."""
    both = members.select("array_id", "value", F.lit(None).cast("long").alias("query_id"), F.col("value").alias("member")).distinct().union(queries.select("array_id", "value", "query_id", F.lit(None).cast("long").alias("member")))
    kind = F.col("query_id").isNotNull().cast("int")
    down = Window.partitionBy("array_id").orderBy("value", kind).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("array_id").orderBy(F.col("value").desc(), kind).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("at_most", F.last("member", True).over(down)).withColumn("at_least", F.last("member", True).over(up)).where("query_id is not null").select("array_id", "query_id", "at_most", "at_least")


def overlapping(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """(array_id, pos, interval_id) for every interval [start, end) that holds a point, joined by the blocks that the interval touches."""
    touched = intervals.where("start < end").withColumn("block", F.explode(F.sequence(_block("start"), _block(F.col("end") - 1))))
    placed = points.withColumn("block", _block("pos"))
    return placed.join(touched, ["array_id", "block"]).where("start <= pos and pos < end").select("array_id", "pos", "interval_id")
