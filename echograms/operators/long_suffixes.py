"""Suffix order of texts that no task can hold: prefix doubling over rows (text, place, rank).

A text comes in pieces, each a row. Its places are rows from then on, named by their first six characters. A round sorts the places whose rank is still shared
by (rank, rank of the place so many characters on): one range-partitioned sort, in which equal keys may span partitions, so a text of one letter is as
well dealt as any. A partition numbers its rows; from a line for each partition, with its ends, the driver tells each where it begins and how far back the
group goes that its first row is in. Each round's sort is written to the shared folder, and only places that share their rank go into the next
round, which looks twice as far. With one_order=True the suffixes of all texts are in one order, and equal ones share a rank."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echograms.sources.shared import cut, shared_folder

SEEN, PACKED = 6, 3  # characters that two longs hold, and one of them
PLACES = "grp long, rank long, second long, third long, text_id long, pos long, left_point int, rest long"
SORTED = "text_id long, pos long, left_point int, rest long, grp long, rank long, second long, third long, part int, number long, group long, name long, shared boolean"


def text_pieces(texts: DataFrame, size: int) -> DataFrame:
    """(text_id, piece, body): texts (text_id, body) cut into pieces of `size` characters, in one pass over each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = [body[i : i + size] for i in range(0, len(body or ""), size)]
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array([text] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.string())], ["text_id", "piece", "body"])

    return texts.select("text_id", "body").mapInArrow(run, "text_id long, piece long, body string")


def _places(one_order: bool):
    """A row for each character of a piece (text_id, start, body, before, after, size): what is there and in the five places behind, three characters of 21 bits
    in each of two longs, 0 behind the end of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, start, body, before, after, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(body)
                padded = np.zeros(n + SEEN, dtype=np.int64)
                points = np.frombuffer((body + after).encode("utf-32-le"), np.uint32)[: n + SEEN].astype(np.int64) + 1
                padded[: len(points)] = points
                packed = [padded[k : k + n] << 42 | padded[k + 1 : k + 1 + n] << 21 | padded[k + 2 : k + 2 + n] for k in (0, PACKED)]
                left = np.concatenate([[ord(before) if before else -1], points[: n - 1] - 1]).astype(np.int32)
                place = np.arange(n, dtype=np.int64) + start
                ids, zero = np.full(n, text, np.int64), np.zeros(n, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (zero if one_order else ids, zero, *packed, ids, place, left, size - place)], [x.split()[0] for x in PLACES.split(", ")])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a partition with their number in it, the numbers of the first rows with the same rank (group) and with the same key (name), 0 if they are
    not known to begin after the first row, and whether the row before or after has the same key."""
    part, at, last, group, name, held = TaskContext.get().partitionId(), 0, None, 0, 0, None

    def emit(rows, next_same: bool) -> pa.RecordBatch:
        batch, number, groups, names, same = rows
        shared = same | np.append(same[1:], next_same)
        columns = [*(batch.column(i) for i in (4, 5, 6, 7, 0, 1, 2, 3)), *map(pa.array, (np.full(len(number), part, np.int32), number, groups, names, shared))]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SORTED.split(", ")])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
        before = np.concatenate([keys[:1] if last is None else last[None], keys[:-1]])
        same = (keys == before).all(axis=1)
        number = np.arange(n, dtype=np.int64) + at
        groups = np.maximum(group, np.maximum.accumulate(np.where((keys[:, :2] == before[:, :2]).all(axis=1), 0, number)))
        names = np.maximum(name, np.maximum.accumulate(np.where(same, 0, number)))
        if last is None:
            same[0] = False
        if held is not None:
            yield emit(held, bool(same[0]))
        held, last, group, name, at = (batch, number, groups, names, same), keys[-1], int(groups[-1]), int(names[-1]), at + n
    if held is not None:
        yield emit(held, False)


def _ranked(rows: DataFrame, folder: str, partitions: int, step: int) -> DataFrame:
    """(text_id, pos, left_point, rest, grp, rank, open) after one sort of rows PLACES, in which `step` characters have been seen. open: another place has the rank,
    and the end of the text has not been seen."""
    order = ["grp", "rank", "second", "third", "text_id", "pos"]
    rows.select([x.split()[0] for x in PLACES.split(", ")]).repartitionByRange(partitions, *order).sortWithinPartitions(*order).mapInArrow(_numbered, SORTED).write.parquet(folder)
    done = rows.sparkSession.read.schema(SORTED).parquet(folder)
    key = F.struct("grp", "rank", "second", "third")
    ends = done.groupBy("part").agg(F.count("*").alias("n"), F.min_by(key, "number").alias("first"), F.max_by(key, "number").alias("last"), F.max("group").alias("group"), F.max("name").alias("name"))
    lines, offset, group, name, before = [], 0, 0, 0, None
    for r in sorted(ends.collect(), key=lambda r: r["part"]):  # one line for each partition
        first, last = tuple(r["first"]), tuple(r["last"])
        goes_on, same = before is not None and first[:2] == before[:2], before is not None and first == before
        if same and lines:
            lines[-1][5] = True
        group, name = group if goes_on else offset, name if same else offset
        lines.append([r["part"], offset, group, name, same, False, r["name"]])
        group, name = offset + r["group"] if r["group"] else group, offset + r["name"] if r["name"] else name
        offset, before = offset + r["n"], last
    known = rows.sparkSession.createDataFrame(lines, "of int, offset long, first_group long, first_name long, same_before boolean, same_after boolean, last_name long")
    met = done.join(F.broadcast(known), F.col("part") == F.col("of"))
    start = lambda local, first: F.when(F.col(local) > 0, F.col("offset") + F.col(local)).otherwise(F.col(first))
    shared = F.col("shared") | ((F.col("name") == 0) & F.col("same_before")) | ((F.col("name") == F.col("last_name")) & F.col("same_after"))
    rank = F.col("rank") + start("name", "first_name") - start("group", "first_group")
    return met.select("text_id", "pos", "left_point", "rest", "grp", rank.alias("rank"), (shared & (F.col("rest") >= step)).alias("open"))


class Doubling:
    """The rounds of a prefix doubling of texts in pieces (text_id, piece, body). levels[i] holds the places that were sorted when characters[i] characters had been
    seen, with their ranks; a place that no later level holds has its final rank."""

    def __init__(self, pieces: DataFrame, partitions: int | None = None, one_order: bool = False):
        spark = pieces.sparkSession
        self.partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = f"{shared_folder(spark)}/doubling-{uuid.uuid4().hex}"
        self.levels: list[DataFrame] = []
        self.characters: list[int] = []
        rows, step = self._first(pieces, one_order), SEEN
        while rows is not None:
            self.levels.append(_ranked(rows, f"{self.folder}/{len(self.levels)}", self.partitions, step))
            self.characters.append(step)
            rows = self._next(step)
            step *= 2

    @staticmethod
    def _first(pieces: DataFrame, one_order: bool) -> DataFrame:
        full = pieces.where("text_id is not null and body <> ''").select(F.col("text_id").cast("long"), "piece", "body")
        w = Window.partitionBy("text_id").orderBy("piece")
        edge = full.select("text_id", "piece", F.length("body").cast("long").alias("n"), F.substring("body", 1, SEEN - 1).alias("head"), F.expr("right(body, 1)").alias("tail"))
        after = F.substring(F.concat_ws("", F.collect_list("head").over(w.rowsBetween(1, SEEN - 1))), 1, SEEN - 1)
        size = F.sum("n").over(Window.partitionBy("text_id"))
        edge = edge.select("text_id", "piece", (F.sum("n").over(w) - F.col("n")).alias("start"), F.lag("tail").over(w).alias("before"), after.alias("after"), size.alias("size"))
        return full.join(edge, ["text_id", "piece"]).select("text_id", "start", "body", "before", "after", "size").mapInArrow(_places(one_order), PLACES)

    def _next(self, step: int) -> DataFrame | None:
        live = self.levels[-1].where("open")
        if live.isEmpty():
            return None
        there = self.ranks(len(self.levels) - 1).select(F.col("text_id").alias("of"), F.col("pos").alias("at"), (F.col("rank") + 1).alias("ahead"))
        met = live.join(there, (F.col("text_id") == F.col("of")) & (F.col("pos") + step == F.col("at")), "left")
        return met.select("grp", "rank", F.coalesce("ahead", F.lit(0)).cast("long").alias("second"), F.lit(0).cast("long").alias("third"), "text_id", "pos", "left_point", "rest")

    def ranks(self, level: int) -> DataFrame:
        """The rank of every place by its first characters[level] characters; of places that were alone before, their final rank."""
        out = self.levels[level]
        for earlier in self.levels[:level]:
            out = out.unionByName(earlier.where("not open"))
        return out

    def common_prefixes(self, pairs: DataFrame) -> DataFrame:
        """pairs (a_text, a_pos, b_text, b_pos, other columns) with lcp, how many characters agree from the two places on. From the last level to the first, as many
        characters are passed as a level has seen wherever both places have one rank there; what is left, less than six, is compared."""
        spark, columns = pairs.sparkSession, pairs.columns
        now = pairs.withColumn("lcp", F.lit(0).cast("long"))
        for level in range(len(self.levels) - 1, -1, -1):
            ranks = self.ranks(level).select(F.col("text_id").alias("of"), F.col("pos").alias("at"), F.col("rank").alias("found"))
            now = cut(self._at(self._at(now, ranks, "a"), ranks, "b").withColumn("lcp", F.col("lcp") + F.when(F.col("a_found") == F.col("b_found"), self.characters[level]).otherwise(0)).select(*columns, "lcp"), "prefixes")
        sizes = spark.read.schema(SORTED).parquet(f"{self.folder}/0").select(F.col("text_id").alias("of"), F.col("pos").alias("at"), F.struct("second", "third", "rest").alias("found"))
        ends = self._at(self._at(now, sizes, "a"), sizes, "b")
        point = lambda s, i: F.shiftright(F.col(f"{s}_found")["second" if i < PACKED else "third"], 21 * (PACKED - 1 - i % PACKED)).bitwiseAND((1 << 21) - 1)
        same, more = F.lit(True), F.lit(0)
        for i in range(SEEN):
            same = same & (point("a", i) == point("b", i)) & (point("a", i) > 0)
            more = more + F.when(same, 1).otherwise(0)
        full = ends.withColumn("lcp", F.col("lcp") + F.when(F.col("a_found").isNotNull() & F.col("b_found").isNotNull(), more).otherwise(0))
        whole = sizes.select("of", "at", F.col("found.rest").alias("found"))
        capped = self._at(self._at(full.select(*columns, "lcp"), whole, "a", ahead=False), whole, "b", ahead=False)
        return capped.select(*columns, F.least("lcp", "a_found", "b_found").alias("lcp"))

    @staticmethod
    def _at(pairs: DataFrame, facts: DataFrame, side: str, ahead: bool = True) -> DataFrame:
        place = F.col(f"{side}_pos") + (F.col("lcp") if ahead else 0)
        return pairs.join(facts, (F.col(f"{side}_text") == F.col("of")) & (place == F.col("at")), "left").withColumnRenamed("found", f"{side}_found").drop("of", "at")


def pieced_suffix_array(pieces: DataFrame, partitions: int | None = None, one_order: bool = False) -> DataFrame:
    """(text_id, rank, pos, left, rest) for each suffix of each text, given in pieces (text_id, piece, body) in order of piece: ranks as in suffix_array, but no text
    need fit into a task. rest is the length of the suffix. one_order=True: ranks among the suffixes of all texts; equal suffixes have the same, the number
    of smaller ones.

    Rounds are written to a new folder in the shared folder: twice the places that still share a rank, for 6, 12, 24, ... characters. partitions: of each sort;
    the session's number of shuffle partitions if not given. Empty and null pieces and null ids are left out; an empty table gives an empty result."""
    rounds = Doubling(pieces, partitions, one_order)
    left = F.when(F.col("left_point") >= 0, F.decode(F.unhex(F.lpad(F.hex("left_point"), 8, "0")), "UTF-32")).otherwise("")
    return rounds.ranks(len(rounds.levels) - 1).select("text_id", "rank", "pos", left.alias("left"), "rest")


def neighbours_of_other_texts(ordered: DataFrame, partitions: int) -> DataFrame:
    """(text_id, pos, above, below) for rows (text_id, pos, rank) of one order: the nearest places (text_id, pos) of other texts in the order, null where there is none.

    Ranges of ranks are partitions. In one, the row before the stretch of rows of one text is the nearest above for all of it; for the first stretch, and
    for the last one's below, the lines of the other partitions tell."""
    spark = ordered.sparkSession
    order = ["rank", "text_id", "pos"]
    rows = cut(ordered.select(*order).repartitionByRange(partitions, *order).withColumn("part", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("part").orderBy(*order)
    row = F.struct("text_id", "pos")
    held = rows.withColumn("row", row).withColumn("up", F.lag("row").over(w)).withColumn("down", F.lead("row").over(w))
    up, down = (F.when(F.col(f"{c}.text_id") != F.col("text_id"), F.col(c)) for c in ("up", "down"))
    held = held.withColumn("above", F.last(up, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("below", F.first(down, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    held = cut(held.select("part", "text_id", "pos", "rank", "above", "below"), "nearest")
    key = F.struct(*order)
    ends = held.groupBy("part").agg(F.min_by(row, key).alias("first"), F.max_by(row, key).alias("last"), F.min_by("below", key).alias("first_below"), F.max_by("above", key).alias("last_above"))
    lines = sorted(ends.collect(), key=lambda r: r["part"])  # one for each partition

    def carried(lines, one: str, two: str) -> dict:
        """For each partition the nearest two rows of different texts before it."""
        out, near, far = {}, None, None
        for r in lines:
            out[r["part"]] = near, far
            second = r[two] or (near if near and near["text_id"] != r[one]["text_id"] else far)
            near, far = r[one], second
        return out

    before, after = carried(lines, "last", "last_above"), carried(lines[::-1], "first", "first_below")
    pick = lambda pair, text: next(((x["text_id"], x["pos"]) for x in pair if x and x["text_id"] != text), None)
    place = "struct<text_id: long, pos: long>"
    known = spark.createDataFrame([(r["part"], pick(before[r["part"]], r["first"]["text_id"]), pick(after[r["part"]], r["last"]["text_id"])) for r in lines], f"of int, from_before {place}, from_after {place}")
    met = held.join(F.broadcast(known), F.col("part") == F.col("of"))
    return met.select("text_id", "pos", F.coalesce("above", "from_before").alias("above"), F.coalesce("below", "from_after").alias("below"))


def matches_anywhere(pieces: DataFrame, asked: Column | None = None, partitions: int | None = None) -> DataFrame:
    """(text_id, pos, len) for each place of the texts that `asked` (a test of text_id; all texts if not given) holds for: the longest string there that some other
    text of the table holds, too. All texts are in one order, so their number costs no more than their length: of all suffixes of other texts, the nearest above
    or below agrees with a suffix for longest. pieces are as in pieced_suffix_array."""
    rounds = Doubling(pieces, partitions, one_order=True)
    near = neighbours_of_other_texts(rounds.ranks(len(rounds.levels) - 1), rounds.partitions)
    near = cut(near.where(asked) if asked is not None else near, "asked")
    sides = near.select("text_id", "pos", F.explode(F.array("above", "below")).alias("b")).where("b is not null")
    pairs = sides.select(F.col("text_id").alias("a_text"), F.col("pos").alias("a_pos"), F.col("b.text_id").alias("b_text"), F.col("b.pos").alias("b_pos"))
    best = rounds.common_prefixes(pairs).groupBy(F.col("a_text").alias("text_id"), F.col("a_pos").alias("pos")).agg(F.max("lcp").alias("len"))
    return near.select("text_id", "pos").join(best, ["text_id", "pos"], "left").select("text_id", "pos", F.coalesce("len", F.lit(0)).alias("len"))
