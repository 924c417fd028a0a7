"""Files of any size, read by byte ranges: records and characters that cross an edge belong to the range they begin in, and no file is ever whole in a task.

Every function takes a file or a folder (whose files below it, but for names that begin with . or _, are read in order of their paths) and gives each file the
number text_id, from 0 in that order; `files` names them. The data source opens files by pyarrow's file systems: local and mounted paths, hdfs, s3, gs, abfs.
Ranges have a fixed number of bytes, so that two passes over a file, and tasks that are run again, cut it alike. Packed files (.gz, .bz2) cannot be entered in
the middle: `texts.whole_files` reads them. Bytes that are not UTF-8 are read as U+FFFD.

Numbers and places that hold for a whole file take a first pass that leaves a count for each range; running sums of these are joined to what the second pass
reads, so texts are read twice and never shuffled up to BROADCAST_RANGES ranges (64 TB); beyond, by the session's joins."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from echograms.sources.shared import cut
from echograms.sources.texts import parse_slice

RANGE = 64 << 20  # bytes of a range
BLOCK = 4 << 20  # bytes that are read, and left in one batch, at a time
BROADCAST_RANGES = 1_000_000  # of 24 bytes each

SCHEMAS = {
    "files": "text_id long, path string, size long",
    "records": "text_id long, part long, at long, body string, ended boolean",
    "record_counts": "text_id long, part long, n long",
    "text": "text_id long, part long, at long, body string",
    "text_counts": "text_id long, part long, n long, dropped long",
}
CONTINUED = bytes(range(0x80, 0xC0))  # bytes of a character after its first


class Range(InputPartition):
    def __init__(self, text: int, part: int, path: str, size: int, start: int, stop: int):
        self.text, self.part, self.path, self.size, self.start, self.stop = text, part, path, size, start, stop


def record_blocks(file, start: int, stop: int, separator: bytes) -> Iterator[list[tuple[bytes, bool]]]:
    """Lists of (record, whether a separator ends it), for the records that begin from start to stop - 1. One begins at 0 and after every separator."""
    at = max(0, start - len(separator)) if start else 0
    file.seek(at)
    data, seen, ahead = bytearray(), 0, bool(start)  # seen: bytes without a separator; ahead: the first record of the range has not begun
    while at < stop:
        more = file.read(BLOCK)
        data += more
        if more and data.find(separator, seen) < 0:
            if ahead:
                past = max(0, len(data) - len(separator) + 1)
                at += past
                del data[:past]
            seen = max(0, len(data) - len(separator) + 1)
            continue
        *whole, data = data.split(separator)
        seen, found = max(0, len(data) - len(separator) + 1), []
        for record in whole:
            if at >= stop:
                break
            if not ahead:
                found.append((record, True))
            at, ahead = at + len(record) + len(separator), False
        if not more and not ahead and at < stop:
            found.append((data, False))
        if found:
            yield found
        if not more:
            return


def records_begun(file, start: int, stop: int, separator: bytes) -> int:
    """How many records begin from start to stop - 1."""
    at, n, carried = max(0, start - len(separator)), int(start == 0), b""
    file.seek(at)
    while at < stop - 1:
        more = file.read(min(BLOCK, stop - 1 - at))
        if not more:
            break
        at += len(more)
        carried += more
        n += carried.count(separator)
        carried = carried[max(0, len(carried) - len(separator) + 1) :]
    return n


def header_end(file) -> int:
    """Where the text begins: behind a first line that begins with >, else 0."""
    file.seek(0)
    data = file.read(1)
    if data != b">":
        return 0
    at = 1
    while data:
        data = file.read(1 << 12)
        end = data.find(b"\n")
        if end >= 0:
            return at + end + 1
        at += len(data)
    return at


def text_blocks(file, start: int, stop: int, keep: bytes) -> Iterator[tuple[str, int]]:
    """(text, characters dropped) of the blocks from start to stop - 1: all characters that begin there, or, if keep is given, those of a FASTA file, behind its
    header, that are kept; line ends do not count as dropped."""
    first = header_end(file) if keep else 0
    unkept = bytes(b for b in range(256) if b not in keep)
    for lo in range(max(start, first), stop, BLOCK):
        hi = min(lo + BLOCK, stop)
        file.seek(lo)
        data = file.read(hi - lo + 3)
        if keep:
            data = data[: hi - lo]
            yield data.translate(None, unkept).decode(), len(data.translate(None, keep + b"\n" + CONTINUED))
            continue
        edges = []  # up to three bytes of a character that began before the edge go with it
        for edge in (0, hi - lo):
            rest = data[edge : edge + 3]
            edges.append(min(edge, len(data)) + len(rest) - len(rest.lstrip(CONTINUED)))
        yield data[edges[0] if lo else 0 : edges[1]].decode("utf-8", "replace"), 0


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.rows = options.get("rows", "records")
        self.separator, self.keep = options.get("separator", "\n").encode(), options.get("keep", "").encode()

    def listed(self) -> list[tuple[str, int]]:
        system, path = fs.FileSystem.from_uri(self.options["path"])
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.options["path"])
        found = [info]
        if info.type == fs.FileType.Directory:
            inner = system.get_file_info(fs.FileSelector(path, recursive=True))
            found = [f for f in inner if f.type == fs.FileType.File and not re.search(r"/[._]", f.path[len(path) :])]
        packed = [f.path for f in found if f.path.endswith((".gz", ".bz2"))]
        if packed:
            raise ValueError(f"{packed[0]} is packed and cannot be read by ranges; use whole_files")
        return sorted((f.path, f.size) for f in found)

    def partitions(self) -> list[Range]:
        size, found = int(self.options.get("range", RANGE)), self.listed()
        if self.rows == "files":
            return [Range(i, 0, path, n, 0, 0) for i, (path, n) in enumerate(found)] or [Range(-1, 0, "", 0, 0, 0)]
        lo, hi = int(self.options.get("first", 0)), self.options.get("last")
        ranges = []
        for text, (path, n) in enumerate(found):
            parts = max(1, -(-n // size))
            for part in range(lo, parts if hi is None else min(parts, int(hi) + 1)):
                # behind a last separator there is one more, empty, record: the last range goes one beyond the file
                ranges.append(Range(text, part, path, n, part * size, n + 1 if part == parts - 1 else (part + 1) * size))
        return ranges or [Range(-1, 0, "", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        p, names = partition, [c.split()[0] for c in SCHEMAS[self.rows].split(", ")]
        if p.text < 0:
            return
        if self.rows == "files":
            yield pa.RecordBatch.from_pydict({"text_id": [p.text], "path": [p.path], "size": [p.size]})
            return
        system, _ = fs.FileSystem.from_uri(self.options["path"])
        with system.open_input_file(p.path) as file:
            if self.rows == "record_counts":
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (p.text, p.part, records_begun(file, p.start, p.stop, self.separator))], names)
            elif self.rows == "text_counts":
                n = dropped = 0
                for text, out in text_blocks(file, p.start, min(p.stop, p.size), self.keep):
                    n, dropped = n + len(text), dropped + out
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (p.text, p.part, n, dropped)], names)
            else:
                at = 0
                blocks = record_blocks(file, p.start, p.stop, self.separator) if self.rows == "records" else text_blocks(file, p.start, min(p.stop, p.size), self.keep)
                for block in blocks:
                    bodies = [r.decode("utf-8", "replace") for r, _ in block] if self.rows == "records" else [block[0]] if block[0] else []
                    columns = [pa.array([p.text] * len(bodies), pa.int64()), pa.array([p.part] * len(bodies), pa.int64()), pa.array(range(at, at + len(bodies)) if self.rows == "records" else [at] * len(bodies), pa.int64()), pa.array(bodies, pa.string())]
                    if self.rows == "records":
                        columns.append(pa.array([ended for _, ended in block]))
                    at += len(bodies) if self.rows == "records" else len(block[0])
                    yield pa.RecordBatch.from_arrays(columns, names)


class ByteRanges(DataSource):
    """Format "byte_ranges". Options: path; rows, a key of SCHEMAS; range, bytes of a range; separator, one character; keep, the characters of a FASTA file;
    first, last: the numbers of the ranges of each file that are read."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("rows", "records")]

    def reader(self, schema) -> RangeReader:
        return RangeReader(dict(self.options))


def load(spark: SparkSession, path: str, rows: str, **options) -> DataFrame:
    if len(str(options.get("separator", "\n"))) != 1 or not str(options.get("keep", "")).isascii():
        raise ValueError("a separator is one character, and characters to keep are ASCII")
    spark.dataSource.register(ByteRanges)
    return spark.read.format("byte_ranges").options(rows=rows, **options).load(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(text_id, path, size): the files at path."""
    return load(spark, path, "files")


def _numbered(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows with first, what their file counts before their range."""
    w = Window.partitionBy("text_id").orderBy("part")
    firsts = cut(counts.select("text_id", "part", (F.sum("n").over(w) - F.col("n")).alias("first")), "ranges")
    return rows.join(F.broadcast(firsts) if firsts.count() <= BROADCAST_RANGES else firsts, ["text_id", "part"])


def records(spark: SparkSession, path: str, separator: str = "\n", size: int = RANGE) -> DataFrame:
    """(text_id, record, body, ended): all records of each file with their numbers. What follows the last separator, be it empty, is one more, not ended."""
    options = {"separator": separator, "range": size}
    rows = _numbered(load(spark, path, "records", **options), load(spark, path, "record_counts", **options))
    return rows.select("text_id", (F.col("first") + F.col("at")).alias("record"), "body", "ended")


def fastq_records(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(text_id, read, body): the second line of every four, as `texts.fastq_records` gives them of whole texts."""
    return records(spark, path, "\n", size).where("record % 4 = 1").select("text_id", F.floor(F.col("record") / 4).alias("read"), "body")


def text_pieces(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(text_id, piece, body): the whole text of each file in pieces; piece is the place of their first character, so operators on pieces can use them in order."""
    return _pieces(spark, path, {"range": size})


def fasta_pieces(spark: SparkSession, path: str, keep: str = "ACGTN", size: int = RANGE) -> DataFrame:
    """(text_id, piece, body): each file as `texts.fasta_body` gives it, in pieces; piece is the place of their first character in what is kept. A name that
    ends in a slice, as in genome.fa[10K:2M], gives the characters of the slice, with their places in the whole, from the ranges that hold them."""
    name, start, stop = parse_slice(path)
    return _pieces(spark, name, {"range": size, "keep": keep}, start or 0, stop)


def _pieces(spark: SparkSession, path: str, options: dict, start: int = 0, stop: int | None = None) -> DataFrame:
    counts = load(spark, path, "text_counts", **options)
    if start or stop is not None:
        w = Window.partitionBy("text_id").orderBy("part")
        first = F.col("last") - F.col("n")
        held = cut(counts.withColumn("last", F.sum("n").over(w)).where((F.col("last") > start) & ((first < stop) if stop is not None else F.lit(True)) & (F.col("n") > 0)), "slices")
        low, high = held.agg(F.min("part"), F.max("part")).first()
        if low is None or stop is not None and stop <= start:
            return spark.createDataFrame([], "text_id long, piece long, body string")
        options = options | {"first": low, "last": high}
        firsts = held.select("text_id", "part", first.alias("first"))
        pieces = load(spark, path, "text", **options)
        pieces = pieces.join(F.broadcast(firsts) if firsts.count() <= BROADCAST_RANGES else firsts, ["text_id", "part"])
    else:
        pieces = _numbered(load(spark, path, "text", **options), counts)
    placed = pieces.select("text_id", (F.col("first") + F.col("at")).alias("piece"), "body")
    if not start and stop is None:
        return placed
    skipped = F.greatest(F.lit(start) - F.col("piece"), F.lit(0))
    wanted = F.length("body") if stop is None else F.least(F.lit(stop) - F.col("piece"), F.length("body")) - skipped
    part = F.substring("body", (skipped + 1).cast("int"), F.greatest(wanted, F.lit(0)).cast("int"))
    return placed.select("text_id", (F.col("piece") + skipped).alias("piece"), part.alias("body")).where("body <> ''")


def fasta_lengths(spark: SparkSession, path: str, keep: str = "ACGTN", size: int = RANGE) -> DataFrame:
    """(text_id, kept, dropped): characters of each FASTA file that are kept, and those that are not, header and line ends aside."""
    counts = load(spark, path, "text_counts", range=size, keep=keep)
    return counts.groupBy("text_id").agg(F.sum("n").alias("kept"), F.sum("dropped").alias("dropped"))
