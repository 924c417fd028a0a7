"""Texts from files and from columns: whole files, lines, separated records, FASTA and FASTQ, gaps with a position trace, stored sections."""

from __future__ import annotations

import bz2
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

GAP_BYTES, BLOCK_BITS, STRETCH = 4 << 20, 6, 1 << 16


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, body) of each file, as UTF-8; files that end in .gz or .bz2 are decompressed on the executors. If there is nothing at path, path.gz is read."""
    try:
        files = spark.read.format("binaryFile").load(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.read.format("binaryFile").load(f"{path}.gz")

    def unpacked(name: str, content: bytes) -> bytes:
        return zlib.decompress(content, 47) if name.endswith(".gz") else bz2.decompress(content) if name.endswith(".bz2") else content

    def read(batches):
        for batch in batches:
            raw = [unpacked(p, c) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.decode("utf-8", "replace") for r in raw])], ["path", "body"])

    return files.select("path", "content").mapInArrow(read, "path string, body string")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) for each line; the codec follows the file's extension."""
    return spark.read.text(path)


def records(texts: DataFrame, separator: str = "\n") -> DataFrame:
    """(text_id, record, body) for each record that a separator ends; what follows the last separator is not a record."""
    parts = texts.select("text_id", F.split("body", re.escape(separator), -1).alias("p"))
    return parts.select("text_id", F.posexplode(F.slice("p", F.lit(1), F.size("p") - 1)).alias("record", "body")).withColumn("record", F.col("record").cast("long"))


def fastq_records(texts: DataFrame) -> DataFrame:
    """(text_id, read, body): the second line of every four; lines count whether or not the last one is ended."""
    parts = texts.where("body is not null").select("text_id", F.posexplode(F.split("body", "\n", -1)).alias("line", "body"))
    return parts.where("line % 4 = 1").select("text_id", F.floor(F.col("line") / 4).alias("read"), "body")


def fastq_summary(reads: DataFrame) -> DataFrame:
    """(count, avg_len) over all reads."""
    return reads.agg(F.count("*").alias("count"), F.avg(F.length("body")).alias("avg_len"))


def fasta_body(text: Column, keep: str = "ACGTN") -> Column:
    """A FASTA text without its header line and without any character that is not kept."""
    bare = F.regexp_replace(text, r"^>[^\n]*(\n|$)", "")
    return F.regexp_replace(bare, f"[^{keep}]", "")


_SLICE = re.compile(r"^(.*?)(?:\[(\d*)([KMGT]?)(?:i?)(:)(\d*)([KMGT]?)\])?$", re.I)
_UNITS = {"": 1, "K": 10**3, "M": 10**6, "G": 10**9, "T": 10**12}


def parse_slice(name: str) -> tuple[str, int | None, int | None]:
    """(path, from, to) of a name like file.fa[10K:2M]; None where a bound is left out."""
    path, a, au, colon, b, bu = _SLICE.match(name).groups()
    number = lambda x, u: int(x) * _UNITS[u.upper()] if x else None
    return (path, number(a, au or ""), number(b, bu or "")) if colon else (name, None, None)


def sliced(text: Column, start: int | None, stop: int | None) -> Column:
    start = start or 0
    return F.substring(text, F.lit(start + 1), F.lit(stop - start) if stop is not None else F.length(text))


def _gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of N of some texts at once, from their UTF-8 bytes; a character counts where its first byte is."""
    for batch in batches:
        column = batch.column(1).cast(pa.large_string())
        edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        row = 0
        while row < len(column):
            after = max(row + 1, int(np.searchsorted(edges, edges[row] + GAP_BYTES, side="right")) - 1)
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[edges[row] : edges[after]]
            bounds = edges[row : after + 1] - edges[row]
            mark = np.zeros(len(data) + 1, dtype=bool)  # where a run may begin or end: beside a change, and between texts
            hole = data == ord("N")
            mark[1:-1] = hole[1:] != hole[:-1]
            mark[bounds] = True
            cuts = np.flatnonzero(mark)
            start, stop = cuts[:-1], cuts[1:]
            gap = hole[start]
            start, stop = start[gap], stop[gap]
            owner = np.searchsorted(bounds, start, side="right") - 1
            if len(data) and data.max() >= 0x80:
                before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            else:
                before = np.arange(len(data) + 1)
            size = stop - start
            kept = np.where(size <= 2, size, 2 + np.frexp((size - 2).astype(np.float64))[1])  # the exponent is the number of binary digits
            ids = batch.column(0).slice(row).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([ids, pa.array(before[start] - before[bounds[owner]], pa.int64()), pa.array(size, pa.int64()), pa.array(kept, pa.int64())], ["text_id", "start", "len", "kept"])
            row = after


def n_runs(texts: DataFrame) -> DataFrame:
    """(text_id, start, len, kept): the runs of N of each text, and how many of them stay when gaps are collapsed: all of one or two, else 2 plus
    the number of binary digits of the rest. One map pass."""
    return texts.select("text_id", "body").mapInArrow(_gaps, StructType([texts.schema["text_id"], *StructType.fromDDL("start long, len long, kept long")]))


def kept_of_run(n: Column) -> Column:
    return F.when(n <= 2, n).otherwise(2 + F.length(F.bin((n - 2).cast("long"))))


def collapse_runs(text: Column) -> Column:
    """text with every run of N collapsed as n_runs says."""
    parts = F.filter(F.regexp_extract_all(text, F.lit("N+|[^N]+"), F.lit(0)), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.when(x.startswith("N"), F.repeat(F.lit("N"), kept_of_run(F.length(x)).cast("int"))).otherwise(x)), "")


def gap_trace(runs: DataFrame, texts: DataFrame) -> DataFrame:
    """(text_id, virt_start, shift): from virt_start on, a position of the collapsed text is shift less than in the text itself. Only runs of at
    least five N are traced; each text has the entry (0, 0)."""
    w = Window.partitionBy("text_id").orderBy("start")
    lost = F.col("len") - F.col("kept")
    runs = runs.where("len >= 5 or len <> kept")  # a run that keeps all its places moves nothing
    moved = runs.withColumn("lost", F.sum(lost).over(w)).withColumn("virt_start", F.col("start") - (F.col("lost") - lost) + 2)
    traced = moved.withColumn("shift", F.sum(F.when(F.col("len") >= 5, lost).otherwise(0)).over(w)).where("len >= 5")
    first = texts.select("text_id", F.lit(0).cast("long").alias("virt_start"), F.lit(0).cast("long").alias("shift"))
    return traced.select("text_id", "virt_start", "shift").union(first)


def _as_of(points: DataFrame, events: DataFrame, at: str, when: str) -> DataFrame:
    """points with shift and lag of the last event that is not after them, null where there is none.

    The events of a text are one row, in lists by blocks of 2^BLOCK_BITS places, each led by the last event before its block. A point meets its text's row and looks at
    one list, so points are neither sorted nor laid in windows; where they are dealt by text_id already, they are not shuffled."""
    w = Window.partitionBy("text_id").orderBy("when", "shift")
    block = lambda c: F.shiftright(c, BLOCK_BITS)
    e = events.select("text_id", F.col(when).alias("when"), "shift", "lag").withColumn("next", F.lead("when").over(w))
    last = F.coalesce(block(F.col("next") - 1), block(F.col("when")))
    reached = F.sequence(block(F.col("when")), F.greatest(last, block(F.col("when"))))
    lists = e.select("text_id", F.struct("when", "shift", "lag").alias("event"), F.explode(reached).alias("block")).groupBy("text_id", "block").agg(F.sort_array(F.collect_list("event")).alias("events"))
    rows = lists.groupBy("text_id").agg(F.min("block").alias("first"), F.transform(F.sort_array(F.collect_list(F.struct("block", "events"))), lambda x: x["events"]).alias("lists"))
    here = F.get("lists", F.least(block(F.col(at)) - F.col("first"), F.size("lists") - 1).cast("int"))
    passed = F.try_element_at(F.filter(here, lambda x: x["when"] <= F.col(at)), F.lit(-1))
    alone = (F.size(here) == 1) & (F.get(here, F.lit(0))["when"] <= F.col(at))  # most lists hold one event
    seen = points.select("text_id", at).join(rows.hint("shuffle_hash"), "text_id", "left").withColumn("event", F.when(alone, F.get(here, F.lit(0))).otherwise(passed))
    return seen.select("text_id", at, "event.shift", "event.lag")


def to_real(points: DataFrame, trace: DataFrame) -> DataFrame:
    """(text_id, pos, real): the place in the original text of positions of the collapsed text."""
    found = _as_of(points, trace.withColumn("lag", F.lit(0).cast("long")), "pos", "virt_start")
    return found.select("text_id", "pos", (F.col("pos") + F.col("shift")).alias("real"))


def _traced(trace: DataFrame) -> DataFrame:
    """Trace rows with gap_start, where in the original text the run begins to lose places, and lag, where it has lost them."""
    w = Window.partitionBy("text_id").orderBy("virt_start")
    return trace.withColumn("gap_start", F.col("virt_start") + F.lag("shift", 1, 0).over(w)).withColumn("lag", F.col("virt_start") + F.col("shift"))


def to_virtual(points: DataFrame, trace: DataFrame) -> DataFrame:
    """(text_id, pos, virtual): the place in the collapsed text of positions of the original; null inside what a traced run lost."""
    found = _as_of(points, _traced(trace).select("text_id", "gap_start", "shift", "lag"), "pos", "gap_start")
    return found.select("text_id", "pos", F.when(F.col("pos") >= F.col("lag"), F.col("pos") - F.col("shift")).alias("virtual"))


def _stretches(trace: DataFrame, texts: DataFrame, start: str) -> DataFrame:
    """Trace rows with every pos from their start up to the next row's start, or to the end of the text."""
    w = Window.partitionBy("text_id").orderBy(start)
    ended = trace.withColumn("stop", F.lead(start).over(w)).join(texts.select("text_id", F.length("body").cast("long").alias("n")), "text_id")
    stop = F.least(F.coalesce("stop", "n"), F.col("n"))
    pieces = ended.withColumn("stop", stop).where(F.col(start) < F.col("stop")).withColumn("piece", F.explode(F.sequence(F.col(start), F.col("stop") - 1, F.lit(STRETCH).cast("long"))))
    dealt = pieces.repartition(int(trace.sparkSession.conf.get("spark.sql.shuffle.partitions")), "text_id", "piece")  # before the places are spelled out
    return dealt.withColumn("pos", F.explode(F.sequence("piece", F.least(F.col("piece") + STRETCH, F.col("stop")) - 1)))


def real_places(texts: DataFrame, trace: DataFrame) -> DataFrame:
    """to_real of every position below each text's length: a row of the trace holds for all positions up to the next, so nothing is looked up."""
    return _stretches(trace, texts, "virt_start").select("text_id", "pos", (F.col("pos") + F.col("shift")).alias("real"))


def virtual_places(texts: DataFrame, trace: DataFrame) -> DataFrame:
    """to_virtual of every position of each text, in the same way."""
    return _stretches(_traced(trace), texts, "gap_start").select("text_id", "pos", F.when(F.col("pos") >= F.col("lag"), F.col("pos") - F.col("shift")).alias("virtual"))


def write_section(df: DataFrame, root: str, section: str, *partitions: str, only_given: bool = False) -> None:
    """Store an intermediate result as a table of its own under root. A section that exists is replaced; with only_given=True, and partitions, only those of its
    partitions that df has rows for are, and the files of all others stay as they are."""
    if only_given and not partitions:
        raise ValueError("only a partitioned section can be replaced in part")
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if only_given else "static")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(f"{root}/{section}")


def read_section(spark: SparkSession, root: str, section: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{section}")


def wrapped(text: Column, width: int = 80) -> Column:
    """Lines of at most width characters, for FASTA output."""
    return F.regexp_replace(text, f"(.{{{width}}})(?=.)", "$1\n")


def write_fasta(texts: DataFrame, folder: str, width: int = 80) -> None:
    texts.select(F.concat(F.lit(">"), F.col("text_id").cast("string"), F.lit("\n"), wrapped(F.col("body"), width)).alias("value")).write.text(folder)
