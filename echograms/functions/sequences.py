"""Column functions on sequences: complements, four-letter codes, gaps and headers, differences, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the alphabet of the four-letter code, in the order of its digits.
LETTERS = "ACGNT"


def as_dna(text: Column) -> Column:
    """Any text as a sequence over ACGTN: lower-cased letters a to z map to the letters ACGTN in turn, all else is dropped."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), letters, ("ACGTN" * 6)[:26])


def reverse_complement(seq: Column) -> Column:
    """A, C, G and T are complemented, other characters kept, and the order is reversed."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def with_reverse_complement(seq: Column) -> Column:
    return F.concat_ws("N", seq, reverse_complement(seq))


def four_letter_codes(seq: Column) -> Column:
    """A code of 0 to 249 for every position: its letter, the next two, and one bit of the third, in base 5, 5, 5, 2; the sequence is circular."""
    circular = F.concat(seq, seq, seq, seq)
    digit = lambda i: F.instr(F.lit(LETTERS), F.substring(circular, i, F.lit(1))) - 1
    code = lambda i: (((digit(i) * 5 + digit(i + 1)) * 5 + digit(i + 2)) * 2 + F.shiftright(digit(i + 3), 2) % 2).cast("long")
    return F.when(F.length(seq) > 0, F.transform(F.sequence(F.lit(1), F.length(seq)), code)).otherwise(F.array().cast("array<long>"))


def from_four_letter_codes(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.substring(F.lit(LETTERS), (F.floor(c / 50) + 1).cast("int"), F.lit(1))), "")


def piece_at(text: Column, pos: int, size: int) -> Column:
    """`size` letters from letter number pos on, not counting a header line or white space."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^>[^\n]*(\n|$)", ""), r"\s", "")
    return F.substring(bare, F.lit(pos + 1), F.lit(size))


def joined(texts: DataFrame, separator: str = "~", parts: int | None = None) -> DataFrame:
    """(part, text_id, piece) in order: the pieces that make up all texts in order of id with a separator between them, each in a partition of its own range
    of ids, so that writing the pieces one after the other writes the joined text. The first text of all has no separator before it. Null texts are empty. For export only; a
    search keeps texts apart."""
    first = texts.agg(F.min("text_id").alias("least"))
    body = F.coalesce("body", F.lit(""))
    piece = F.when(F.col("text_id") == F.col("least"), body).otherwise(F.concat(F.lit(separator), body))
    ordered = texts.join(F.broadcast(first), F.col("text_id") >= F.col("least"))  # one row
    ranged = ordered.repartitionByRange(parts, "text_id") if parts else ordered.repartitionByRange("text_id")
    return ranged.sortWithinPartitions("text_id").select(F.spark_partition_id().alias("part"), "text_id", piece.alias("piece"))


def headers(texts: DataFrame) -> DataFrame:
    """(text_id, offset, header): the header lines of multi-FASTA texts with their place in the text."""
    sizes = F.transform(F.split("body", "\n", -1), lambda x: F.struct((F.length(x) + 1).cast("long").alias("n"), F.when(x.startswith(">"), x).alias("header")))
    line = texts.select("text_id", F.posexplode(sizes).alias("line", "part")).select("text_id", "line", "part.*")  # of the texts only headers go into the window
    w = Window.partitionBy("text_id").orderBy("line")
    return line.withColumn("offset", F.sum("n").over(w) - F.col("n")).where("header is not null").select("text_id", "offset", "header")


def masked_headers(text: Column) -> Column:
    """Every header line as N of the same length; its line end stays."""
    parts = F.regexp_extract_all(F.concat(F.lit("\n"), text), F.lit(r"(\n>[^\n]*|\n?[^\n]+|\n)"), F.lit(0))
    marked = F.transform(parts, lambda x: F.when(x.startswith("\n>"), F.concat(F.lit("\n"), F.repeat(F.lit("N"), F.length(x) - 1))).otherwise(x))
    return F.substring(F.array_join(marked, ""), F.lit(2), F.length(text))


def with_headers(masked: DataFrame, lines: DataFrame) -> DataFrame:
    """(text_id, body): masked texts with the header lines (text_id, offset, header) back in their places."""
    listed = lines.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("offset", "header"))).alias("hs"))
    put = lambda acc, h: F.overlay(acc, h["header"], (h["offset"] + 1).cast("int"))
    return masked.join(listed, "text_id", "left").select("text_id", F.when(F.col("hs").isNull(), F.col("body")).otherwise(F.aggregate("hs", F.col("body"), put)).alias("body"))


def kept_intervals(texts: DataFrame, intervals: DataFrame, separator: str = "N") -> DataFrame:
    """(text_id, body): the parts of each text inside any of its intervals (text_id, start, end, both included), a separator between parts."""
    w = Window.partitionBy("text_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    starts = intervals.withColumn("new", F.coalesce((F.col("start") > F.max("end").over(w) + 1).cast("int"), F.lit(1)))
    runs = starts.withColumn("run", F.sum("new").over(Window.partitionBy("text_id").orderBy("start", "end"))).groupBy("text_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    parts = runs.join(texts, "text_id").select("text_id", F.struct("start", F.substring("body", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start") + 1).cast("int")).alias("part")).alias("x"))
    return parts.groupBy("text_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["part"]), separator).alias("body"))


def letter_changes(pairs: DataFrame) -> DataFrame:
    """(text_id, letter, total, lost, gained) for texts (text_id, body, other) of equal length, compared place by place."""
    n = F.least(F.length("body"), F.length("other"))
    rows = pairs.where(n > 0).select("text_id", F.explode(F.arrays_zip(F.split(F.left("body", n), "").alias("a"), F.split(F.left("other", n), "").alias("b"))).alias("x"))
    sides = rows.select("text_id", F.explode(F.array(F.struct(F.col("x.a").alias("letter"), F.lit(1).alias("total"), (F.col("x.a") != F.col("x.b")).cast("int").alias("lost"), F.lit(0).alias("gained")), F.struct(F.col("x.b").alias("letter"), F.lit(0).alias("total"), F.lit(0).alias("lost"), (F.col("x.a") != F.col("x.b")).cast("int").alias("gained")))).alias("s"))
    return sides.groupBy("text_id", "s.letter").agg(F.sum("s.total").alias("total"), F.sum("s.lost").alias("lost"), F.sum("s.gained").alias("gained"))


def binary_digits(n: Column) -> Column:
    """Number of binary digits of a whole number, 0 for 0."""
    return F.when(n > 0, F.length(F.bin(n.cast("long")))).otherwise(0)
