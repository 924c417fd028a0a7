"""Ways to write patterns out: triples, readable rows, tracked rows, statistics. Each returns a DataFrame of what is written; writers take a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echograms.operators.repeats import occurrences, one_sided
from echograms.sources.texts import to_real


def triples(repeats: DataFrame) -> DataFrame:
    """(text_id, len, first_rank, occs)."""
    return repeats.select("text_id", "len", "first_rank", "occs")


def write_triples(repeats: DataFrame, folder: str, as_text: bool = False) -> None:
    """Parquet, or lines of three numbers."""
    rows = triples(repeats)
    if as_text:
        rows.select(F.concat_ws(" ", "len", "first_rank", "occs").alias("value")).write.text(folder)
    else:
        rows.write.parquet(folder)


def readable(repeats: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(text_id, pattern, len, places): places are the positions in order of rank."""
    ranks = repeats.select("text_id", "pattern", "len", "first_rank", F.explode(F.sequence("first_rank", F.col("first_rank") + F.col("occs") - 1)).alias("rank"))
    rows = ranks.join(suffixes.select("text_id", "rank", "pos"), ["text_id", "rank"])
    listed = rows.groupBy("text_id", "pattern", "len").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "pos"))), lambda x: x["pos"]).alias("places"))
    return listed


def write_readable(repeats: DataFrame, suffixes: DataFrame, folder: str) -> None:
    """Lines like: pattern (length) #places."""
    rows = readable(repeats, suffixes)
    rows.select(F.concat(F.col("pattern"), F.lit(" ("), F.col("len"), F.lit(") #"), F.array_join(F.transform("places", lambda p: p.cast("string")), " ")).alias("value")).write.text(folder)


def patterns_only(repeats: DataFrame) -> DataFrame:
    return repeats.select(F.col("pattern").alias("value"))


def tracked(repeats: DataFrame, suffixes: DataFrame, trace: DataFrame) -> DataFrame:
    """(text_id, len, first_rank, pos, real): occurrences with their places in the text before its gaps were collapsed."""
    rows = occurrences(repeats, suffixes)
    real = to_real(rows.select("text_id", "pos").distinct(), trace)
    return rows.join(real, ["text_id", "pos"]).select("text_id", "len", "first_rank", "pos", "real")


def side_statistics(pair_repeats: DataFrame) -> DataFrame:
    """(len, occs, patterns, n_left, n_right)."""
    return pair_repeats.groupBy("len", "occs").agg(F.count("*").alias("patterns"), F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"))


COLUMNS = 2000


def matrix(distances: DataFrame, measure: str, ids: list[int]) -> DataFrame:
    """A row for each text and a column for each of ids, at most COLUMNS of them, from (base_id, other_id, measure) with every pair once, in either order."""
    if len(ids) > COLUMNS:
        raise ValueError(f"a table has at most {COLUMNS} columns; write the pairs themselves")
    both = distances.select("base_id", "other_id", measure).union(distances.select("other_id", "base_id", measure))
    return both.groupBy("base_id").pivot("other_id", ids).agg(F.first(measure))


def write_sides(pair_repeats: DataFrame, folder: str, side: str = "all", least: int = 1) -> None:
    """Lines of length, occurrences on the left, occurrences on the right and pattern: repeats of at least that length on one side, both or all."""
    rows = one_sided(pair_repeats, side).where(F.col("len") >= least)
    rows.select(F.concat_ws("\t", "len", "n_left", "n_right", "pattern").alias("value")).write.text(folder)


def nothing(df: DataFrame) -> None:
    """Run df and keep nothing, for timing."""
    df.write.format("noop").mode("overwrite").save()
