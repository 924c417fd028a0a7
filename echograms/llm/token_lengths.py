"""Token counts: an exact histogram of encoded lengths, with suffix sums that answer every context limit."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echograms.llm.runtime import cut
from echograms.llm.tokens import VOCABULARY, encoder, read_vocabulary

BLOCK = 256


def _lengths(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, counts = encoder(vocabulary.value), Counter()
        for batch in batches:
            counts.update(enc.count(t) if t else 0 for t in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["n_tokens", "n_docs"])

    return run


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens, n_docs) for every encoded length that occurs. Null and empty texts have 0 tokens; repeated rows count each; no rows, no lengths."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    return docs.select(docs[f"`{text}`"].alias("text")).mapInArrow(_lengths(ranks), "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def context_report(histogram: DataFrame) -> DataFrame:
    """For every length L that occurs: n_docs of that length; docs_longer and tokens_longer of the documents above L; truncated_total, the tokens
    that stay when every document is cut to L; share_within, the share of documents of at most L (so quantile q is the least L whose share is at least q).

    Suffix sums run inside blocks of lengths; only one row for each block meets in one task."""
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    per = per.select("block", zero(F.sum("d").over(above)).alias("d_above"), zero(F.sum("t").over(above)).alias("t_above"), F.sum("d").over(whole).alias("all_docs"), F.sum("t").over(whole).alias("all_tokens"))
    inner = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    full = h.join(per, "block").withColumn("docs_longer", F.col("d_above") + zero(F.sum("n_docs").over(inner))).withColumn("tokens_longer", F.col("t_above") + zero(F.sum("tokens").over(inner)))
    truncated = F.col("all_tokens") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")
    return full.select("n_tokens", "n_docs", "docs_longer", "tokens_longer", truncated.alias("truncated_total"), ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("share_within"))


def context_limits(report: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_longer, tokens_longer, truncated_total) for each of some limits, whether such a length occurs or not, from the row of context_report
    that is next below. No rows in the report, no rows here."""
    facts = F.struct("n_tokens", "n_docs", "docs_longer", "tokens_longer", "truncated_total")
    below = [F.max(F.when(F.col("n_tokens") <= at, facts)).alias(f"b{i}") for i, at in enumerate(limits)]
    row = report.agg(F.min(facts).alias("least"), *below)
    least = F.col("least")
    every = least["docs_longer"] + least["n_docs"]

    def answer(at, found):
        longer, tokens = F.coalesce(found["docs_longer"], every), F.coalesce(found["tokens_longer"], least["tokens_longer"] + least["n_tokens"] * least["n_docs"])
        total = least["truncated_total"] - least["n_tokens"] * least["docs_longer"] + least["tokens_longer"]  # all tokens
        return F.struct(F.lit(at).cast("long").alias("context_limit"), longer.alias("docs_longer"), tokens.alias("tokens_longer"), (total - tokens + at * longer).alias("truncated_total"))

    return row.where("least is not null").select(F.inline(F.array(*[answer(at, F.col(f"b{i}")) for i, at in enumerate(limits)])))


def length_quantiles(report: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least this share of the documents does not exceed. No rows in the report: null lengths."""
    found = [F.struct(F.lit(float(q)).alias("share"), F.min(F.when(F.col("share_within") >= q, F.col("n_tokens"))).alias("n_tokens")) for q in shares]
    return report.agg(F.array(*found).alias("x")).select(F.inline("x"))


def op10_token_lengths(spark, sf_dir: str) -> DataFrame:
    """context_report of all documents: null and empty texts have 0 tokens, repeated rows count each, other columns are ignored, an empty table gives an
    empty result."""
    return context_report(cut(length_histogram(spark.read.parquet(f"{sf_dir}/documents.parquet")), "lengths"))
