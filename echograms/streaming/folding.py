"""Matches of base texts with texts that keep coming: a stored fold, extended batch by batch.

Each micro-batch is compared with the bases that its rows name and leaves, for each place of a base, the least and largest longest match, in a folder of its
own by its number: a batch that is run again replaces itself. The fold is the least of the least and the largest of the largest, so the order of
batches makes no difference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from echograms.operators.sets import pair_statistics

FOLD = "base_id long, pos long, held_by_all long, held_by_any long, texts long"


def fold_batch(bases: DataFrame, folder: str):
    """A function for foreachBatch that folds rows (base_id, text_id, body) into the fold of folder; bases are (text_id, body)."""

    def write(batch: DataFrame, number: int) -> None:
        bases_here = bases.select(F.col("text_id").alias("of"), F.col("body").alias("base"))
        pairs = batch.where("text_id is not null").select("base_id", "text_id", "body").join(bases_here, F.col("base_id") == F.col("of"))
        found = pair_statistics(pairs.select("base_id", F.col("text_id").alias("other_id"), "base", F.col("body").alias("other")))
        fold = found.groupBy("base_id", "pos").agg(F.min("len").alias("held_by_all"), F.max("len").alias("held_by_any"), F.count("*").alias("texts"))
        fold.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def fold_stream(texts: DataFrame, bases: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Start a query that folds a stream of rows (base_id, text_id, body) into folder, all that is there now in micro-batches, and ends; started again with the
    same checkpoint, it takes what is new. Null texts are empty; rows whose base is not there are left out."""
    return texts.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(fold_batch(bases, folder)).start()


def stored_fold(spark: SparkSession, folder: str) -> DataFrame:
    """(base_id, pos, held_by_all, held_by_any, texts): at each place of each base, how long a string all of the texts so far hold, and any of them, and how
    many texts these are."""
    rows = spark.read.schema(FOLD).parquet(folder)
    return rows.groupBy("base_id", "pos").agg(F.min("held_by_all").alias("held_by_all"), F.max("held_by_any").alias("held_by_any"), F.sum("texts").alias("texts"))
