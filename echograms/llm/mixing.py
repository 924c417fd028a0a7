"""Mixing sources to target weights: exact block quotas per source, dealt to output shards by a splitting tree. DataFrame functions only.

Each source's rows are dealt by a hash of all their columns into blocks, which are in random order. Of a source with target t and size s every block is
taken floor(t / s) times; of the rest, blocks are taken in order while they fit, and in the block where the rest ends, rows in hash order up to the
one whose middle passes it. So the words taken differ from the target by half a document at most, and no row depends on the run.

The taken blocks are dealt to shards by a tree: a node orders its blocks at random and gives the first half to its left child, so the counts that
the child gets of each source are a multivariate hypergeometric draw from the node's counts. Leaves are shards; their blocks are disjoint, and each
orders its rows at random. Shards hold about SHARD_WORDS words and about BLOCKS_A_SHARD blocks at any size of the input; only a row for each source and
for each block meets in one task, at the root of the tree and in the running sums of a source.

Rows that are equal in all columns are one group with a number of times: what holds for one holds for any, so no task sees them one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echograms.llm.runtime import cut

WEIGHTS, LIMIT, SEED, SHARD_WORDS, BLOCKS_A_SHARD, SHARDS_A_TASK, STEP = (5, 2, 1), 3, 20240607, 10_000_000, 16, 4, 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def exact(value: Column, kind: T.DataType) -> Column:
    """value as something that to_json writes without loss: dates and timestamps as whole numbers of days and microseconds, maps as lists of entries."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.DateType):
        return F.unix_date(value)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[exact(value.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields)]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: exact(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform(F.map_entries(value), lambda e: F.struct(exact(e["key"], kind.keyType).alias("k"), exact(e["value"], kind.valueType).alias("v")))
    return value if isinstance(kind, (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.NullType)) else value.cast("string")


def row_key(docs: DataFrame) -> Column:
    """16 bytes that stand for a row: a digest of all its columns, spelled so that rows which differ in any of them are spelled differently."""
    row = F.struct(*[exact(docs[f"`{f.name}`"], f.dataType).alias(f"f{i}") for i, f in enumerate(docs.schema.fields)])
    return F.substring(F.unhex(F.sha2(F.to_json(row).cast("binary"), 256)), 1, 16)


def source_targets(sizes: DataFrame, weights=WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """(source, source_size, n_docs, target) from rows (source, size, times). Sources are weighed in order of code points, null last.

    Targets share the sum of all sizes by weight. A target stops at limit times its source's size; the rest is shared again by weight among the
    others. In closed form: in order of cap / weight, sources are at their cap as long as the level that the others would get is above it."""
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.sum("times").alias("n_docs"))
    ranked = per.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))).withColumn("cap", limit * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("w"), "k").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    leveled = weighed.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("w") * F.col("level"))
    final = F.max(F.when(~F.col("capped"), F.col("level"))).over(whole)
    return leveled.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("w") * final)).select("source", "source_size", "n_docs", "target")


def shards_for(words: int, shard_words: int = SHARD_WORDS) -> int:
    """A power of two, so that shards hold about shard_words words; 16 at least."""
    return max(16, 1 << (words // shard_words).bit_length())


def mix_plan(docs: DataFrame, weights=WEIGHTS, limit: float = LIMIT, seed: int = SEED, shards: int | None = None, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """(groups, blocks). groups: key, doc_id, source, size, times, source_size, target, block, whole, extra, a row for each distinct row of docs, which is
    there `times` times; each of these is taken `whole` times, and the first `extra` of them once more. blocks: source, block, copy, shard, copy from 1.

    size is the number of words of the text (null: 0). Rows without words are taken 0 times or more and add no words. Null ids and repeated ids make
    no difference: every row counts. An empty table gives empty results. shards is a power of two; without it there is one for about shard_words
    words, 16 at least."""
    if shards is not None and (shards < 1 or shards & (shards - 1)):
        raise ValueError("shards must be a power of two")
    keyed = docs.select("doc_id", "source", word_count(docs["text"]).alias("size"), row_key(docs).alias("key"))
    same = lambda c: F.first(c).alias(c)
    rows = cut(keyed.groupBy("key").agg(same("doc_id"), same("source"), same("size"), F.count("*").alias("times")).withColumn("draw", F.xxhash64(F.lit(seed), "key")), "sizes")
    targets = cut(source_targets(rows, weights, limit), "targets")
    known = targets.agg(F.count("*").alias("n"), F.sum("source_size").alias("words")).first()
    if shards is None:
        shards = shards_for(known.words or 0, shard_words)
    n_blocks = F.least("n_docs", F.ceil(F.lit(shards * BLOCKS_A_SHARD) * F.col("n_docs") / F.sum("n_docs").over(Window.partitionBy())))
    t = targets.withColumn("n_blocks", n_blocks).withColumnRenamed("source", "of")
    placed = rows.join(F.broadcast(t) if known.n <= 10_000 else t, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("block", F.pmod("draw", "n_blocks"))
    words = F.col("size") * F.col("times")
    per_block = placed.groupBy("source", "block").agg(F.sum(words).alias("block_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    order = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    blocks = per_block.withColumn("whole", whole).withColumn("room", F.col("target") - F.col("whole") * F.col("source_size") - F.coalesce(F.sum("block_size").over(order), F.lit(0)))
    blocks = cut(blocks.select("source", "block", "whole", "block_size", "room"), "blocks")
    inner = Window.partitionBy("source", "block").orderBy("draw", "key").rowsBetween(Window.unboundedPreceding, -1)
    b = blocks.select(F.col("source").alias("of"), F.col("block").alias("at"), "whole", "room", "block_size")
    joined = placed.join(b, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at"))).drop("of", "at")
    left = F.col("room") - F.coalesce(F.sum(words).over(inner), F.lit(0))  # what is left for the first of these rows
    fitting = F.when(F.col("size") > 0, F.floor(left / F.col("size") + 0.5)).otherwise(F.when(left >= 0, F.col("times")).otherwise(0))
    extra = F.when(F.col("room") <= 0, 0).when(F.col("room") >= F.col("block_size"), F.col("times")).otherwise(F.least("times", F.greatest(F.lit(0), fitting)))
    groups = joined.select("key", "doc_id", "source", "size", "times", "source_size", "target", "block", "whole", extra.cast("long").alias("extra"))
    taken = blocks.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("whole") + 1))).where("copy <= whole or room > 0").withColumn("shard", F.lit(0))
    for level in range(shards.bit_length() - 1):
        node = Window.partitionBy("shard")
        rank = F.row_number().over(node.orderBy(F.xxhash64(F.lit(seed), F.lit(level), "source", "block", "copy"), F.col("source").asc_nulls_last(), "block", "copy"))
        taken = taken.withColumn("rank", rank).withColumn("shard", F.col("shard") * 2 + (F.col("rank") > F.floor((F.count("*").over(node) + 1) / 2)).cast("int")).drop("rank")
    return groups, taken.select("source", "block", "copy", "shard")


def numbered(rows: DataFrame, times: str) -> DataFrame:
    """rows, each as often as its column `times` says, with nth from 1; in steps, so that no array grows with it."""
    far = rows.where(F.col(times) > 0).withColumn("far", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / STEP))))
    near = F.sequence(F.lit(1).cast("long"), F.least(F.lit(STEP), F.col(times) - F.col("far") * STEP))
    return far.withColumn("near", F.explode(near)).withColumn("nth", F.col("far") * STEP + F.col("near")).drop("far", "near")


def draws(groups: DataFrame, blocks: DataFrame, seed: int = SEED) -> DataFrame:
    """(key, nth, size, copy, shard, turn): the rows of a plan once for each copy that is in a drawn block, with the shard that the tree gives the block;
    nth counts equal rows. turn is what the rows of a shard are in random order by."""
    b = cut(blocks, "dealt").withColumnsRenamed({"source": "of", "block": "at"})
    last = F.col("copy") > F.col("whole")
    met = groups.join(b, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at"))).withColumn("rows", F.when(last, F.col("extra")).otherwise(F.col("times")))
    each = numbered(met.select("key", "size", "copy", "shard", "rows"), "rows")
    return each.select("key", "nth", "size", "copy", "shard", F.xxhash64(F.lit(seed), "shard", "key", "nth", "copy").alias("turn"))


def mixed_rows(docs: DataFrame, weights=WEIGHTS, limit: float = LIMIT, seed: int = SEED, shards: int | None = None) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken, partitioned by shard and in random order within each; an output column `shard`
    takes the place of one of docs. Columns of docs may have any name. Rules for nulls, repeated rows and empty tables are those of mix_plan."""
    groups, blocks = mix_plan(docs, weights, limit, seed, shards)
    groups = cut(groups, "plan")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), row_key(docs).alias("key")).dropDuplicates(["key"])  # tasks meet with one of equal rows each
    full = rows.join(draws(groups, blocks, seed), "key").select("row", "shard", "turn")
    if shards is None:
        shards = shards_for(groups.agg(F.sum(F.col("size") * F.col("times"))).first()[0] or 0)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards // SHARDS_A_TASK)
    shuffled = full.repartition(tasks, "shard").sortWithinPartitions("shard", "turn")
    return shuffled.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "shard"], "shard")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """A row for each row of documents, with what the shards of the tree take of it. Null texts have size 0, null is a source of its own, null and
    repeated ids and equal rows are rows of their own, and an empty table gives an empty result. copies: how often the plan takes the row; taken: the
    words of its copies in drawn blocks; draws: copy, shard and place in the shard's random order of each."""
    groups, blocks = mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    plan = cut(groups, "plan")
    place = F.row_number().over(Window.partitionBy("shard").orderBy("turn", "key", "nth", "copy"))
    per_row = draws(plan, blocks).withColumn("place", place).groupBy("key", "nth").agg(F.sum("size").alias("taken"), F.count_distinct("shard").alias("shards"), F.sort_array(F.collect_list(F.struct("copy", "shard", "place"))).alias("draws"))
    copies = F.col("whole") + (F.col("nth") <= F.col("extra")).cast("long")
    full = numbered(plan, "times").withColumn("copies", copies).join(per_row, ["key", "nth"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return full.select("doc_id", "size", "source_size", "target", zero("taken"), "copies", zero("shards"), F.coalesce("draws", F.array()).alias("draws"))
