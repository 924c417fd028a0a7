"""Filter interaction audit: what each quality filter removes in every order of the filters, kept up to date by a stream that takes back what later files change.

The filters are looks at one text (A to D) and one at the whole table: E fails a row whose text a row of a smaller id has, too. The rows of a part are counted
by their mask, the set of filters that they fail, and from these counts follow all orders and steps.

1. The files of a table are a stream; each trigger takes some of them, until none is left (available now). A row becomes its mask of A to D and a
   128-bit digest of its text by column functions, labels come by a join of such thin rows, and rows of one text, part, mask and label that a task has are one row with a
   number and a least id before anything is shuffled: a text that a third of all rows share is a few rows for each task.
2. The state remembers for each text its least id and what the rows of that id were counted as. A smaller id in a later batch makes the earlier rows fail E:
   they are taken back from the counters and counted anew. State keys are groups of texts that share low bits of the digest, some dozens of texts each, as
   a call of Python for each text would cost more than the text. The state is about 100 bytes a text, kept by the state store that the cluster is set up
   with (spark.sql.streaming.stateStore.providerClass: Spark's default keeps it in the heap, RocksDB on disk), with its changes in the checkpoint folder.
3. Each batch writes its changes of the counters to a folder of its own, by its number, so a batch that is run again after a failure replaces itself. The
   counters are the sums of all changes."""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echograms.llm.runtime import cut, shared_folder

LETTERS, DUPLICATE, BATCHES, TEXTS_A_KEY, COMBINE = "ABCDE", 16, 4, 64, 100_000
COMBINED = "bucket long, digest string, part string, mask int, good boolean, toxic boolean, n long, has_id boolean, least long, n_least long"
CHANGES = "part string, mask int, good boolean, toxic boolean, n long"


def text_mask(text: Column) -> Column:
    """Which of A to D a text fails, as bits 1, 2, 4, 8. A: under 200 words; B: less than half of the words distinct; C: more than 3 % capitals A-Z; D: holds
    any of #$%&*|. Words are runs of anything but space and \\x09-\\x0D."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    fails = (F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text), F.regexp_like(text, F.lit("[#$%&*|]")))
    mask = F.lit(0)
    for i, fail in enumerate(fails):
        mask = mask + F.when(fail, 1 << i).otherwise(0)
    return mask


def _combined(keys: int):
    """Rows of a task that agree in text, part and labels as one row; rows without an id, which never fail E, apart from those with one."""

    def rows(found: dict) -> pa.RecordBatch:
        flat = [(int(k[0], 16) % keys, *k[:5], v[0], k[5], v[1], v[2]) for k, v in found.items()]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], k) for i, k in enumerate(kinds)], [x.split()[0] for x in COMBINED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list[int]] = {}
        for batch in batches:
            for doc, part, digest, mask, good, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen = found.setdefault((digest, part, mask, good, toxic, doc is not None), [0, doc or 0, 0])
                seen[0] += 1
                if doc is not None and doc < seen[1]:
                    seen[1:] = [doc, 1]
                elif doc is None or doc == seen[1]:
                    seen[2] += 1
            if len(found) >= COMBINE:
                yield rows(found)
                found = {}
        if found:
            yield rows(found)

    return run


def retract(texts: dict, rows) -> Counter:
    """Changes of the counters (part, mask, good, toxic) that rows of texts (digest, part, mask, good, toxic, n, has_id, least, n_least) bring; texts, which
    holds [least id, [[part, good, toxic, n], ...]] for each digest, is updated."""
    changes: Counter = Counter()
    for digest, part, mask, good, toxic, n, has_id, least, n_least in rows:
        if not has_id:
            changes[part, mask, good, toxic] += n
            continue
        known = texts.get(digest)
        if known is not None and known[0] < least:
            changes[part, mask | DUPLICATE, good, toxic] += n
            continue
        if known is None or least < known[0]:
            for p, g, t, m in known[1] if known else ():  # these were the first of their text until now
                changes[p, mask, g, t] -= m
                changes[p, mask | DUPLICATE, g, t] += m
            known = texts[digest] = [least, []]
        changes[part, mask, good, toxic] += n_least
        changes[part, mask | DUPLICATE, good, toxic] += n - n_least
        same = next((x for x in known[1] if x[:3] == [part, good, toxic]), None)
        if same:
            same[3] += n_least
        else:
            known[1].append([part, good, toxic, n_least])
    return changes


def _update(key, frames, state):
    import pandas as pd  # workers of the other steps do without

    texts = json.loads(state.get[0]) if state.exists else {}
    changes: Counter = Counter()
    for frame in frames:
        changes.update(retract(texts, zip(*[frame[c.split()[0]].tolist() for c in COMBINED.split(", ")[1:]], strict=True)))
    state.update((json.dumps(texts, ensure_ascii=False, separators=(",", ":")),))
    flat = [(*k, n) for k, n in changes.items() if n]
    if flat:
        yield pd.DataFrame(flat, columns=[c.split()[0] for c in CHANGES.split(", ")])


def _as_pattern(path: str) -> str:
    """The path as a pattern that only it matches: a stream takes a pattern for a single file, too."""
    return path if set(path) & set("*?[{") else f"{path[:-1]}[{path[-1]}]"


def update_counters(spark: SparkSession, documents: str, flags: DataFrame, folder: str, keys: int, files_a_batch: int, key: str = "doc_id", text: str = "text", part: str = "lang") -> None:
    """Take the files under `documents` that the stream of `folder` has not seen yet into its counters, and return when none is left.

    flags: (id, good, toxic), a row for each id that has a label. folder holds the checkpoint and the changes of each batch; keys must stay the same for a
    folder. The session of the stream is one of its own, so settings of the caller's stay as they are."""
    schema = spark.read.parquet(documents).schema
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    files = session.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("maxFileAge", "36500d").parquet(_as_pattern(documents))
    body = F.coalesce(files[f"`{text}`"], F.lit(""))
    digest = F.substring(F.sha2(body.cast("binary"), 256), 1, 32)
    thin = files.select(files[f"`{key}`"].cast("long").alias("doc_id"), F.coalesce(files[f"`{part}`"], F.lit("")).alias("part"), digest.alias("digest"), text_mask(body).alias("mask"))
    known = session.read.schema(flags.schema).parquet(*flags.inputFiles()) if flags.inputFiles() else session.createDataFrame([], flags.schema)
    no = F.lit(False)
    labelled = thin.join(known, thin["doc_id"] == known["id"], "left").select("doc_id", "part", "digest", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    changes = labelled.mapInArrow(_combined(keys), COMBINED).groupBy("bucket").applyInPandasWithState(_update, CHANGES, "texts string", "append", "NoTimeout")

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    query = changes.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).start()
    query.awaitTermination()


def counters(spark: SparkSession, folder: str) -> DataFrame:
    """(part, mask, n, good, toxic) of a folder: how many rows of each part have each mask, and how many of these have the labels."""
    one = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    rows = spark.read.schema(CHANGES).parquet(f"{folder}/changes").where("part is not null")
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n_rows"), one("good"), one("toxic")).where("n_rows > 0").withColumnRenamed("n_rows", "n")


def filter_orders(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders of the filters, from counters; the mask's
    lowest bit is the first letter. A part is at most 2^filters counts, so its orders are worked out in its row."""
    per = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(letters))), ",")
    rows = per.select("part", "m", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    bit = lambda at: f"shiftleft(1, instr('{letters}', substring(filter_order, {at}, 1)) - 1)"
    rows = rows.withColumn("own", F.expr(bit("step"))).withColumn("before", F.expr(f"aggregate(filter(sequence(1, {len(letters)}), i -> i < step), 0, (x, i) -> x + {bit('i')})"))
    total = lambda test, what="e.n": F.expr(f"aggregate(m, cast(0 as bigint), (x, e) -> x + if({test}, {what}, 0))")
    first, fails = "(e.mask & before) = 0 and (e.mask & own) != 0", "(e.mask & own) != 0"
    many = 1
    for i in range(2, len(letters) + 1):
        many *= i
    return rows.select(
        "part", "filter_order", "step", total("(e.mask & (before | own)) = 0").alias("kept"), total(first).alias("removed"), total(f"{fails} and (e.mask & before) != 0").alias("redundant"),
        total("e.mask = own").alias("unique_fails"), total(first, "e.good").alias("good_lost"), total(first, "e.toxic").alias("toxic_lost"), total(fails, f"e.n * {many} div bit_count(e.mask)").alias("shapley"),
    )


def label_flags(labels: DataFrame) -> DataFrame:
    """(id, good, toxic) for each id with a label that counts: quality = 1 or toxic = 1 in any of its rows. Rows without an id belong to no document."""
    yes = lambda c: F.max(F.coalesce(labels[f"`{c}`"] == 1, F.lit(False)))
    return labels.where(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].alias("id")).agg(yes("quality").alias("good"), yes("toxic").alias("toxic")).where("good or toxic")


def filter_audit(spark: SparkSession, documents: str, labels: DataFrame, folder: str | None = None, keys: int | None = None, files_a_batch: int | None = None) -> DataFrame:
    """filter_orders of the Parquet table under the path `documents`, whose files come as BATCHES micro-batches or files_a_batch at a time.

    folder: where the stream keeps checkpoint and counters; called again with the same folder and keys, only new files are read. Without it, a new one in the
    shared folder. keys: number of state keys; without it, one for TEXTS_A_KEY rows of the table.

    Null texts are empty, null parts the part ''. A row without an id has no smaller id and is none, so it passes E; rows that share id and text are
    no duplicates of each other, others of that text are. Repeated rows count each, other columns are ignored, whatever their names; an empty table
    gives an empty result. Texts are judged whole."""
    table = spark.read.parquet(documents)
    folder = folder or f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    flags = cut(label_flags(labels), "flags")
    files_a_batch = files_a_batch or max(1, -(-len(table.inputFiles()) // BATCHES))
    keys = keys or max(64, table.count() // TEXTS_A_KEY)
    spark.createDataFrame([], CHANGES).write.mode("overwrite").parquet(f"{folder}/changes/batch=-1")
    update_counters(spark, documents, flags, folder, keys, files_a_batch)
    return filter_orders(cut(counters(spark, folder), "counters"))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """filter_audit of all documents by language."""
    return filter_audit(spark, f"{sf_dir}/documents.parquet", spark.read.parquet(f"{sf_dir}/labels.parquet"))
