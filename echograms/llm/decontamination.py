"""Benchmark decontamination: a prefix-filtered set join between item windows and document words, confirmed on the words themselves.

Words: A-Z lower-cased, runs of letters a-z, digits and characters above \\x7F. A window is `size` consecutive words of an item; an item of fewer words,
but not none, is one window. A document holds a window where the same words stand in the same order.

1. The words of the benchmark are counted over all documents. In each window they are ordered by that rarity.
2. All words of a contained window must occur, so the rarest one is a sufficient prefix. A document's words are looked up among the prefixes; the
   prefix's place in its window says where the window would start and end, and both must lie inside the document.
3. What is left is joined with the windows by hash and by the words themselves.

Tasks know the prefixes and windows as bit tables of at most 2^27 bits, whatever the benchmark's size, so steps 1 and 2 are map passes. A bit table can
only let too much through; counts and the last join are exact. Only spans that pass reach the join, once for each distinct text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from echograms.llm.runtime import Bits, bit_table, cut
from echograms.llm.wordhash import BASE, LETTER_OR_DIGIT, U, Words, mix, slices, window_hashes

SIZE = 10
HIT = pa.struct([("start", pa.int64()), ("size", pa.int32()), ("gram", pa.int64()), ("window", pa.string())])
SEEN = "text_key string, n_words long, hits array<struct<start:bigint,size:int,gram:bigint,window:string>>"
COUNTED = 1 << 20


def _item_windows(size: int):
    """(item_id, gram, size, window, words) for each distinct window of an item; window holds its words, words their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1), 1 << 16):
                words = Words(data, offsets, LETTER_OR_DIGIT)
                hashes, ids = words.hashes(), batch.column(0).slice(a, b - a).to_pylist()
                rows: dict[tuple, tuple] = {}
                for i, (lo, hi) in enumerate(zip(words.first, words.first[1:], strict=False)):
                    k = min(size, hi - lo)
                    spelled = [words.bytes(w).decode() for w in range(lo, hi)]
                    grams = window_hashes(hashes[lo:hi], k).astype(np.int64).tolist() if k else []
                    for at, gram in enumerate(grams):
                        rows.setdefault((i, " ".join(spelled[at : at + k])), (ids[i], gram, k, hashes[lo + at : lo + at + k].astype(np.int64)))
                columns = list(zip(*rows.values(), strict=True)) or [[]] * 4
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
                own = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*own[:3], pa.array([w for _, w in rows], pa.string()), own[3]], ["item_id", "gram", "size", "window", "words"])

    return run


def item_windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """(item_id string, gram, size, window, words): every distinct window of every item, its words joined by spaces and their hashes. Null texts have none."""
    named = items.select(items["item_id"].cast("string").alias("item_id"), items["text"].alias("text"))
    dealt = named.repartition(named.sparkSession.sparkContext.defaultParallelism)  # a benchmark is often one file
    return dealt.mapInArrow(_item_windows(size), "item_id string, gram long, size int, window string, words array<long>")


def _count_words(known):
    """(word, n): how often each word that passes the bit table occurs in the task's rows. A word may come in several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: Bits = known.value
        words, counts = np.zeros(0, U), np.zeros(0, np.int64)

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(counts)], ["word", "n"])

        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                found = Words(data, offsets, LETTER_OR_DIGIT).hashes()
                distinct, n = np.unique(found[bits.test(found)], return_counts=True)
                words, at = np.unique(np.concatenate([words, distinct]), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(words)).astype(np.int64)
            if len(words) > COUNTED:
                yield packed()
                words, counts = words[:0], counts[:0]
        yield packed()

    return run


def _prefix_hash(words: np.ndarray, at: np.ndarray | int, size: np.ndarray | int) -> np.ndarray:
    """Hash of a prefix word with its place in a window of that size."""
    return mix(words + np.asarray(at * 1024 + size, dtype=np.int64).astype(U) * BASE)


def _hashed_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        word, at, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(_prefix_hash(word.view(U), at.astype(np.int64), size.astype(np.int64)).astype(np.int64))], ["prefix"])


def _find(tables, sizes: list[int]):
    """The rows with text_key, n_words and the spans that may be windows."""

    def candidates(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, size, gram) of spans whose prefix, bounds and gram hash pass, in order of first word and size."""
        known, prefixes, grams = tables.value
        place = np.flatnonzero(known.test(hashes))
        text = np.searchsorted(words.first, place, side="right") - 1
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U))]
        for k in sizes:
            gram = window_hashes(hashes, k)
            for at in range(k):
                start = place - at
                inside = (start >= words.first[text]) & (start + k <= words.first[text + 1])
                inside[inside] = prefixes.test(_prefix_hash(hashes[place[inside]], at, k))
                start = start[inside]
                start = start[grams.test(gram[start])] if len(start) else start
                found.append((start, np.full(len(start), k), gram[start] if len(start) else np.zeros(0, U)))
        start, size, gram = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((size, start))
        return start[order], size[order], gram[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(batch.num_columns - 1)):
                words = Words(data, offsets, LETTER_OR_DIGIT)
                start, size, gram = candidates(words, words.hashes())
                text = np.searchsorted(words.first, start, side="right") - 1
                window = [" ".join([words.bytes(w).decode() for w in range(s, s + k)]) for s, k in zip(start.tolist(), size.tolist(), strict=True)]
                inner = [start - words.first[text], size.astype(np.int32), gram.astype(np.int64)]
                hits = pa.StructArray.from_arrays([*map(pa.array, inner), pa.array(window, pa.string())], fields=list(HIT))
                ends = pa.array(np.searchsorted(text, np.arange(b - a + 1)).astype(np.int32))
                raw = data.tobytes()
                keys = [hashlib.sha256(raw[s:e]).hexdigest() for s, e in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
                kept = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(keys, pa.string()), pa.array(np.diff(words.first), pa.int64()), pa.ListArray.from_arrays(ends, hits)], [*batch.schema.names[:-1], "text_key", "n_words", "hits"])

    return run


def text_key(text) -> F.Column:
    """What a text's marks are kept under: a digest of all of it, null as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _marks(rows: DataFrame, items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(seen, marks) for rows whose last column is `text`: seen has the other columns with text_key and n_words, marks has (text_key, n_hit, items)
    for each distinct text that holds a window."""
    spark, texts = rows.sparkSession, rows.select("text")
    windows = cut(item_windows(items, size), "windows")
    grams = cut(windows.groupBy("gram", "window").agg(F.first("size").alias("size"), F.first("words").alias("words"), F.array_sort(F.collect_set("item_id")).alias("items")), "grams")
    n_grams = grams.count()
    spelled = grams.select("gram", "window", "size", F.posexplode("words").alias("at", "word"))
    vocabulary = spelled.select("word").distinct()
    known = spark.sparkContext.broadcast(bit_table(vocabulary, "word", 10 * n_grams))
    counts = cut(texts.mapInArrow(_count_words(known), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).join(vocabulary, "word", "left_semi"), "counts")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at"))
    prefix = cut(spelled.join(counts, "word", "left").groupBy("gram", "window", "size").agg(rarest.alias("rare")).select("rare.word", "rare.at", "size").distinct(), "prefixes")
    hashed = prefix.select("word", "at", "size").mapInArrow(_hashed_prefixes, "prefix long")
    sizes = [r[0] for r in prefix.select("size").distinct().orderBy("size").collect()]  # at most `size` rows
    tables = spark.sparkContext.broadcast((bit_table(prefix, "word", n_grams), bit_table(hashed, "prefix", n_grams), bit_table(grams, "gram", n_grams)))
    seen = cut(rows.mapInArrow(_find(tables, sizes), StructType([*rows.schema.fields[:-1], *StructType.fromDDL(SEEN)])), "seen")
    spans = seen.where(F.size("hits") > 0).select("text_key", F.explode("hits").alias("hit")).select("text_key", "hit.*").distinct()
    met = spans.join(grams.select("gram", "window", "items"), ["gram", "window"])
    reach = F.max(F.col("start") + F.col("size")).over(Window.partitionBy("text_key").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("size") - F.greatest("start", F.coalesce(reach, F.lit(0))))
    listed = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    marks = met.withColumn("fresh", fresh).groupBy("text_key").agg(F.sum("fresh").alias("n_hit"), listed.alias("items"))
    return seen.drop("hits"), cut(marks, "marks")


def mark_contaminated(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_hit (words inside an occurrence), n_items, items_sha256, items (sorted ids as strings).

    Null and empty texts have no words. Repeated rows give repeated results, and rows are judged by their own text, whether their id is null or
    repeated. An empty benchmark marks nothing. Other columns are ignored. Items without an id count for n_hit and are not listed; items of one id
    are one item. A text of any length is searched whole."""
    seen, marks = _marks(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")), items, size)
    full = seen.join(marks, "text_key", "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return full.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"), items_of.alias("items"))


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """docs without the rows that hold a window of the benchmark, with all columns whatever their names. Each row is judged by its own text: rows
    with a null or repeated id, and repeated rows, stay or go one by one. Null and empty texts stay; an empty benchmark drops nothing."""
    _, marks = _marks(docs.select(docs["text"].alias("text")), items, size)
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), text_key(docs["text"]).alias("text_key"))
    return row.join(marks.select("text_key"), "text_key", "left_anti").select("row.*")


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """mark_contaminated over documents and benchmark, with its rules for nulls, ties, repeated rows and empty tables; contaminated: n_hit > 0."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return mark_contaminated(docs, items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))
