"""MinHash near-duplicates: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping.

Words: A-Z lower-cased, runs of anything but space and \\x09-\\x0D. A text's set: its distinct five-word shingles; with fewer words its whole
sequence as one; without words nothing, and it is linked with nothing. Two texts are linked when 100 * |A and B| >= percent * |A or B|.

1. One map pass computes the digest of each text's word sequence, the number of its shingles and the band keys of its SuperMinHash signature.
2. Texts with the same words form a class with a number of its own. From here on classes are compared, never copies with each other; ids come back
   at the end, so null and repeated ids do no harm.
3. In each bucket (band, key) every class is compared with a pivot, the member that meets most others, and linked classes are grouped. What
   remains are buckets whose members are in different groups; while a round still joins groups, the next pivots are taken there. Of the pairs that
   are then left, in one bucket and different groups, those that an exact bound does not rule out are compared. So each pair of classes that
   shares a bucket is verified, proven unlinked, or in one group already.
   With 20 bands of 4 rows a pair of similarity 0.85 shares no bucket with probability 4e-7.
4. Every comparison is of the full sets of shingles, spelled out in words; hashes only propose.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echograms.llm.components import components
from echograms.llm.runtime import cut
from echograms.llm.wordhash import BASE, NOT_SPACE, U, mix, slices, text_shingles, word_hashes

BANDS, ROWS, PIVOTS, PAIRS_A_TASK, BLOCK, BROADCAST_IDS, BROADCAST_CLASSES, CELLS, WORDS = 20, 4, 4, 500, 1024, 2_000_000, 200_000, 64, 5
EMPTY, MASK = np.iinfo(np.uint64).max, (1 << 64) - 1


def superminhash(owner: np.ndarray, elements: np.ndarray, texts: int, slots: int) -> np.ndarray:
    """Signatures (texts x slots) of sets given as rows (owner, element), grouped by owner. A set without elements keeps EMPTY in all slots.

    Element e draws a random permutation of the slots; at step j it offers j + uniform to slot p[j], and each slot keeps its least offer. All
    elements of all sets advance step by step together: after step j every filled slot is below j + 1, so a set whose slots are all filled is done."""
    out = np.full(texts * slots, EMPTY, dtype=U)
    perm = np.tile(np.arange(slots, dtype=np.uint8), (len(elements), 1))
    open_slots = np.full(texts, slots)
    for j in range(slots):
        live = np.flatnonzero(open_slots[owner] > 0)
        if not len(live):
            break
        if len(live) < len(elements):
            owner, elements, perm = owner[live], elements[live], perm[live]
        draw = mix(elements + U((j + 1) * int(BASE) & MASK))
        k = (j + (((draw & U(0xFFFFFFFF)) * U(slots - j)) >> U(32)).astype(np.int64)).astype(np.int64)
        row = np.arange(len(elements))
        slot = perm[row, k]
        perm[row, k] = perm[:, j]
        offer = (U(j) << U(32)) | (draw >> U(32))
        at = owner * slots + slot
        fresh = out[at] >= (U(j) << U(32))  # slots that were filled in an earlier step hold less
        np.minimum.at(out, at[fresh], offer[fresh])
        open_slots = (out.reshape(texts, slots) == EMPTY).sum(axis=1)
    return out.reshape(texts, slots)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One hash for each run of ROWS slots."""
    texts = len(signatures)
    parts = signatures.reshape(texts, -1, ROWS)
    out = np.zeros(parts.shape[:2], dtype=U)
    for i in range(ROWS):
        out = mix(out * BASE + parts[:, :, i])
    return out


def spelled(raw: bytes) -> bytes:
    """The words of a text, lower-cased, with one space between them: bytes.split cuts at \\x20 and \\x09-\\x0D, bytes.lower changes A-Z."""
    return b" ".join(raw.lower().split())


def _class_key(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, node, n_shingles, class_key, bands) for rows (doc_id, node, text); a text without words has no class."""
    for batch in batches:
        for a, b, data, offsets in slices(batch.column(2)):
            words, first = word_hashes(data, offsets, NOT_SPACE)
            owner, shingles = text_shingles(words, first, WORDS)
            sizes = np.bincount(owner, minlength=b - a)
            raw = data.tobytes()
            classes = [_class_key(spelled(raw[s:e])) if n else None for s, e, n in zip(offsets.tolist(), offsets[1:].tolist(), sizes.tolist(), strict=False)]
            keys = band_keys(superminhash(owner, shingles, b - a, BANDS * ROWS)).astype(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), bands], ["doc_id", "node", "n_shingles", "class_key", "bands"])


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [spelled(x.as_buffer().to_pybytes()) for x in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([_class_key(w) for w in words], pa.binary()), pa.array(words, pa.binary()).cast(pa.string())], ["class_key", "words"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, element, label) for each distinct shingle of rows (rep, words, label)."""
    for batch in batches:
        for a, b, data, offsets in slices(batch.column(1)):
            owner, shingles = text_shingles(*word_hashes(data, offsets, NOT_SPACE), WORDS)
            reps, labels = (batch.column(k).slice(a, b - a).take(pa.array(owner)) for k in (0, 2))
            yield pa.RecordBatch.from_arrays([reps, pa.array(shingles.astype(np.int64)), labels], ["rep", "element", "label"])


def shingle_set(words: str) -> set[tuple[str, ...]]:
    """The set of a text whose words are joined by spaces, spelled out."""
    w = words.split(" ")
    return set(zip(*(w[i:] for i in range(WORDS)), strict=False)) if len(w) >= WORDS else {tuple(w)}


def _compare(percent: int):
    """Rows (b, salt, a, words) sorted by b, salt, a, with a null for b's own text, which comes first: those a whose set is similar enough to b's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: set = set()
        for batch in batches:
            out: list[tuple[int, int]] = []
            for b, a, words in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if a is None:
                    own = shingle_set(words.as_py())
                    continue
                other = shingle_set(words.as_py())
                if 100 * min(len(own), len(other)) >= percent * max(len(own), len(other)):
                    both = len(own & other)
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])

    return run


def _class_words(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, words) for wanted classes (rep, class_key, node); only the rows of their nodes are read out. A hash of up to BROADCAST_IDS nodes goes to
    the texts, beyond that both sides are dealt by it; what it lets through too much, the class key turns away."""
    wanted = cut(wanted.withColumn("place", F.xxhash64("node")), "wanted")
    n, places, keys = wanted.count(), wanted.select("place").distinct(), wanted.select("class_key", "rep")
    if n <= BROADCAST_IDS:
        places = F.broadcast(places)
    if n <= BROADCAST_CLASSES:
        keys = F.broadcast(keys)
    found = texts.withColumn("place", F.xxhash64("node")).join(places, "place", "left_semi").select("text").mapInArrow(_spell, "class_key binary, words string")
    return cut(found.join(keys, "class_key").groupBy("rep").agg(F.first("words").alias("words")), "words")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full shingle sets are similar enough. b's words travel once for each PAIRS_A_TASK of its pairs, a's once for each pair."""
    salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS_A_TASK).cast("int").alias("salts"))
    own = sets.join(salts, sets.rep == salts.b).select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("a"), "words")
    other = pairs.join(salts, "b").select("b", F.pmod(F.xxhash64("a"), "salts").cast("int").alias("salt"), "a").join(sets, F.col("a") == sets.rep).select("b", "salt", "a", "words")
    rows = own.union(other).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    return rows.mapInArrow(_compare(percent), "a long, b long")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, members.rep == labels.node, "left").drop("node").withColumn("label", F.coalesce("component", "rep")).drop("component")


def _open(named: DataFrame) -> DataFrame:
    """Members of the buckets whose members are in different groups."""
    mixed = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
    return named.join(mixed, "bucket")


def _bounded(percent: int):
    """(a, b) for rows (bucket, block, guest, rep, label, n, o, cells) in order: pairs of a row of a block and a guest of the same block, with b < a, in
    different groups, whose similarity may reach the percentage."""

    def close(x: list[np.ndarray], y: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(0, len(y[0]), CELLS):
            rep, label, n, o, cells = (c[k : k + CELLS] for c in y)
            most = np.minimum(x[3][:, None], o)
            i, j = np.nonzero((x[0][:, None] > rep) & (x[1][:, None] != label) & (100 * most >= percent * (x[2][:, None] + n - most)))
            both = np.minimum(x[4][i], cells[j]).sum(axis=1)
            ok = 100 * both >= percent * (x[2][i] + n[j] - both)
            yield x[0][i[ok]], rep[j[ok]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, block, guest, *plain = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            columns = [*plain, batch.column(7).flatten().to_numpy().reshape(-1, CELLS)]
            edges = np.flatnonzero((bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1]) | (guest[1:] != guest[:-1])) + 1
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for s, e in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                part = [c[s:e] for c in columns]
                if not guest[s]:
                    same = now == (bucket[s], block[s])
                    own = [np.concatenate(c) for c in zip(own, part, strict=True)] if same else part
                    now = (bucket[s], block[s])
                elif now == (bucket[s], block[s]):
                    found += close(own, part)
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _rest(named: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one bucket that are in different groups and may be similar enough.

    An element that occurs in one group only cannot be shared with another group. The other elements of a set are counted in CELLS cells by hash;
    the intersection of a pair is at most the sum over cells of the smaller count, which bounds the similarity; pairs below the bound are proven
    unlinked. Members of a bucket meet in blocks of about BLOCK rows with the bucket, each block dealt on its own, so no task squares a bucket; only pairs
    that pass leave it."""
    reps = named.groupBy("rep").agg(F.first("label").alias("label"))
    elements = cut(sets.join(reps, "rep").select("rep", "words", "label").mapInArrow(_elements, "rep long, element long, label long"), "elements")
    shared = elements.groupBy("element").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("element")
    counts = elements.join(shared, "element").groupBy("rep", F.pmod("element", F.lit(CELLS)).cast("int").alias("cell")).agg(F.count("*").cast("int").alias("n"))
    whole = counts.groupBy("rep").agg(F.sum("n").alias("o"), F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("by"))
    known = whole.select("rep", "o", F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda c: F.coalesce(F.try_element_at(F.col("by"), c), F.lit(0))).alias("cells"))
    facts = cut(known.join(classes.select("rep", F.col("n_shingles").alias("n")), "rep").where(100 * F.col("o") >= percent * F.col("n")), "facts")
    members = named.join(facts.select("rep"), "rep", "left_semi")
    blocks = members.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("all")).where("all > 1")
    dealt = members.join(blocks, "bucket").join(facts, "rep")
    columns = ["bucket", "block", "guest", "rep", "label", "n", "o", "cells"]
    own = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn("guest", F.lit(False)).select(columns)
    guests = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("guest", F.lit(True)).select(columns)
    rows = own.union(guests).repartition("bucket", "block").sortWithinPartitions("bucket", "block", "guest")
    return rows.mapInArrow(_bounded(percent), "a long, b long").distinct()


def _classes_of(texts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(signed, classes) for rows (doc_id, node, text): signed is (doc_id, node, n_shingles, class_key), classes is (class_key, component, least_id), where
    component numbers the groups of linked classes and least_id is the smallest id of the group's texts, null if none has one."""
    signed = cut(texts.mapInArrow(_signatures, "doc_id long, node binary, n_shingles long, class_key binary, bands array<long>"), "signatures")
    per_class = signed.where("n_shingles > 0").groupBy("class_key").agg(F.min("doc_id").alias("least_id"), F.min_by(F.struct("node", "n_shingles", "bands"), "node").alias("x"))
    classes = cut(per_class.select("class_key", "least_id", "x.*", F.monotonically_increasing_id().alias("rep")), "classes")  # numbered once, when written
    rows = classes.select("rep", F.posexplode("bands").alias("band", "band_key")).select("rep", F.xxhash64("band", "band_key").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(rows.join(shared, "bucket"), "buckets")
    central = members.groupBy("rep").agg(F.sum("n").alias("central"))  # who meets many is likely to be close to many
    members = cut(members.join(central, "rep").drop("n"), "members")
    sets = _class_words(texts, classes.select("rep", "class_key", "node").join(members.select("rep").distinct(), "rep"))
    found = labels = None
    for turn in range(PIVOTS):
        pivots = members.groupBy("bucket").agg(F.max_by("rep", F.struct("central", -F.col("rep"))).alias("pivot"))
        joined = members.join(pivots, "bucket").where("rep <> pivot")
        pairs = cut(joined.select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct(), "pairs")
        fresh = cut(_verify(pairs, sets, percent), "linked")
        merged = fresh if labels is None else _labelled(_labelled(fresh.withColumnRenamed("a", "rep"), labels).drop("rep").withColumnsRenamed({"label": "p", "b": "rep"}), labels).where("p <> label")
        new = not merged.isEmpty()
        found = fresh if found is None else found.union(fresh)
        if new or labels is None:
            labels = cut(components(found), "labels")
        members = cut(_open(_labelled(joined.select("bucket", "rep", "central"), labels)).drop("label"), "members")
        if not new or members.isEmpty():
            break
    if not members.isEmpty():
        named = cut(_labelled(members.select("bucket", "rep"), labels), "open")
        fresh = cut(_verify(cut(_rest(named, classes, sets, percent), "pairs"), sets, percent), "linked")
        if not fresh.isEmpty():
            labels = cut(components(found.union(fresh)), "labels")
    linked = classes.select("class_key", "least_id", "rep").join(labels, F.col("rep") == labels.node, "left").withColumn("component", F.coalesce("component", "rep")).drop("node", "rep")
    least = linked.groupBy("component").agg(F.min("least_id").alias("least_id"), F.count("*").alias("n")).where("n > 1").drop("n")  # classes alone know theirs
    return signed.drop("bands"), linked.withColumnRenamed("least_id", "own").join(least, "component", "left").select("class_key", "component", F.coalesce("least_id", "own").alias("least_id"))


def _node(key, text) -> F.Column:
    """16 bytes that stand for a row's id and text."""
    return F.substring(F.unhex(F.sha2(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("-")), F.coalesce(text, F.lit(""))).cast("binary"), 256)), 1, 16)


def near_duplicate_groups(docs: DataFrame, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    Every row is a document of its own: rows that repeat an id with another text are compared by their own texts, and a repeated row gives its row
    again. Null and empty texts, and texts of white space, have n_shingles 0 and are their own component. component_id is the smallest id of the
    documents that can be reached; a row without an id takes part, and gets null where no document in its group has one. Texts of any length are
    compared whole. An empty table gives an empty result; other columns are ignored."""
    k, t = docs[f"`{key}`"].cast("long"), docs[f"`{text}`"]
    signed, classes = _classes_of(docs.select(k.alias("doc_id"), _node(k, t).alias("node"), t.alias("text")), percent)
    return signed.join(classes.select("class_key", "least_id"), "class_key", "left").select("doc_id", "n_shingles", F.when(F.col("class_key").isNull(), F.col("doc_id")).otherwise(F.col("least_id")).alias("component_id"))


def keep_one_each(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs with one row of each group of near-duplicates: the one with the smallest doc_id, ids before null; of rows that share that id, the one with the
    least digest; of rows equal in id and text, any. Rows are judged by their own text. Null and empty texts, and texts of white space, are in no
    group and all stay. All columns are kept, whatever their names; an empty table gives an empty result."""
    k, t = docs["doc_id"].cast("long"), docs["text"]
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    has_words = F.coalesce(t.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.where(has_words).select(row, k.alias("doc_id"), t.alias("text"), _node(k, t).alias("node"))
    signed, classes = _classes_of(rows.select("doc_id", "node", "text"), percent)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node"))
    kept = signed.join(classes.select("class_key", "component"), "class_key").groupBy("component").agg(first.alias("least")).select("least.node")
    return rows.select("node", "row").join(kept, "node", "left_semi").dropDuplicates(["node"]).select("row.*").union(docs.where(~has_words))


def op7_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """near_duplicate_groups over documents, with its rules for nulls, ties, repeated rows and empty tables; kept: doc_id is component_id (null like null)."""
    groups = near_duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
