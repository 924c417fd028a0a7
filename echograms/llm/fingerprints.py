"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits. DataFrame functions only.

A text's five-word shingles (its whole sequence where it has fewer words) are hashed once; the hash's low bits choose one of BINS bins and each bin
keeps its least hash. Every empty bin has an order of its own over all bins, from a random start by random odd steps, and borrows from the first
full bin in that order. Of each bin BITS low-order bits are stored, PACK bins in one number. Bits agree by chance with probability 2^-BITS, which the
likeness corrects for."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echograms.llm.runtime import equal_depth_cuts, range_index

BINS, BITS, WORDS, PACK, PROBES = 256, 8, 5, 4, 12
HEX = BINS * BITS // 4
EMPTY = "-" * HEX  # the fingerprint of a text without words
LOW = (1 << BITS) - 1


def probing(seed: int = 5) -> tuple[list[int], list[int], list[int]]:
    """(starts, steps, inverse steps) for each bin: bin i's order is starts[i] + a * steps[i] modulo BINS for a = 0, 1, ... BINS is a power of two, so an
    odd step meets every bin once."""
    rng = random.Random(seed)
    starts, steps = [rng.randrange(BINS) for _ in range(BINS)], [rng.randrange(1, BINS, 2) for _ in range(BINS)]
    return starts, steps, [pow(s, -1, BINS) for s in steps]


STARTS, STEPS, BACK = probing()


def _with_minima(df: DataFrame) -> DataFrame:
    """Rows with `text`, and `minima`: the sorted minima of the text's full bins, each bin * 2^40 + the least 40-bit hash in it."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df = df.withColumn("w", F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    w = F.col("w")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - WORDS, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)]))
    # bin from bit 40 on, value below: one sort puts the bins in order and each bin's least hash first
    keys = F.transform(runs, lambda h: F.shiftleft(F.pmod(h, F.lit(BINS)), 40) + F.shiftrightunsigned(h, 24))
    df = df.withColumn("k", F.when(F.size(w) > 0, F.sort_array(keys)).otherwise(F.array().cast("array<bigint>"))).drop("w")
    k = F.col("k")
    first = F.filter(k, lambda x, i: (i == 0) | (F.shiftright(F.get(k, i - 1), 40) != F.shiftright(x, 40)))
    return df.withColumn("minima", first).drop("k")


def _with_packed(df: DataFrame) -> DataFrame:
    """Rows with `minima`, and `packed`: the stored bits of all bins, PACK bins in each number, the first bin highest; empty where there is no full bin."""
    m = F.col("minima")
    at = lambda x: F.shiftright(x, 40).cast("int")
    low = lambda x: x.bitwiseAND(LOW).cast("int")
    gap = lambda n: F.array_repeat(F.lit(None).cast("int"), n)
    dense = F.concat(F.flatten(F.transform(m, lambda x, i: F.concat(gap(at(x) - F.when(i == 0, F.lit(-1)).otherwise(at(F.get(m, i - 1))) - 1), F.array(low(x))))), gap(F.lit(BINS - 1) - at(F.element_at(m, -1))))
    df = df.withColumn("dense", F.when(F.size(m) > 0, dense).otherwise(F.array().cast("array<int>")))
    d = F.col("dense")
    starts, steps, back = (F.array(*[F.lit(x) for x in row]) for row in (STARTS, STEPS, BACK))

    def borrowed(i):
        """The first full bin in the order of bin i: most texts meet it in a few probes; where they do not, the full bins are compared by their place
        in that order, which names the same bin."""
        probes = [F.get(d, (F.get(starts, i) + a * F.get(steps, i)).bitwiseAND(BINS - 1)) for a in range(PROBES)]
        turn = lambda x: ((at(x) - F.get(starts, i) + BINS) * F.get(back, i)).bitwiseAND(BINS - 1)
        least = F.aggregate(m, F.lit(BINS << BITS), lambda acc, x: F.least(acc, F.shiftleft(turn(x), BITS) + low(x)))
        return F.coalesce(*probes, least.bitwiseAND(LOW))

    df = df.withColumn("full", F.transform(d, lambda x, i: F.coalesce(x, borrowed(i))))
    f = F.col("full")

    def number(k):
        out = F.get(f, k * PACK).cast("long")
        for i in range(1, PACK):
            out = F.shiftleft(out, BITS) + F.get(f, k * PACK + i)
        return out

    packed = F.transform(F.sequence(F.lit(0), F.lit(BINS // PACK - 1)), number)
    return df.withColumn("packed", F.when(F.size(m) > 0, packed).otherwise(F.array().cast("array<bigint>"))).drop("dense", "full", "minima")


def _as_text(packed: Column) -> Column:
    """Hex digits, two for each bin; EMPTY for none."""
    return F.when(F.size(packed) == 0, F.lit(EMPTY)).otherwise(F.lower(F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), PACK * BITS // 4, "0")), "")))


def _likeness(a: Column, b: Column) -> Column:
    """Of packed arrays: the share of equal bins, less what chance gives."""
    carry = F.lit(0x7F7F7F7F).cast("long")

    def equal(x, y):
        """How many of the bytes of two numbers agree: those of their difference that are 0."""
        z = x.bitwiseXOR(y)
        used = (z.bitwiseAND(carry) + carry).bitwiseOR(z).bitwiseAND(F.lit(0x80808080).cast("long"))
        return PACK - F.bit_count(used)

    same = F.aggregate(F.zip_with(a, b, equal), F.lit(0), lambda n, x: n + x)
    chance = 2.0**-BITS
    either = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(either, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance)))


def _packed(digits: Column) -> Column:
    """The packed array behind a fingerprint."""
    wide = PACK * BITS // 4
    number = lambda i: F.conv(F.substring(digits, i * wide + 1, F.lit(wide)), 16, 10).cast("long")
    return F.when(digits == EMPTY, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(BINS // PACK - 1)), number))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two fingerprints: share of equal bins, less what chance gives. 1 for equal
    fingerprints; 0 where only one text has words."""
    return _likeness(_packed(a), _packed(b))


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with a fingerprint of each whole text; null counts as empty, and equal texts have equal fingerprints. Columns of docs may have any name; one
    with the name of the fingerprint is replaced. An empty table gives an empty result."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != name]).alias("row"), F.coalesce(docs[f"`{text}`"], F.lit("")).alias("text"))
    done = _with_packed(_with_minima(rows))
    return done.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != name], _as_text(F.col("packed")).alias(name))


def _ranges(docs: DataFrame, parts: int) -> tuple[Column, int]:
    """(range number, number of ranges) over rows (doc_id, tie, text) in order of doc_id with nulls last, then tie. An id, or null, that fills several
    ranges is cut by tie, so that no range holds much more than its share."""
    n, nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    share = equal_depth_cuts(docs.select("doc_id"), "doc_id", parts)
    weights = {v: share.count(v) for v in share}
    cuts = sorted(weights)
    first, at = [], 0
    for v in cuts:
        first.append(at)
        at += weights[v]
    last = max(1, -(-parts * nulls // max(1, n)))
    part = lambda of: F.floor((F.col("tie").cast("double") + 2.0**63) / 2.0**64 * of).cast("int")
    within = lambda of: F.least(of - 1, part(of))
    ids = F.lit(0)
    if cuts:
        i = range_index(F.col("doc_id"), cuts)
        begin, weight, value = (F.get(F.array(*[F.lit(x) for x in row]), i) for row in (first, [weights[v] for v in cuts], cuts))
        ids = begin + F.when(F.col("doc_id") == value, within(weight)).otherwise(weight - 1)
    return F.when(F.col("doc_id").isNull(), F.lit(at) + within(F.lit(last))).otherwise(ids), at + last


def next_rows(docs: DataFrame, parts: int) -> tuple[DataFrame, Column]:
    """Rows (doc_id, tie, text, range, guest) and the order inside a range: the first row of each range that has rows is also a guest at the end of the range
    before it, and the very first row at the end of the last, so that each range is a window of its own."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    number, _ = _ranges(keyed, parts)
    placed = keyed.withColumn("range", number)
    heads = placed.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "text")).alias("head"))
    ring = Window.orderBy("range")  # a row for each range
    before = F.coalesce(F.lag("range").over(ring), F.max("range").over(Window.partitionBy()))
    guests = heads.withColumn("before", before).select("head.doc_id", "head.tie", "head.text", F.col("before").alias("range"), F.lit(True).alias("guest"))
    return placed.withColumn("guest", F.lit(False)).unionByName(guests), F.col("doc_id").isNull()


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents. Null texts count as empty. The next document is the next in order of doc_id, null ids last; rows that share an id
    are in order of a hash of their text, then the text, and a repeated row is followed by its copy. A single document follows itself; an empty table
    gives an empty result. Texts of any length are taken whole."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows, none = next_rows(docs, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = _with_packed(_with_minima(rows))
    order = Window.partitionBy("range").orderBy("guest", none, "doc_id", "tie", "text")
    following = own.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", "packed")}).where(~F.col("guest"))
    n_chars = F.length("text")
    quarter = F.floor(n_chars / 4).cast("int")
    edited = following.select("doc_id", n_chars.cast("long").alias("n_chars"), F.concat(F.left("text", n_chars - quarter), F.left("next_text", quarter)).alias("text"), F.col("packed").alias("own"), "next_packed")
    both = _with_packed(_with_minima(edited))
    return both.select("doc_id", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("edited_sha256"), _as_text(F.col("own")).alias("fingerprint"), _as_text(F.col("packed")).alias("edited_fingerprint"), _likeness(F.col("own"), F.col("packed")).alias("near_edited"), _likeness(F.col("own"), F.col("next_packed")).alias("near_next"))
