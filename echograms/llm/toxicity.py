"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of the rows that its hash and the hashes of its first 3 to 8 bytes point at, so unseen forms of a known stem are
known too. Filters over 1, 2 and 3 words, rectified and pooled by maximum over the whole text, feed one logistic unit. The first coordinate of the
table starts from each feature's log odds in the sample (shrunk by its count), the rest at random; all weights are then trained by Adam with
classes of equal weight. A fold that training did not see decides the offset that puts the best F1 at score 0.5, and a threshold for each
language. The score depends on the text alone; the language thresholds only serve `flagged`."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from echograms.llm.runtime import bit_table, cut
from echograms.llm.wordhash import LETTER_OR_DIGIT, U, Words, slices

TABLE, DIM, FILTERS, WIDTHS, PREFIXES = 1 << 18, 8, 8, (1, 2, 3), (3, 4, 5, 6, 7, 8)
SAMPLE, SAMPLE_WORDS, EPOCHS, BATCH, RATE = 3000, 4_000_000, 4, 64, 0.01
BLOCKS = 256


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words x features) rows of the table, 0 for none, and for each text the index of its first word."""
    words = Words(data, offsets, LETTER_OR_DIGIT)
    columns = [words.hashes(), *[words.prefix_hashes(k) for k in PREFIXES]]
    full = np.stack(columns, axis=1)
    return np.where(full == 0, 0, 1 + (full >> U(20)) % U(TABLE - 1)).astype(np.int32), words.first


@dataclass
class Network:
    table: np.ndarray
    filters: list[np.ndarray]  # for each width: width x DIM x FILTERS
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float = 0.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def embed(self, features: np.ndarray) -> np.ndarray:
        x = self.table[features[:, 0]]
        for k in range(1, features.shape[1]):
            x = x + self.table[features[:, k]]
        return x

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The largest rectified value of each filter over a text's word vectors, and where it is."""
        values, places = [], []
        for width, (f, b) in zip(WIDTHS, zip(self.filters, self.biases, strict=True), strict=True):
            padded = np.vstack([x, np.zeros((max(0, width - len(x)), DIM), x.dtype)])
            n = len(padded) - width + 1
            y = padded[:n] @ f[0]
            for i in range(1, width):
                y += padded[i : i + n] @ f[i]
            at = y.argmax(axis=0)
            values.append(y[at, np.arange(FILTERS)] + b)
            places.append(at)
        return np.concatenate(values), places

    def logit(self, features: np.ndarray) -> float:
        """Long texts go through in runs that overlap by the widest filter, so memory is bounded; the maximum over runs is the maximum over the text."""
        best = np.full(FILTERS * len(WIDTHS), -np.inf)
        step, lap = 20_000, max(WIDTHS) - 1
        for a in range(0, max(1, len(features) - lap), step):
            best = np.maximum(best, self.pooled(self.embed(features[a : a + step + lap]))[0])
        return float(np.maximum(best, 0) @ self.out + self.bias)

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(features) - self.shift, -30, 30))))


def fresh(samples: list[tuple[np.ndarray, int]], seed: int = 11) -> Network:
    """A network whose table starts from the log odds of each feature."""
    seen = np.zeros((2, TABLE))
    for features, label in samples:
        seen[label][np.unique(features)] += 1
    return started(seen, np.array([sum(1 for _, y in samples if y == label) for label in (0, 1)]), seed)


def started(seen: np.ndarray, texts: np.ndarray, seed: int = 11) -> Network:
    """The same from how many texts of each class hold each feature, and how many texts there are."""
    rng = np.random.default_rng(seed)
    n = np.maximum(1, texts)
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    odds *= seen.sum(0) / (seen.sum(0) + 8)
    table = rng.normal(0, 0.01, (TABLE, DIM)).astype(np.float32)
    table[:, 0] = odds / len(PREFIXES)
    table[seen.sum(0) == 0] = 0
    table[0] = 0
    filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, : FILTERS // 2] = 1 / len(f)  # half of the filters start by adding the log odds up
    return Network(table, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.concatenate([[0.3] * (FILTERS // 2) + [0.0] * (FILTERS // 2)] * len(WIDTHS)).astype(np.float32), -1.0)


class _Adam:
    def __init__(self, shape, rate: float = RATE):
        self.m, self.v, self.t, self.rate = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0, rate

    def step(self, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def _gradients(net: Network, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """(gradients of all but the table, rows of the table, their gradients) of the weighted log loss over some texts, all of them at once.

    Texts lie one after the other, each filled up with row 0 to the widest filter; a filter's windows are those that lie inside a text, and the first where
    the text is shorter."""
    size = np.array([len(t) for t in texts])
    room = np.maximum(size, max(WIDTHS))
    start = np.cumsum(room) - room
    features = np.zeros((int(room.sum()), 1 + len(PREFIXES)), dtype=np.int32)
    for t, s in zip(texts, start.tolist(), strict=True):
        features[s : s + len(t)] = t
    x, filter_at = net.embed(features), np.arange(FILTERS)
    pools, places = [], []
    for width, f, b in zip(WIDTHS, net.filters, net.biases, strict=True):
        n = len(x) - width + 1
        y = sum(x[o : o + n] @ f[o] for o in range(width))
        windows = np.maximum(1, size - width + 1)
        at = np.array([y[s : s + w].argmax(axis=0) for s, w in zip(start.tolist(), windows.tolist(), strict=True)]) + start[:, None]
        pools.append(y[at, filter_at] + b)
        places.append(at)
    pool = np.concatenate(pools, axis=1)
    hidden = np.maximum(pool, 0)
    d = weights * (1 / (1 + np.exp(-np.clip(hidden @ net.out + net.bias, -30, 30))) - labels) / len(texts)
    back = d[:, None] * net.out * (pool > 0)
    g = {"out": d @ hidden, "bias": d.sum()}
    rows, changes = [], []
    for i, width in enumerate(WIDTHS):
        own = back[:, i * FILTERS : (i + 1) * FILTERS]
        g["b", i], g["f", i] = own.sum(axis=0), np.zeros_like(net.filters[i])
        for o in range(width):
            at = places[i] + o
            part = np.where(at < (start + size)[:, None], own, 0)
            g["f", i][o] = np.einsum("tkd,tk->dk", x[at], part)
            t, k = np.nonzero(part)
            rows.append(features[at[t, k]])
            changes.append(part[t, k][:, None] * net.filters[i][o].T[k])
    return g, np.concatenate(rows), np.concatenate(changes)


def fit(net: Network, samples: list[tuple[np.ndarray, int]], seed: int = 12) -> None:
    rng = np.random.default_rng(seed)
    labels = np.array([y for _, y in samples])
    positive = int(labels.sum())
    weights = np.where(labels == 1, len(samples) / (2 * max(1, positive)), len(samples) / (2 * max(1, len(samples) - positive)))
    tune = {"out": _Adam(net.out.shape), "bias": _Adam(()), **{("f", i): _Adam(f.shape) for i, f in enumerate(net.filters)}, **{("b", i): _Adam(b.shape) for i, b in enumerate(net.biases)}}
    for _ in range(EPOCHS):
        order = rng.permutation(len(samples))
        for s in range(0, len(order), BATCH):
            chosen = order[s : s + BATCH]
            g, rows, changes = _gradients(net, [samples[j][0] for j in chosen], labels[chosen], weights[chosen])
            net.out -= tune["out"].step(g["out"])
            net.bias -= float(tune["bias"].step(g["bias"]))
            for i in range(len(WIDTHS)):
                net.filters[i] -= tune["f", i].step(g["f", i])
                net.biases[i] -= tune["b", i].step(g["b", i])
            for k in range(rows.shape[1]):
                used = rows[:, k] > 0
                np.subtract.at(net.table, rows[used, k], (0.5 * changes[used]).astype(net.table.dtype))


def best_threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the gap at which predicting 1 above it gives the best F1; 0 where one class is missing."""
    if not len(labels) or labels.min() == labels.max():
        return 0.0
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(len(order)) + 1 + labels.sum())
    last = len(f1) - 1 - int(f1[::-1].argmax())
    below = logits[order[last + 1]] if last + 1 < len(order) else logits[order[last]] - 2
    return float((logits[order[last]] + below) / 2)


def train(rows: list[tuple[np.ndarray, str | None, int]], seed: int = 10) -> Network:
    """A network from rows (word features of a text, language, 0 or 1) in a fixed order. Every fifth row is left for calibration."""
    ready = [(f, y) for i, (f, _, y) in enumerate(rows) if i % 5 and len(f)]
    net = fresh(ready)
    if ready:
        fit(net, ready)
    held = rows[::5]
    logits, labels, langs = np.array([net.logit(f) for f, _, _ in held]), np.array([y for _, _, y in held]), [x for _, x, _ in held]
    net.shift = best_threshold(logits, labels)
    for lang in sorted({x for x in langs if x is not None}):
        mine = np.array([x == lang for x in langs])
        if labels[mine].sum() >= 5 and (1 - labels[mine]).sum() >= 5:
            net.thresholds[lang] = float(1 / (1 + np.exp(-np.clip(best_threshold(logits[mine], labels[mine]) - net.shift, -30, 30))))
    return net


def _featurise(most: int):
    """Rows (draw, lang, toxic, text) with the text as its word features; a text of more than `most` words is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(3), 1 << 18):
                features, first = word_features(data, offsets)
                sizes = np.diff(first)
                keep = pa.array(np.flatnonzero(sizes <= most))
                packed = pa.array([features[s:e].tobytes() for s, e in zip(first, first[1:], strict=False) if e - s <= most], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a).take(keep) for i in range(3)], pa.array(sizes[sizes <= most], pa.int64()), packed], ["draw", "lang", "toxic", "n_words", "features"])

    return run


def _score(shared):
    """Rows whose last columns are text and language, with score and flagged in their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = shared.value
        for batch in batches:
            n, scores = batch.num_columns - 2, []
            for _, _, data, offsets in slices(batch.column(n), 1 << 18):
                features, first = word_features(data, offsets)
                scores += [net.score(features[s:e]) for s, e in zip(first, first[1:], strict=False)]
            limits = [net.thresholds.get(x, 0.5) for x in batch.column(n + 1).to_pylist()]
            flagged = [s >= t for s, t in zip(scores, limits, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(scores, pa.float64()), pa.array(flagged, pa.bool_())], [*batch.schema.names[:n], "score", "flagged"])

    return run


def may_learn(key: Column) -> Column:
    """Which rows a query learns from: those whose crc32(doc_id as text) mod 5 is not 0. A null id is never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, words: int = SAMPLE_WORDS) -> Network:
    """A network from at most `sample` labelled documents of each class and at most `words` words in all, chosen by a hash of the id.

    Labels that are null are left out; of several labels of one id the largest counts. Documents that share an id are samples of their own, in order
    of their text's hash. In that order a class is taken until it has used half of the words; texts of any length are eligible up to that bound.
    Without labelled documents the network knows no word, and all texts score alike."""
    rows = labels.where(may_learn(labels["doc_id"]) & labels["toxic"].isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("draw", F.xxhash64(F.lit("toxic"), "doc_id"))
    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    share = {y: min(1.0, 0.98 * sample / max(1, totals.get(y, 0))) for y in (0, 1)}
    top = lambda s: F.lit(-(2.0**63) + s * 2.0**64)
    chosen = rows.where(F.col("draw") <= F.when(F.col("toxic") == 1, top(share[1])).otherwise(top(share[0])))
    lang = docs["lang"] if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select("doc_id", docs["text"].alias("text"), lang.alias("lang")).join(F.broadcast(chosen), "doc_id")  # about `sample` ids of each class
    ready = cut(texts.select("draw", "lang", "toxic", "text").mapInArrow(_featurise(words // 2), "draw long, lang string, toxic int, n_words long, features binary"), "features")
    order = Window.partitionBy("toxic").orderBy("draw", F.xxhash64("features"), "lang")
    total = F.sum("n_words").over(order.rowsBetween(Window.unboundedPreceding, 0))
    bounded = ready.withColumn("nth", F.row_number().over(order)).withColumn("total", total).where((F.col("nth") <= sample) & (F.col("total") <= words // 2))
    got = bounded.orderBy("draw", F.xxhash64("features"), "lang").select("features", "lang", "toxic").collect()
    return train([(np.frombuffer(r.features, np.int32).reshape(-1, 1 + len(PREFIXES)), r.lang, r.toxic) for r in got])


def _samples(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[np.ndarray, int]]]:
    """(word features, label) of rows (toxic, text), in runs of about `most` words; a longer text is a run of its own."""
    run, size = [], 0
    for batch in batches:
        labels = batch.column(0).to_pylist()
        for a, b, data, offsets in slices(batch.column(1), 1 << 18):
            features, first = word_features(data, offsets)
            for s, e, y in zip(first.tolist(), first[1:].tolist(), labels[a:b], strict=False):
                if size and size + e - s > most:
                    yield run
                    run, size = [], 0
                run.append((features[s:e].copy(), y))
                size += e - s
    if run:
        yield run


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, clean, toxic): how many texts of each class hold a feature; feature -1 counts the texts."""
    seen = np.zeros((2, TABLE + 1), np.int64)
    for run in _samples(batches, 1 << 16):
        for features, y in run:
            if len(features):
                seen[y][np.unique(features)] += 1
                seen[y][-1] += 1
    held = np.flatnonzero(seen.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.where(held == TABLE, -1, held)), pa.array(seen[0][held]), pa.array(seen[1][held])], ["feature", "clean", "toxic"])


def _weights(net: Network) -> np.ndarray:
    return np.concatenate([x.ravel() for x in (net.table, *net.filters, *net.biases, net.out, np.array([net.bias]))]).astype(np.float32)


def _with_weights(net: Network, flat: np.ndarray) -> Network:
    parts = (net.table, *net.filters, *net.biases, net.out)
    cuts = np.cumsum([x.size for x in parts])
    table, *rest = (x.reshape(p.shape) for x, p in zip(np.split(flat, cuts)[:-1], parts, strict=True))
    k = len(WIDTHS)
    return Network(table, rest[:k], rest[k : 2 * k], rest[2 * k], float(flat[-1]))


def _trained(shared, most: int):
    """(block, rows, weights): by how much the weights of a network that was trained on all of a task's rows, in runs of at most `most` words, differ from those at
    the start, cut into BLOCKS. Features that a task does not meet stay at 0, which packs well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start: Network = shared.value
        first = _weights(start)
        net, n = _with_weights(start, first.copy()), 0
        for samples in _samples(batches, most):
            if ready := [x for x in samples if len(x[0])]:
                fit(net, ready)
                n += len(ready)
        if n:
            parts = np.array_split(_weights(net) - first, BLOCKS)
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS)), pa.array([n] * BLOCKS), pa.array([x.tobytes() for x in parts], pa.binary())], ["block", "rows", "weights"])

    return run


def _averaged(table: pa.Table) -> pa.Table:
    n = np.array(table.column("rows").to_pylist(), np.float64)
    mean = sum(np.frombuffer(w, np.float32) * k for w, k in zip(table.column("weights").to_pylist(), n / n.sum(), strict=True))
    return pa.table({"block": table.column("block").slice(0, 1), "weights": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})


def _logits(shared):
    """(logit, toxic, lang) of rows (toxic, text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = shared.value
        for batch in batches:
            found = []
            for _, _, data, offsets in slices(batch.column(1), 1 << 18):
                features, first = word_features(data, offsets)
                found += [net.logit(features[s:e]) for s, e in zip(first, first[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column(0), batch.column(2)], ["logit", "toxic", "lang"])

    return run


def thresholds(logits: DataFrame) -> list:
    """(lang, low, high, toxic, clean) for all rows (logit, toxic, lang), lang null, and for each lang: between low and high lies the threshold of best_threshold.

    Rows with equal logits count as one; sums run over buckets of logits first, of which there are at most 2^16 for each lang, then inside each bucket."""
    both = logits.select("logit", "toxic", F.explode(F.array(F.struct(F.lit(True).alias("whole"), F.lit(None).cast("string").alias("lang")), F.struct(F.lit(False).alias("whole"), "lang"))).alias("of"))
    bucket = F.greatest(F.lit(-32768), F.least(F.lit(32767), F.floor(F.col("logit") * 64))).cast("int")
    points = both.where("of.whole or of.lang is not null").groupBy("of", "logit").agg(F.count("*").alias("n"), F.sum("toxic").alias("hits")).withColumn("bucket", bucket)
    before = Window.partitionBy("of").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    sums = points.groupBy("of", "bucket").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    whole = Window.partitionBy("of")
    sums = sums.select("of", "bucket", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "hits")], F.sum("n").over(whole).alias("all"), F.sum("hits").over(whole).alias("positive"))
    inside = Window.partitionBy("of", "bucket").orderBy(F.desc("logit")).rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select(F.col("of").alias("key"), F.col("bucket").alias("at"), "n_before", "hits_before", "all", "positive")
    ranked = points.join(sums, F.col("of").eqNullSafe(F.col("key")) & (F.col("bucket") == F.col("at")))
    f1 = 2 * (F.sum("hits").over(inside) + F.col("hits_before")) / (F.sum("n").over(inside) + F.col("n_before") + F.col("positive"))
    scored = ranked.withColumn("f1", f1)
    best = scored.groupBy("of").agg(F.max(F.struct("f1", (-F.col("logit")).alias("minus"))).alias("best"), F.max("positive").alias("positive"), F.max("all").alias("all"))
    best = best.select(F.col("of").alias("which"), (-F.col("best.minus")).alias("high"), "positive", (F.col("all") - F.col("positive")).alias("clean"))
    below = points.join(F.broadcast(best), F.col("of").eqNullSafe(F.col("which"))).groupBy("which", "high", "positive", "clean")
    return below.agg(F.max(F.when(F.col("logit") < F.col("high"), F.col("logit"))).alias("low")).select("which.whole", "which.lang", "low", "high", "positive", "clean").collect()


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, text, lang, held) of all documents that may be learned from; held is their calibration fold.

    Documents are shuffled to the labels whatever the size of either, so what is shuffled grows with the input. A bit table of the labelled ids keeps back nearly all
    others; which rows stay is decided by the join. Rows of a partition are in order of id and text, since training follows their order and shuffles have none."""
    marks = labels.where(may_learn(labels["doc_id"]) & labels["toxic"].isin(0, 1))
    rows = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = docs.sparkSession.sparkContext.broadcast(bit_table(marks.select(F.xxhash64("doc_id").alias("key")), "key", marks.count()))
    may_have = F.arrow_udf(lambda keys: pa.array(known.value.test(keys.to_numpy())), "boolean")
    lang = docs["lang"] if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select("doc_id", docs["text"].alias("text"), lang.alias("lang")).where(F.col("doc_id").isNotNull()).where(may_have(F.xxhash64("doc_id")))
    fold = F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(5))
    return texts.join(rows.hint("shuffle_hash"), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text")).select("toxic", "text", "lang", (fold == 0).alias("held"))


def learn_all(docs: DataFrame, labels: DataFrame, words: int = SAMPLE_WORDS) -> Network:
    """A network from all labelled documents that may be learned from, whatever their number; labels, ids and ties as in learn.

    A fifth of the documents, by a hash of the id, is left for calibration. The log odds that the table starts from count all others; these are trained on
    in parts of about `words` words or more, from the same start, a task holding a quarter of `words` at a time, and the networks are averaged by their rows, a block of
    weights in each group. The offset and thresholds come from the logits of the whole calibration fold. The driver sees one network and a row for each
    feature and language."""
    ready = cut(_labelled(docs, labels), "labelled")
    taught = ready.where("not held").select("toxic", "text")
    size = taught.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    taught = taught.coalesce(max(1, size // (6 * words)))  # a task sends up to a row for each feature, then a network
    counts = taught.mapInArrow(_feature_counts, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    feature = counts.column("feature").to_numpy()
    seen = np.zeros((2, TABLE + 1))
    for y, name in enumerate(("clean", "toxic")):
        seen[y][feature] = counts.column(name).to_numpy()  # -1, the texts, is the last
    net = started(seen[:, :-1], seen[:, -1])
    context = docs.sparkSession.sparkContext
    if seen[:, -1].any():
        nets = taught.mapInArrow(_trained(context.broadcast(net), words // 4), "block long, rows long, weights binary")
        mean = nets.groupBy("block").applyInArrow(_averaged, "block long, weights binary").collect()
        net = _with_weights(net, _weights(net) + np.concatenate([np.frombuffer(r.weights, np.float32) for r in sorted(mean, key=lambda r: r.block)]))
    logits = cut(ready.where("held").select("toxic", "text", "lang").mapInArrow(_logits(context.broadcast(net)), "logit double, toxic int, lang string"), "logits")
    found = {(r.whole, r.lang): r for r in thresholds(logits)}
    middle = lambda r: (r.high + (r.high - 2 if r.low is None else r.low)) / 2
    if (r := found.get((True, None))) and r.positive and r.clean:
        net.shift = middle(r)
    for (whole, name), r in sorted(found.items(), key=str):
        if not whole and r.positive >= 5 and r.clean >= 5:
            net.thresholds[name] = float(1 / (1 + np.exp(-np.clip(middle(r) - net.shift, -30, 30))))
    return net


def toxicity(docs: DataFrame, net: Network, *keep: str) -> DataFrame:
    """The columns `keep` of each row with score (0 to 1) and flagged (score reaches the threshold of the row's lang, 0.5 where there is none).

    Only the text decides the score, all of it. Null and empty texts score as texts without words. Repeated rows score alike, an empty table gives an
    empty result, and other columns are ignored."""
    lang = docs["lang"] if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(*[docs[f"`{c}`"] for c in keep], docs["text"].alias("_text"), lang.alias("_lang"))
    schema = StructType([*rows.schema.fields[:-2], *StructType.fromDDL("score double, flagged boolean")])
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return rows.mapInArrow(_score(shared), schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from all rows that may_learn admits. Nulls, empty and long texts, repeated rows and empty tables: as in learn_all
    and toxicity; a row without an id is not held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity(docs, learn_all(docs, labels), "doc_id")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "flagged")
