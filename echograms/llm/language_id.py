"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Training is follow-the-regularised-leader with elastic-net penalties, over a bounded sample of labelled rows: about SAMPLE rows in proportion to the
languages, and LEAST rows of each language at least, so that rare ones are learned too. Document frequencies are counted over all rows that may be
learned from. A part of the sample is held back to fit one temperature for the probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS, ORDERS, SAMPLE, LEAST, EPOCHS = 1 << 13, (1, 2, 3), 3000, 100, 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed character n-grams of the lower-cased text, with a space at either end."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    total = np.zeros(BUCKETS, dtype=np.int64)
    rolled = np.zeros(len(points), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(points) < n:
            break
        rolled = rolled[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :] * np.uint32(0x9E3779B1)
        if n in ORDERS:
            total += np.bincount((rolled ^ (rolled >> np.uint32(15))) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return total


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # languages x buckets
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(counts)
        value = np.log1p(counts[at]) * self.idf[at]
        return at, value / max(1e-12, np.sqrt(value @ value))

    def logits(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        return self.weights[:, at] @ value + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, probability); ("und", 0) for null, for a text without letters, and where nothing was learned."""
        if not self.languages or not has_letter(text):
            return "und", 0.0
        p = softmax(self.logits(*self.features(gram_counts(text))) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def train(languages: list[str], idf: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """rows: (buckets, values, language number), in a fixed order; every fifth is held back for the temperature."""
    k = len(languages)
    z, n = np.zeros((k, BUCKETS + 1)), np.zeros((k, BUCKETS + 1))  # the last column is the bias, without penalty
    model = Model(languages, idf, np.zeros((k, BUCKETS)), np.zeros(k))
    fit, held = [r for i, r in enumerate(rows) if i % 5], rows[::5]

    def weights(at: np.ndarray) -> np.ndarray:
        penalty = np.where(at == BUCKETS, 0.0, L1)
        return -np.sign(z[:, at]) * np.maximum(np.abs(z[:, at]) - penalty, 0) / ((BETA + np.sqrt(n[:, at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for at, value, label in fit:
            at1, v1 = np.append(at, BUCKETS), np.append(value, 1.0)
            w = weights(at1)
            g = np.outer(softmax(w @ v1) - (np.arange(k) == label), v1)
            sigma = (np.sqrt(n[:, at1] + g * g) - np.sqrt(n[:, at1])) / ALPHA
            z[:, at1] += g - sigma * w
            n[:, at1] += g * g
    w = weights(np.arange(BUCKETS + 1))
    model.weights, model.bias = w[:, :-1], w[:, -1]
    if held:
        scored = [(model.logits(at, v), y) for at, v, y in held]
        loss = lambda t: -sum(np.log(max(1e-12, softmax(x / t)[y])) for x, y in scored)
        model.temperature = float(min(np.geomspace(0.05, 5, 41), key=loss))
    return model


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n): in how many of the task's rows the bucket occurs; bucket -1 counts the rows."""
    total, rows = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            t = text.as_py()
            rows += 1
            if has_letter(t):
                total += gram_counts(t) > 0
    yield pa.RecordBatch.from_arrays([pa.array([*range(BUCKETS), -1], pa.int32()), pa.array([*total, rows], pa.int64())], ["bucket", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [gram_counts(t.as_py()) for t in batch.column(2)]
        at = [np.flatnonzero(c) for c in counts]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([a.astype(np.uint16).tobytes() for a in at], pa.binary()), pa.array([c[a].astype(np.uint32).tobytes() for c, a in zip(counts, at, strict=True)], pa.binary()), batch.column(3)], ["draw", "lang", "at", "counts", "quota"])


def learn(rows: DataFrame, sample: int = SAMPLE, least: int = LEAST) -> Model:
    """A model from rows (draw, lang, text): draw is a random number that decides who is in the sample. Languages that are null are left out, and so are
    texts without letters; repeated rows count each. Rows that tie in draw are in order of their n-grams. Without rows, all is "und"."""
    eligible = rows.where("lang is not null")
    sums = eligible.select("text").mapInArrow(_sums, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas().set_index("bucket").n
    total = int(sums.get(-1, 0))
    idf = np.log((1 + total) / (1 + sums.drop(-1, errors="ignore").reindex(range(BUCKETS), fill_value=0).to_numpy())) + 1.0
    if not total:
        return Model([], idf, np.zeros((0, BUCKETS)), np.zeros(0))
    lettered = eligible.where(F.col("text").rlike(r"\p{L}"))
    quota = F.ceil(F.greatest(F.lit(sample / total) * F.col("n"), F.least("n", F.lit(least))))
    quotas = lettered.groupBy("lang").agg(F.count("*").alias("n")).withColumn("quota", quota)  # a row for each language
    share = F.least(F.lit(1.0), 1.2 * F.col("quota") / F.col("n") + 10 / F.col("n"))
    may = lettered.join(F.broadcast(quotas), "lang").where(F.col("draw") <= -(2.0**63) + share * 2.0**64)
    first = Window.partitionBy("lang").orderBy("draw", F.xxhash64("at", "counts"))
    chosen = may.select("draw", "lang", "text", "quota").mapInArrow(_sparse, "draw long, lang string, at binary, counts binary, quota long").withColumn("nth", F.row_number().over(first)).where("nth <= quota")
    got = chosen.orderBy("draw", "lang", F.xxhash64("at", "counts")).select("lang", "at", "counts").collect()  # about sample rows and least for each language, each of 48 KB at most
    languages = sorted({r.lang for r in got})
    model = Model(languages, idf, np.zeros((len(languages), BUCKETS)), np.zeros(len(languages)))
    data = []
    for r in got:
        counts = np.zeros(BUCKETS, np.int64)
        counts[np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["counts"], np.uint32)
        data.append((*model.features(counts), languages.index(r.lang)))
    return train(languages, idf, data) if data else model


def _predict(shared):
    """Rows whose last column is the text, with lang_pred and score in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            n = batch.num_columns - 1
            got = [model.predict(t.as_py()) for t in batch.column(n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array([x for x, _ in got], pa.string()), pa.array([p for _, p in got], pa.float64())], [*batch.schema.names[:n], "lang_pred", "score"])

    return run


def may_learn(key: Column) -> Column:
    """Which documents a query learns from: those whose crc32(doc_id as text) mod 3 is not 1. A null id is never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def trained_on(docs: DataFrame, sample: int = SAMPLE) -> Model:
    return learn(docs.where(may_learn(docs["doc_id"])).select(F.xxhash64(F.lit("language"), "doc_id").alias("draw"), "lang", "text"), sample)


def identify(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns `keep` of each row of docs, with lang_pred and score (probability). Only the text is looked at, all of it.

    Null texts and texts without a letter are "und" with score 0. Repeated rows give repeated results, an empty table an empty one."""
    rows = docs.select(*[docs[f"`{c}`"] for c in keep], docs["text"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_predict(shared), StructType([*rows.schema.fields[:-1], *StructType.fromDDL("lang_pred string, score double")]))


def keep_identified(docs: DataFrame, model: Model, least: float = 0.4) -> DataFrame:
    """docs without the rows whose language cannot be told: no letter, or a probability below `least`. All columns are kept, whatever their names; each
    row is judged by its own text, and an empty table gives an empty result."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["text"].alias("text"))
    return identify(rows, model, "row").where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from the rows that may_learn admits. Nulls, empty and long texts, ties, repeated rows and empty tables: as in
    learn and identify; a row without an id is not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, trained_on(docs), "doc_id")
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
