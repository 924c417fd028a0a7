import hashlib
import random

from pyspark.sql import functions as F

from echograms.llm import fingerprints as fp
from tests.llm.helpers import WORDS, documents, lower, odd_rows, prose, shingles


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(spark, texts):
    """Fingerprints by the definition, text by text and bin by bin; only the hash of five words comes from Spark."""
    runs = []
    for t in texts:
        w = WORDS.findall(lower(t))
        runs.append([(w + [None] * 5)[i : i + 5] if len(w) < 5 else w[i : i + 5] for i in range(max(1, len(w) - 4) if w else 0)])
    rows = [(i, *r) for i, all_ in enumerate(runs) for r in all_]
    hashed = spark.createDataFrame(rows, "i int, a string, b string, c string, d string, e string").select("i", F.xxhash64("a", "b", "c", "d", "e").alias("h")).collect() if rows else []
    out = []
    for i, _ in enumerate(texts):
        bins = {}
        for r in hashed:
            if r.i == i:
                bins.setdefault(r.h % fp.BINS, []).append((r.h % 2**64) >> 24)
        if not bins:
            out.append(fp.EMPTY)
            continue
        digits = ""
        for b in range(fp.BINS):
            at = next(x for x in [b, *[(fp.STARTS[b] + a * fp.STEPS[b]) % fp.BINS for a in range(fp.BINS)]] if x in bins)
            digits += f"{min(bins[at]) % 256:02x}"
        out.append(digits)
    return out


def run(spark, folder, rows):
    documents(spark, rows).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return fp.op5_fingerprints(spark, str(folder)).collect()


def test_fingerprints_edits_and_likeness(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i * 3, prose(rng, rng.choice([1, 4, 7, 12, 30, 60, 200, 900]), " ".join(f"w{k}é" for k in range(300)))) for i in range(80)] + [(1000 + i, t) for i, (_, t) in enumerate(odd_rows()) if i != 5]
    got = {r.doc_id: r for r in run(spark, tmp_path, rows)}
    assert len(got) == len(rows)
    texts = [t or "" for _, t in rows]
    edited = [t[: len(t) - len(t) // 4] + texts[(k + 1) % len(texts)][: len(t) // 4] for k, t in enumerate(texts)]
    want = brute(spark, texts + edited)
    errors = []
    for k, (i, _) in enumerate(rows):
        r, own, new, following = got[i], want[k], want[len(rows) + k], want[(k + 1) % len(rows)]
        assert (r.n_chars, r.edited_sha256) == (len(texts[k]), hashlib.sha256(edited[k].encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (own, new)
        for near, other in ((r.near_edited, new), (r.near_next, following)):
            same = sum(own[j : j + 2] == other[j : j + 2] for j in range(0, fp.HEX, 2)) / fp.BINS
            assert abs(near - (1.0 if own == other else 0.0 if fp.EMPTY in (own, other) else max(0.0, (same - 1 / 256) / (255 / 256)))) < 1e-9
        errors += [abs(r.near_edited - jaccard(shingles(texts[k]), shingles(edited[k]))), abs(r.near_next - jaccard(shingles(texts[k]), shingles(texts[(k + 1) % len(rows)])))]
    assert sum(errors) / len(errors) < 0.03 and max(errors) < 0.25


def test_every_order_meets_every_bin():
    assert all(sorted((s + a * t) % fp.BINS for a in range(fp.BINS)) == list(range(fp.BINS)) for s, t in zip(fp.STARTS, fp.STEPS))


def test_equal_texts_have_equal_fingerprints(spark):
    docs = documents(spark, [(1, "A b c d e f"), (2, "A b c d e f"), (3, None), (4, ""), (5, "a B c d e f")]).withColumnsRenamed({"size": "packed", "score": "minima", "lang": "row"})
    rows = fp.fingerprints(docs)
    assert rows.columns == [*docs.columns, "fingerprint"]
    by = {r.doc_id: r for r in rows.collect()}
    assert by[1].fingerprint == by[2].fingerprint == by[5].fingerprint and by[3].fingerprint == by[4].fingerprint == fp.EMPTY and (by[1].packed, by[1].minima) == ("x", "y")


def test_one_document_repeated_rows_null_ids_and_none(spark, tmp_path):
    assert run(spark, tmp_path / "a", [(7, "abcd efgh")])[0].near_next == 1.0
    assert run(spark, tmp_path / "b", []) == []
    assert len(run(spark, tmp_path / "c", [(1, "x y"), (1, "x y"), (2, "z")])) == 3
    rows = [(9, f"t{i} and more words") for i in range(60)] + [(None, f"n{i} of these") for i in range(40)] + [(i, f"own text {i}") for i in range(100, 110)]
    got = run(spark, tmp_path / "d", rows)
    assert len(got) == len(rows)
    tie = {r.text: r.h for r in spark.createDataFrame([(t,) for _, t in rows], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, tie[r[1]]))
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 4] + order[(k + 1) % len(order)][1][: len(t) // 4]).encode()).hexdigest() for k, (_, t) in enumerate(order))
    assert sorted(r.edited_sha256 for r in got) == want


def test_likeness_corrects_for_chance(spark):
    row = spark.createDataFrame([("00" * fp.BINS, "11" * fp.BINS, "00" * 200 + "ff" * 56)], "a string, b string, c string").select(fp.likeness(F.col("a"), F.col("b")).alias("x"), fp.likeness(F.col("a"), F.col("c")).alias("y")).first()
    assert row.x == 0.0 and abs(row.y - (200 / 256 - 1 / 256) / (255 / 256)) < 1e-9
