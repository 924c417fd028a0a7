import random
import re
from collections import defaultdict
from itertools import permutations

from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, WORDS, odd_rows, prose

from echograms.llm.filter_audit import counters, filter_audit, retract, text_mask, update_counters


def mask_of(text):
    words = WORDS.findall(text)
    fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)))
    return sum(1 << i for i, x in enumerate(fails) if x)


def masks(rows):
    """(part, mask) of each row (doc_id, text, lang)."""
    least = {}
    for doc, text, _ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    return [(lang or "", mask_of(text or "") | (16 if doc is not None and doc > least[text or ""] else 0)) for doc, text, lang in rows]


def brute(rows, labels):
    """The report, by applying every order to every row."""
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    out = defaultdict(lambda: [0] * 6)
    removed_by = defaultdict(int)
    for (doc, _, _), (part, mask) in zip(rows, masks(rows), strict=True):
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, letter in enumerate(order, 1):
                cell, fails = out[part, order, step], mask >> "ABCDE".index(letter) & 1
                if fails and not gone:
                    cell[1] += 1
                    cell[4] += doc in good
                    cell[5] += doc in toxic
                    removed_by[part, letter] += 1
                cell[2] += bool(fails and gone)
                cell[3] += mask == 1 << "ABCDE".index(letter)
                gone = gone or fails
                cell[0] += not gone
    return sorted((*k, *v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def corpus():
    rng = random.Random(8)
    text = [prose(rng, 250), prose(rng, 250, " ".join(f"w{i}" for i in range(4000))), "AB " * 210, " ".join(f"x{i}" for i in range(220)), "a # b", "É" * 30 + "Z", "é" * 40 + "Z"]
    rows = [(rng.randrange(60), rng.choice(text), rng.choice(("en", "de", None, ""))) for _ in range(150)]
    rows += [(None, text[0], "en"), (None, None, None)] + [(r[0], r[1], "fr") for r in odd_rows()]
    return rows, [(i, rng.choice((0, 1, None)), rng.choice((0, 1))) for i in range(40)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]


def tables(spark, rows, labels, folder, parts):
    full = [(r[0], r[1], r[2], "s", len(r[1] or ""), "x", "y") for r in rows]
    for i in range(parts):  # one file each, in this order
        spark.createDataFrame(full[i::parts], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/documents.parquet")
    return f"{folder}/documents.parquet", spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_matches_brute_force(spark, tmp_path):
    rows, labels = corpus()
    path, marks = tables(spark, rows, labels, tmp_path, 6)
    want = brute(rows, labels)
    for parameters in ({}, {"files_a_batch": 1, "keys": 3}):
        assert sorted(tuple(r) for r in filter_audit(spark, path, marks, **parameters).collect()) == want, parameters


def test_only_new_files_are_read_and_earlier_rows_are_taken_back(spark, tmp_path):
    first, second = [(i, f"text {i % 5}", "en") for i in range(20, 40)], [(i, f"text {i % 7}", "de") for i in range(10)]
    path, marks = tables(spark, first, [], tmp_path, 2)
    folder = f"file://{tmp_path}/audit"
    assert sorted(tuple(r) for r in filter_audit(spark, path, marks, folder, 8, 1).collect()) == brute(first, [])
    tables(spark, second, [], tmp_path, 1)
    flags = spark.createDataFrame([], "id long, good boolean, toxic boolean")
    update_counters(spark, path, flags, folder, 8, 1)
    seen = {(r.part, r["mask"]): r.n for r in counters(spark, folder).collect()}
    want = defaultdict(int)
    for x in masks(first + second):
        want[x] += 1
    assert seen == dict(want)
    update_counters(spark, path, flags, folder, 8, 1)  # nothing new, nothing changes
    assert {(r.part, r["mask"]): r.n for r in counters(spark, folder).collect()} == seen


def test_any_order_of_rows_gives_the_same_counters():
    rng = random.Random(3)
    rows = [(rng.choice("xyz"), rng.choice(("en", "")), 1, rng.random() < 0.5, False, n := rng.randrange(1, 5), True, rng.randrange(4), rng.randrange(1, n + 1)) for _ in range(12)]
    results = set()
    for _ in range(30):
        rng.shuffle(rows)
        texts, total = {}, {}
        for row in rows:
            for k, v in retract(texts, [row]).items():
                total[k] = total.get(k, 0) + v
        results.add(tuple(sorted((k, v) for k, v in total.items() if v)))
    assert len(results) == 1


def test_masks(spark):
    texts = ["", "a", "A", "é" * 33 + "Z", "é" * 32 + "Z", "a b " * 100, "a b " * 99, "x|y", "  \x1c\x85", "a\x0bb", "🎈" * 32 + "Z", "🎈" * 33 + "Z", prose(random.Random(1), 200), "A\nB " * 200]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text_mask(F.col("t")).alias("m")).collect()
    assert {r.t: r.m for r in got} == {t: mask_of(t) for t in texts}


def test_empty_table_and_single_file(spark, tmp_path):
    path, marks = tables(spark, [], [], tmp_path, 1)
    assert filter_audit(spark, path, marks).collect() == []
    path, marks = tables(spark, [(1, "a", "en"), (2, "a", "en")], [(2, 1, 0)], tmp_path / "b", 1)
    file = spark.read.parquet(path).inputFiles()[0]
    assert sorted(tuple(r) for r in filter_audit(spark, file, marks).collect()) == brute([(1, "a", "en"), (2, "a", "en")], [(2, 1, 0)])
