import hashlib
import random
from collections import defaultdict

from echograms.llm import decontamination as dc
from echograms.llm.runtime import Bits
from tests.llm.helpers import PLAIN, documents, lower, odd_rows, prose


def brute(rows, items, size=10):
    windows = defaultdict(set)
    for i, t in items:
        w = PLAIN.findall(lower(t))
        k = min(size, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[a : a + k])].add(str(i))
    out = []
    for i, t in rows:
        w, hit, own = PLAIN.findall(lower(t)), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit |= set(range(a, a + k))
                    own |= windows[tuple(w[a : a + k])]
        out.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()))
    return sorted(out)


def check(spark, rows, items):
    got = dc.mark_contaminated(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got) == brute(rows, items)


def cases():
    rng = random.Random(4)
    items = [(i, prose(rng, rng.choice([1, 3, 9, 10, 11, 30]))) for i in range(12)] + [(50, None), (51, ""), (52, "!!"), (10, prose(rng, 14))]
    rows = []
    for i in range(40):
        text = prose(rng, 30) + " " + rng.choice(items)[1].__str__().upper() + "-" + prose(rng, 12)
        rows.append((i, text))
    return rows + [(100 + i, t) for i, (_, t) in enumerate(odd_rows())], items


def test_marks_equal_brute_force(spark):
    check(spark, *cases())


def thue_morse():
    """Two different words of 1024 letters that every polynomial hash modulo 2^64 takes for the same."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_long_words_are_compared(spark):
    one, other = thue_morse()
    check(spark, [(1, one), (2, other), (3, f"x {one.upper()} y"), (4, one + one)], [(1, one), (2, f"p {other}")])


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    everything = Bits(1 << 15)
    everything.table[:] = 255  # all spans pass the tables: only the join decides
    monkeypatch.setattr(dc, "bit_table", lambda df, column, n: everything)
    rows, items = cases()
    check(spark, rows[:8], items)


def test_empty_tables(spark):
    rows, items = cases()
    check(spark, rows, [])
    check(spark, [], items)
    kept = dc.drop_contaminated(documents(spark, [(1, "a b c"), (2, "x A, b!"), (3, None)]), spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [3]


def test_rows_and_items_without_an_id(spark):
    rows = [(None, "a b c"), (None, "clean"), (None, None), (7, "x a b"), (7, "clean too"), (7, "clean too"), (8, "p q")]
    docs, items = documents(spark, rows), spark.createDataFrame([(1, "a b"), (None, "p q"), (None, "a b")], "item_id long, text string")
    kept = dc.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(map(str, [rows[1], rows[2], rows[4], rows[5]]))
    [only] = dc.mark_contaminated(docs, items).where("doc_id = 8").collect()
    assert (only.n_hit, only.n_items, only.items_sha256) == (2, 0, hashlib.sha256(b"").hexdigest())
    nobody = spark.createDataFrame([(None, "p q")], "item_id long, text string")
    assert len(dc.drop_contaminated(docs, nobody).collect()) == len(rows) - 1


def test_columns_named_like_internal_ones(spark):
    docs = documents(spark, [(1, "a b c"), (2, "clean")]).withColumnsRenamed({"size": "text_key", "score": "row", "lang": "hits"})
    kept = dc.drop_contaminated(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    assert kept.columns == docs.columns and [(r.doc_id, r.text_key, r.row) for r in kept.collect()] == [(2, "x", "y")]
