import hashlib
import random
from collections import Counter

from tests.llm.helpers import WORDS, documents, odd_rows, prose

from echograms.llm.substrings import HOT, substring_dedup, window_sketch


def brute(rows, k=35):
    words = [WORDS.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = {p for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for p in range(i, i + k)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted([tuple(r)[:4] for r in df.collect()], key=str)


def corpus():
    rng = random.Random(5)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, short, line = fresh(80), fresh(34), fresh(36)
    rows = [(i, f"{fresh(rng.randrange(60))} {passage}\n{fresh(rng.randrange(60))}") for i in range(20)]
    rows += [(100 + i, f"{fresh(50)}  {short} {fresh(50)}") for i in range(8)]  # a window is longer
    rows += [(200 + i, f"{line} {fresh(9)}") for i in range(3)] + [(300, passage[:200]), (301, passage.upper())]
    rows += [(400, "a b " * 200), (401, "a b " * 60 + fresh(30)), (402, "z " * 35), (403, "z " * 36), (404, "y " * 35)]
    base = fresh(300).split()
    rows += [(500 + i, " ".join(base[:i] + ["changed"] + base[i + 1 :])) for i in range(0, 300, 37)]
    return rows + [(1, rows[0][1]), (None, rows[1][1]), (None, None)] + odd_rows()


def test_matches_brute_force(spark):
    rows = corpus()
    docs = documents(spark, rows).repartition(5)
    assert found(substring_dedup(docs)) == brute(rows)


def test_sketch_and_hot_path_change_nothing(spark):
    rows = corpus()
    docs = documents(spark, rows).repartition(3)
    for parameters in ({"hot": 3}, {"hot": 2}, {"most_bits": 16, "hot": 5}, {"gram": 35}, {"gram": 1}):
        assert found(substring_dedup(docs, **parameters)) == brute(rows), parameters
    assert found(substring_dedup(docs, window=5, gram=2)) == brute(rows, 5)


def test_sketch_never_underestimates(spark):
    import numpy as np

    from echograms.llm.substrings import anchor_runs
    from echograms.llm.wordhash import NOT_SPACE, Words

    rows = corpus()
    sketch = window_sketch(documents(spark, rows).repartition(4), hot=HOT)
    anchors = []
    for r in rows:
        data = np.frombuffer((r[1] or "").encode(), np.uint8)
        w = Words(data, np.array([0, len(data)]), NOT_SPACE, fold=False)
        anchors += anchor_runs(w.hashes(), w.first, 35, 8)[2].tolist()
    many = Counter(anchors)
    names = np.array(list(many), dtype=np.uint64)
    codes = sketch.codes(names)
    assert all(code >= 1 for name, code in zip(names.tolist(), codes.tolist(), strict=True) if many[name] > 1)
    assert (codes == 0).mean() > 0.5


def test_kept_text_and_empty_table(spark):
    rng = random.Random(2)
    shared = prose(rng, 40)
    docs = documents(spark, [(1, "one " + shared + " two"), (2, shared + " three")])
    kept = {r.doc_id: r.kept for r in substring_dedup(docs, with_text=True).collect()}
    assert kept == {1: "one two", 2: "three"}
    assert substring_dedup(documents(spark, [(1, "x")]).limit(0)).collect() == []
