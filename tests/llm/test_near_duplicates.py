import itertools
import random

import numpy as np

from echograms.llm import near_duplicates as nd
from echograms.llm.components import components
from tests.llm.test_decontamination import thue_morse
from tests.llm.helpers import documents, groups, odd_rows, shingles


def brute(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in groups(sets, links).items()}


def found(spark, rows, percent):
    got = nd.near_duplicate_groups(documents(spark, rows), percent).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in got}, len(got)


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


def test_groups_equal_brute_force(spark):
    rng = random.Random(1)
    rows, at = [], 0
    for _ in range(12):
        base = " ".join(f"w{rng.randrange(4000)}" for _ in range(150))
        for k in [0, 0, 1, 1, 2, 3, 5, 9]:
            rows.append((at * 7 % 1009, edited(rng, base, k)))
            at += 1
    for percent in (80, 85):
        got, n = found(spark, rows, percent)
        assert got == brute(rows, percent) and n == len(rows)


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = " ".join(f"w{i}" for i in range(140))
    rows = [(i, edited(rng, base, rng.choice([0, 1, 2, 3, 4, 6]))) for i in range(150)]
    got, _ = found(spark, rows, 85)
    assert got == brute(rows, 85)


def test_odd_rows(spark):
    got, n = found(spark, odd_rows(), 85)
    assert n == len(odd_rows()) and got == brute(dict(odd_rows()).items(), 85)
    kept = nd.keep_one_each(documents(spark, odd_rows())).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 3, 4, 5, 6, 7, 8, 9]


def test_empty_table_and_null_ids(spark):
    assert nd.near_duplicate_groups(documents(spark, [])).collect() == []
    got = nd.near_duplicate_groups(documents(spark, [(None, "a b"), (1, "A  b"), (None, "c"), (None, None), (None, "c")])).collect()
    assert sorted(str(tuple(r)) for r in got) == ["(1, 1, 1)", "(None, 0, None)", "(None, 1, 1)", "(None, 1, None)", "(None, 1, None)"]
    kept = nd.keep_one_each(documents(spark, [(None, "a b"), (2, "a b"), (1, "a b"), (None, "c"), (None, "C"), (None, "")]))
    assert sorted(str((r.doc_id, r.text.lower())) for r in kept.collect()) == ["(1, 'a b')", "(None, '')", "(None, 'c')"]
    assert kept.columns == documents(spark, []).columns


def test_texts_of_one_id_are_compared_on_their_own(spark):
    rng = random.Random(7)
    one, two = (" ".join(f"{c}{rng.randrange(4000)}" for _ in range(120)) for c in "vw")
    got = nd.near_duplicate_groups(documents(spark, [(1, one), (1, two), (2, one + " x"), (3, two + " y")])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1)} and len(got) == 4
    got = nd.near_duplicate_groups(documents(spark, [(5, one), (5, two), (2, one + " x"), (3, two + " y")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(2, 2), (3, 3), (5, 2), (5, 3)]


def test_long_words_are_compared(spark):
    texts = thue_morse()
    got, _ = found(spark, [(1, texts[0]), (2, texts[1]), (3, texts[0].upper() + "\n")], 85)
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 1)}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
    a, b = pool[:300], pool[100:]
    owner = np.repeat([0, 1], 300)
    s = nd.superminhash(owner, np.concatenate([a, b]), 2, 80)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.2
    one = nd.superminhash(np.zeros(1, int), pool[:1], 1, 80)
    assert (one != nd.EMPTY).all()  # one element fills all slots


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(0, 200)] + [(1000 + i, 1000) for i in range(300)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}


def test_rows_are_kept_by_their_own_text(spark):
    rows = [(None, "a b"), (None, "a b"), (None, "A b"), (None, "c d"), (None, None), (None, None), (None, " "), (4, "e f"), (4, "g h"), (4, "g h"), (3, "G h"), (9, "e f")]
    kept = nd.keep_one_each(documents(spark, rows)).collect()
    got = sorted(str((r.doc_id, (r.text or "-").lower())) for r in kept)
    assert got == sorted(map(str, [(None, "a b"), (None, "c d"), (None, "-"), (None, "-"), (None, " "), (4, "e f"), (3, "g h")]))


def test_columns_named_like_internal_ones(spark):
    docs = documents(spark, [(1, "a b"), (2, "A b")]).withColumnsRenamed({"size": "node", "score": "row", "lang": "rep"})
    kept = nd.keep_one_each(docs)
    assert kept.columns == docs.columns and [(r.doc_id, r.node, r.row) for r in kept.collect()] == [(1, "x", "y")]
