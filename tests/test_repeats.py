import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echograms.functions.suffix_kernels import RangeOrder, RepeatTree, SuffixOrder, greedy_bits
from echograms.operators import repeats, suffixes
from tests import brute

def grown(rules, size):
    """A word that maps each of its letters to the rules' words, from its first letter on, cut to a size."""
    word = "a"
    while len(word) < size:
        word = "".join(rules[c] for c in word)
    return word[:size]


#: Periodic, nearly periodic, square-free (three letters), Fibonacci, Thue-Morse and period-doubling words, letters outside ASCII, and the shortest ones.
WORDS = [
    "", "q", "qq", "qr", "rq", "q" * 23, "r" + "q" * 11, "q" * 11 + "r", "pqr" * 9, "pqr" * 5 + "pq", "pqrs" * 4 + "t" + "pqrs" * 3, ("pq" * 4 + "r") * 3,
    grown({"a": "abc", "b": "ac", "c": "b"}, 45), grown({"a": "ab", "b": "a"}, 55), grown({"a": "ab", "b": "ba"}, 48), grown({"a": "ab", "b": "aa"}, 40), "é漢é漢é🎈🎈é", "🎈" * 6 + "漢",
]


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "text_id long, body string")


def samples():
    rng = random.Random(20)
    return WORDS + ["".join(rng.choice("abcdefghij"[:k]) for _ in range(rng.choice([3, 17, 40]))) for k in (1, 2, 3, 5, 10) for _ in range(6)]


def test_suffix_order_and_common_prefixes(spark):
    values = samples()
    got = {}
    for r in suffixes.suffix_array(texts(spark, values)).collect():
        got.setdefault(r.text_id, {})[r.rank] = (r.pos, r.lcp, r.left)
    for i, t in enumerate(values):
        order = brute.suffix_order(t)
        want = {k: (p, brute.common(t[p:], t[order[k + 1] :]) if k + 1 < len(order) else 0, t[p - 1] if p else "") for k, p in enumerate(order)}
        assert got.get(i, {}) == want


def test_known_order_of_a_word(spark):
    rows = sorted(suffixes.suffix_array(texts(spark, ["Mississippi\u0000"])).collect(), key=lambda r: r.rank)
    assert [r.pos for r in rows] == [11, 0, 10, 7, 4, 1, 9, 8, 6, 3, 5, 2]
    assert [r.lcp for r in rows] == [0, 0, 1, 1, 4, 0, 1, 0, 2, 1, 3, 0]
    inverse = suffixes.inverse_suffix_array(suffixes.suffix_array(texts(spark, ["Mississippi\u0000"]))).orderBy("pos").collect()
    assert [r["rank"] for r in inverse] == [1, 5, 11, 9, 4, 10, 8, 3, 7, 6, 2, 0]


def test_transform_and_its_inverse(spark):
    values = samples()
    bwt = suffixes.burrows_wheeler(texts(spark, ["Mississipi", *values]))
    first = bwt.where("text_id = 0").first()
    assert (first.bwt, first.prim) == ("ipssMissii", 0)
    back = {r.text_id: r.body for r in suffixes.inverse_burrows_wheeler(bwt).collect()}
    assert back == {i: t for i, t in enumerate(["Mississipi", *values]) if t}


def test_maximal_repeats(spark):
    values = samples()
    rows = repeats.maximal_repeats(texts(spark, values)).collect()
    got = {}
    for r in rows:
        got.setdefault(r.text_id, {})[r.pattern] = r.occs
    assert got == {i: {w: len(p) for w, p in brute.repeats(t).items()} for i, t in enumerate(values) if brute.repeats(t)}


def test_supermaximal_repeats_and_occurrences(spark):
    values = samples()
    table = texts(spark, values)
    order = suffixes.suffix_array(table)
    rows = repeats.with_pattern(repeats.supermaximal_repeats(table), table).collect()
    got = {}
    for r in rows:
        got.setdefault(r.text_id, {})[r.pattern] = r.occs
    assert got == {i: {w: len(p) for w, p in brute.supermaximal(t).items()} for i, t in enumerate(values) if brute.supermaximal(t)}
    places = {(r.text_id, r.len, r.first_rank): r.ps for r in repeats.occurrences(repeats.maximal_repeats(table), order).groupBy("text_id", "len", "first_rank").agg(F.sort_array(F.collect_list("pos")).alias("ps")).collect()}
    for (i, n, _), p in places.items():
        assert brute.repeats(values[i])[values[i][p[0] : p[0] + n]] == p


def test_coverage_and_previous_repeats(spark):
    values = samples()
    table = texts(spark, values)
    order = suffixes.suffix_array(table)
    cover = {(r.text_id, r.pos): r.cover for r in repeats.covered_positions(repeats.covered_runs(table)).collect()}
    assert cover == {(r.text_id, r.pos): r.cover for r in repeats.coverage(repeats.longest_starts(table)).collect()}
    starts, ends = ({(r.text_id, r.pos): r.len for r in f(table).collect()} for f in (repeats.longest_starts, repeats.longest_ends))
    previous = {(r.text_id, r.pos): (r.len, r.delta) for r in repeats.longest_previous(repeats.previous_runs(table)).collect()}
    for i, t in enumerate(values):
        want, best = [0] * len(t), [(0, 0)] * len(t)
        for w, places in brute.repeats(t).items():
            for k, p in enumerate(places):
                for q in range(p, p + len(w)):
                    want[q] = max(want[q], len(w))
                if k and len(w) > best[p][0]:
                    best[p] = (len(w), p - places[k - 1])
        assert [cover[i, p] for p in range(len(t))] == want
        assert [previous[i, p] for p in range(len(t))] == best
        twice = {w for w in brute.substrings(t) if any(t.startswith(w, k) for k in range(t.find(w) + 1, len(t)))}
        assert [starts[i, p] for p in range(len(t))] == [max((len(w) for w in twice if t.startswith(w, p)), default=0) for p in range(len(t))]
        assert [ends[i, p] for p in range(len(t))] == [max((len(w) for w in twice if t[: p + 1].endswith(w)), default=0) for p in range(len(t))]


def test_pairs_and_sides(spark):
    pairs = spark.createDataFrame([(1, "abcabx", "zzabcq"), (2, "", "aa"), (3, "aa", None)], "text_id long, body string, other string")
    rows = {(r.text_id, r.pattern): (r.n_left, r.n_right) for r in repeats.pair_repeats(pairs).collect()}
    assert rows[1, "abc"] == (1, 1) and rows[1, "ab"] == (2, 1) and rows[1, "z"] == (0, 2) and rows[2, "a"] == (0, 2) and rows[3, "a"] == (2, 0)
    assert {r.pattern for r in repeats.one_sided(repeats.pair_repeats(pairs), "right").collect()} == {"z", "a"}


def test_maximal_intervals(spark):
    rng = random.Random(21)
    rows = [(k, a, a + rng.randint(1, 9)) for k in range(5) for a in [rng.randint(0, 30) for _ in range(12)]]
    got = {tuple(r) for r in repeats.maximal_intervals(spark.createDataFrame(rows, "k long, start long, end long"), "k").collect()}
    assert got == {r for r in rows if not any(o != r and o[0] == r[0] and o[1] <= r[1] and o[2] >= r[2] for o in rows)}


@pytest.mark.parametrize("separator", [".", "||", "\\E"])
def test_no_pattern_crosses_a_separator(spark, separator):
    text = separator.join(["ab", "", "ab"])
    rows = suffixes.split_texts(texts(spark, [text]), separator).orderBy("part").collect()
    assert [(r.start, r.body) for r in rows] == [(0, "ab"), (2 + len(separator), ""), (2 + 2 * len(separator), "ab")]


def test_previous_repeats_of_many_texts_at_once():
    rng = random.Random(22)
    for _ in range(150):
        values = ["".join(rng.choice("abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(30))) for _ in range(3)]
        order = SuffixOrder(values)
        length, distance = (x.tolist() for x in RepeatTree(order).previous())
        for i, t in enumerate(values):
            a, b = order.offsets[i], order.offsets[i + 1]
            assert list(zip(length[a:b], distance[a:b], strict=True)) == brute.previous(t)
            assert all(greedy_bits(length[a:b], distance[a:b], c, d) == brute.code_cost(t, c, d) for c, d in ((8, True), (3, True), (3, False)))


def test_previous_repeats_of_a_long_periodic_text(spark):
    n = 200_000
    runs = repeats.previous_runs(texts(spark, ["q" * n, "pqrstuv" * (n // 7)])).orderBy("text_id", "start").collect()
    assert [tuple(r)[1:] for r in runs if r.text_id == 0] == [(0, 1, 0, 0), (1, n - 1, n - 1, 1)]
    size = n // 7 * 7  # only strings that start with p are preceded by different characters, or by none
    assert [tuple(r)[1:] for r in runs if r.text_id == 1] == [(0, 7, 0, 0)] + [x for i in range(7, size, 7) for x in ((i, 1, size - i, 7), (i + 1, 6, 0, 0))]


def test_nearest_smaller_entry_of_a_range():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 100):
        values = rng.permutation(n)
        order = RangeOrder(values)
        for _ in range(50):
            low = int(rng.integers(0, n))
            high = int(rng.integers(low + 1, n + 1))
            value = int(rng.integers(0, n + 1)) if n > 1 else 1
            below = [x for x in values[low:high].tolist() if x < value]
            if below and value < n:
                assert order.before(np.array([low]), np.array([high]), np.array([value])).tolist() == [max(below)]


def test_sums_of_previous_repeats_leave_the_task(spark):
    rng = random.Random(23)
    values = ["", None, "x", "ab" * 40 + "c" + "ab" * 30, "q" * 90, "".join(rng.choice("abc") for _ in range(200)), "".join(rng.choice("ab") for _ in range(150)) * 2]
    got = {r.text_id: tuple(r)[1:] for r in repeats.previous_statistics(texts(spark, values)).collect()}
    for i, t in enumerate(values):
        want = brute.previous(t or "")
        lengths, distances = [x for x, _ in want], [x for _, x in want]
        assert got[i] == (sum(x > 0 for x in lengths), sum(lengths), max(lengths, default=0), sum(distances), max(distances, default=0))
