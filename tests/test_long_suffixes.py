import random

import pytest
from pyspark.sql import functions as F

from echograms.operators import long_suffixes, suffixes


def values():
    rng = random.Random(31)
    texts = ["".join(rng.choice("ab" if i % 2 else "abcdé漢🎈 ") for _ in range(rng.randrange(120))) for i in range(12)]
    return [*texts, "", "x", "q" * 150, "ab" * 70, texts[3], texts[3][5:], texts[3] + "z", "\x00a\x00", "\U0010ffff" * 9]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "text_id long, body string")


@pytest.mark.parametrize(("size", "partitions"), [(1, 5), (50, 4)])
def test_pieces_give_the_rows_of_whole_texts(spark, size, partitions):
    texts = table(spark, values())
    pieces = long_suffixes.text_pieces(texts, size).repartition(4)
    got = sorted(tuple(r) for r in long_suffixes.pieced_suffix_array(pieces, partitions).select("text_id", "rank", "pos", "left").collect())
    assert got == sorted(tuple(r) for r in suffixes.suffix_array(texts).select("text_id", "rank", "pos", "left").collect())


def test_one_text_over_many_partitions(spark):
    rng = random.Random(32)
    body = "".join(rng.choice("acgt") for _ in range(900)) + "n" * 1500 + "".join(rng.choice("acgt") for _ in range(300))
    texts = table(spark, [body])
    pieces = long_suffixes.text_pieces(texts, 100).repartition(6)
    got = long_suffixes.pieced_suffix_array(pieces, 6).select("rank", "pos", "left").collect()
    assert sorted(got) == sorted(suffixes.suffix_array(texts).select("rank", "pos", "left").collect())


def test_one_order_of_all_texts(spark):
    texts = values()
    every = sorted(t[p:] for t in texts for p in range(len(t)))
    first = {}
    for i, s in enumerate(every):
        first.setdefault(s, i)
    got = long_suffixes.pieced_suffix_array(long_suffixes.text_pieces(table(spark, texts), 9), 5, one_order=True).collect()
    assert len(got) == len(every)
    assert all(r["rank"] == first[texts[r.text_id][r.pos :]] and r.rest == len(texts[r.text_id]) - r.pos for r in got)


def test_nothing(spark):
    none = spark.createDataFrame([(1, 0, ""), (2, 0, None), (None, 0, "a")], "text_id long, piece long, body string")
    assert long_suffixes.pieced_suffix_array(none).collect() == []
    assert long_suffixes.text_pieces(table(spark, ["", None]), 3).agg(F.count("*")).first()[0] == 0


def test_longest_matches_in_any_other_text(spark):
    texts = values()
    pieces = long_suffixes.text_pieces(table(spark, texts), 20)
    longest = lambda i, p: max((n for n in range(len(texts[i]) - p + 1) if any(texts[i][p : p + n] in t for j, t in enumerate(texts) if j != i)), default=0)
    got = {(r.text_id, r.pos): r.len for r in long_suffixes.matches_anywhere(pieces, partitions=7).collect()}
    assert got == {(i, p): longest(i, p) for i, t in enumerate(texts) for p in range(len(t))}
    some = {(r.text_id, r.pos): r.len for r in long_suffixes.matches_anywhere(pieces, F.col("text_id") % 5 == 0, 3).collect()}
    assert some == {k: v for k, v in got.items() if k[0] % 5 == 0}
    alone = long_suffixes.text_pieces(table(spark, ["abcab"]), 2)
    assert {r.len for r in long_suffixes.matches_anywhere(alone, partitions=3).collect()} == {0}
