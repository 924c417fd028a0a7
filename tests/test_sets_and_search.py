import random

import pyarrow as pa
from pyspark.sql import functions as F

from echograms.operators import repeats, search, sets, suffixes
from echograms.streaming.matches import streaming_occurrences
from tests import brute


def table(spark, values):
    return spark.createDataFrame(list(values.items()), "text_id long, body string")


def relation(spark, pairs):
    return spark.createDataFrame(pairs, "base_id long, other_id long")


def cases():
    rng = random.Random(22)
    for n in range(12):
        yield {i: "".join(rng.choice("abc"[: 2 + n % 2]) for _ in range(rng.randint(1, 14))) for i in range(5)}


def everything(spark, values, mode):
    t = table(spark, values)
    held = sets.fold(sets.matching_statistics(t, relation(spark, [(0, 1), (0, 2)])), "all")
    banned = sets.fold(sets.matching_statistics(t, relation(spark, [(0, 3), (0, 4)])), "any")
    return t, held, banned, {r.pattern for r in sets.tags(t, held, banned, mode).collect()}


def test_tags_common_and_exclusive(spark):
    for values in cases():
        held = brute.substrings(values[0]) & brute.substrings(values[1]) & brute.substrings(values[2])
        wanted = {w for w in held if w not in values[3] and w not in values[4]}
        t, everywhere, nowhere, minimal = everything(spark, values, "minimal")
        assert minimal == {w for w in wanted if not any(o != w and o in w for o in wanted)}
        common = {r.pattern for r in sets.common_substrings(t, everywhere).collect()}
        assert common == {w for w in held if not any(o != w and w in o for o in held)}
        own = sets.exclusive(repeats.maximal_repeats(t), nowhere).where("text_id = 0")
        assert {r.pattern for r in own.collect()} == {w for w in brute.repeats(values[0]) if w not in values[3] and w not in values[4]}


def test_shortest_tags(spark):
    values = {0: "abcdabcxbcdz", 1: "qqbcdzabcx", 2: "qqbcdzabcx", 3: "abcda", 4: "bcx"}
    assert everything(spark, values, "shortest")[3] == {"z"} and everything(spark, values, "all_shortest")[3] == {"z"}
    assert everything(spark, values, "minimal")[3] == {"abcx", "z"}
    assert everything(spark, {i: "aa" for i in range(5)}, "shortest")[3] == set()


def test_running_fold(spark):
    t = table(spark, {0: "abab", 1: "ab", 2: "b"})
    pairs = relation(spark, [(0, 1), (0, 2)])
    rows = sets.running_fold(sets.matching_statistics(t, pairs), pairs.withColumn("step", F.col("other_id"))).orderBy("pos", "step").collect()
    assert [(r.held_by_all, r.held_by_any) for r in rows] == [(2, 2), (0, 2), (1, 1), (1, 1), (2, 2), (0, 2), (1, 1), (1, 1)]


def found(text, pattern):
    return [i for i in range(len(text) - len(pattern) + 1) if text[i : i + len(pattern)] == pattern] if pattern else []


def test_three_ways_to_search_agree(spark, monkeypatch):
    rng = random.Random(23)
    values = {i: "".join(rng.choice("abé漢"[: 2 + i % 3]) for _ in range(rng.choice([0, 5, 60, 300]))) for i in range(12)}
    words = sorted({"a", "漢", "é" * 3} | {v[a : a + rng.randint(2, 70)] for v in values.values() for a in range(0, len(v), 9) if len(v) > a + 7} | {"zz", ""})
    t, patterns = table(spark, values), spark.createDataFrame([(w, w) for w in words], "pattern_id string, pattern string")
    want = {(i, w, p) for i, v in values.items() for w in words for p in found(v, w)}
    whole = search.pattern_occurrences(t, patterns)
    assert {tuple(r) for r in whole.collect()} == want
    assert {tuple(r) for r in search.chunked_search(t, patterns, 16).collect()} == want
    monkeypatch.setattr(search, "BROADCAST_PATTERNS", 0)
    monkeypatch.setattr(search, "RUN_BYTES", 50)
    monkeypatch.setattr(search, "PATTERNS_A_TASK", 5)
    assert {tuple(r) for r in search.pattern_occurrences(t, patterns).collect()} == want
    per = {r.pattern_id: (r.occs, r.texts) for r in search.pattern_counts(t, patterns).collect()}
    assert per == {w: (sum(x[1] == w for x in want), len({x[0] for x in want if x[1] == w})) for w in words}
    order = suffixes.suffix_array(t)
    own = t.select("text_id").crossJoin(patterns.where("pattern <> ''"))
    ranged = {tuple(r) for r in search.rank_ranges(t, order, own).collect()}
    assert ranged == {tuple(r) for r in search.backward_search(t, own).collect()}
    back = search.positions_of_ranges(order, spark.createDataFrame(sorted(ranged), "text_id long, pattern_id string, from long, to long"))
    assert {tuple(r) for r in back.collect()} == want


def test_counts_need_no_row_for_each_occurrence(spark, monkeypatch):
    """By string, with equal and overlapping patterns and strings that leave early; by occurrences where texts share an id or lengths are many."""
    values = {0: "abababab" * 30, 1: "é漢é漢é", 2: "", 3: "xab", 4: None, 5: "abab"}
    words = ["ab", "ab", "ba", "é漢é", "b", "abababa", "zz", "", None]
    patterns = spark.createDataFrame(list(enumerate(words)), "pattern_id long, pattern string")
    want = {k: (sum(n), sum(x > 0 for x in n)) for k, w in enumerate(words) for n in [[len(found(v or "", w)) for v in values.values()]]}
    t, occurrences = table(spark, values), search.pattern_occurrences
    read = lambda rows: {r.pattern_id: (r.occs, r.texts) for r in rows.collect()}
    monkeypatch.setattr(search, "COUNTED", 2)
    monkeypatch.setattr(search, "pattern_occurrences", None)
    reads = spark.createDataFrame([(i, "a" * (11 - i) + "é" * (i + 1)) for i in range(11)], "pattern_id long, pattern string")  # one length in characters, eleven in bytes
    assert read(search.pattern_counts(t, reads)) == dict.fromkeys(range(11), (0, 0))
    assert read(search.pattern_counts(t, patterns)) == want
    monkeypatch.setattr(search, "pattern_occurrences", occurrences)
    twice = read(search.pattern_counts(t.union(t), patterns))
    assert twice == {k: (2 * a, b) for k, (a, b) in want.items()}
    monkeypatch.setattr(search, "LENGTHS", 1)
    assert read(search.pattern_counts(t, patterns)) == want


def test_known_ranges(spark):
    t = table(spark, {0: "Mississippi\u0000"})
    p = spark.createDataFrame([(0, "ssi", "ssi"), (0, "i", "i")], "text_id long, pattern_id string, pattern string")
    assert {tuple(r)[1:] for r in search.rank_ranges(t, suffixes.suffix_array(t), p).collect()} == {("ssi", 10, 12), ("i", 2, 6)}


def test_stored_suffixes(spark, tmp_path):
    order = suffixes.suffix_array(table(spark, {0: "banana", 1: "abab"}))
    stored = search.store_suffixes(order, str(tmp_path / "index"))
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, order.collect()))
    assert search.open_suffixes(spark, str(tmp_path / "index")).where("text_id = 0 and rank = 0").first().pos == 5


def test_classes(spark):
    rows = search.classified(spark.createDataFrame([(0,), (1,), (5,), (50,)], "occs long"), [1, 2, 10]).collect()
    assert [r["class"] for r in rows] == [0, 1, 2, 3]


def test_stream_of_texts(spark, tmp_path):
    patterns = spark.createDataFrame([("p", "na")], "pattern_id string, pattern string")
    table(spark, {0: "banana"}).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text_id long, body string").parquet(str(tmp_path / "in"))
    q = streaming_occurrences(stream, patterns).writeStream.format("memory").queryName("hits").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    table(spark, {1: "nana"}).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("hits").collect()} == {(0, "p", 2), (0, "p", 4), (1, "p", 0), (1, "p", 2)}


def test_exclusive_supermaximal_is_the_fold_without_a_row_for_each_place(spark):
    rng = random.Random(5)
    texts = ["", "aaaa", "abababab", "é漢é漢é", "x"] + ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 90))) for _ in range(30)]
    t = spark.createDataFrame(list(enumerate(texts)), "text_id long, body string")
    pairs = spark.createDataFrame([(i, (i * 7 + k) % len(texts)) for i in range(len(texts)) for k in range(i % 4)], "base_id long, other_id long")
    whole = sets.exclusive(repeats.supermaximal_repeats(t), sets.fold(sets.matching_statistics(t, pairs), "any"))
    found = sets.exclusive_supermaximal(t, pairs)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.select(*found.columns).collect()))


def test_followers_are_matched_by_one_sort(spark, monkeypatch):
    """The same as pair by pair, over gaps, edges of blocks and runs, ids that repeat, empty texts and nulls; and a text is sorted once for all its pairs."""
    rng = random.Random(31)
    ids = [*range(-70, 5), 9, 10, *range(62, 67), 64, 65, 65, 200, 2**62, 2**62 + 1, 2**63 - 1]
    rows = [(i, "".join(rng.choice("ab\U0001f600") for _ in range(rng.randrange(9)))) for i in ids] + [(3, None), (6, None), (7, "b" * 40), (8, "b" * 50), (11, None)]
    table = spark.createDataFrame(rows, "text_id long, body string")
    small = table.where("text_id < 9e18")  # the plain way adds to ids
    steps = small.select(F.col("text_id").alias("base_id"), F.explode(F.expr("array(text_id + 1, text_id + 2)")).alias("other_id"))
    pairs = steps.join(small.select(F.col("text_id").alias("other_id")), "other_id").select("base_id", "other_id")
    plain = sets.matching_statistics(small, pairs).groupBy("base_id", "other_id").agg(F.sum("len").alias("total"), F.max("len").alias("longest"), F.count_if(F.col("len") >= 5).alias("long_places"))
    assert sorted(map(tuple, sets.follower_matches(table, 2, 5).collect())) == sorted(map(tuple, plain.collect()))

    sorted_points, kernel = [], sets.PairMatches
    monkeypatch.setattr(sets, "PairMatches", lambda texts: sorted_points.append(sum(map(len, texts))) or kernel(texts))
    monkeypatch.setattr(sets, "RUN_POINTS", 1000)
    bodies = ["".join(rng.choice("abc") for _ in range(50)) for _ in range(66)]
    got = sets._follower_matches(2, 5)(pa.table({"block": [0] * 66, "text_id": list(range(66)), "body": bodies, "own": [i < 64 for i in range(66)]}))
    assert got.num_rows == 128 and sum(sorted_points) < 1.2 * sum(map(len, bodies))
