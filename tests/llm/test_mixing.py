import random
from collections import Counter, defaultdict

from echograms.llm import mixing as mx
from tests.llm.helpers import WORDS, documents, odd_rows, prose


def targets(sizes, weights=(5, 2, 1), limit=3):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, out, left = set(names), {}, sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        capped = [s for s in open_ if w[s] * level >= limit * sizes[s]]
        if not capped:
            return out | {s: w[s] * level for s in open_}
        for s in capped:
            out[s] = limit * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def corpus():
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.choice([3, 20, 60])), "en", rng.choice(["a", "b", "c", "é", "z", None] + ["b"] * 6)) for i in range(600)]
    return rows + [(1000 + i, t, "en", "odd") for i, (_, t) in enumerate(odd_rows())]


def query(spark, folder, rows):
    documents(spark, rows).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return mx.op2_mixing(spark, str(folder)).collect()


def check_taken(rows, got):
    """Targets equal the plain version; each source's words are within half a document of its target; no row is taken more than 3 times."""
    sizes, longest, by_id = defaultdict(int), defaultdict(int), {}
    for i, t, _, s in rows:
        n = len(WORDS.findall(t or ""))
        sizes[s] += n
        longest[s] = max(longest[s], n)
        by_id[i] = s
    want, taken = targets(sizes), Counter()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(WORDS.findall(t or ""))) for i, t, _, s in rows)
    for r in got:
        s = by_id[r.doc_id]
        assert abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] and r.copies <= 3 and r.taken == r["size"] * r.copies == r["size"] * len(r.draws)
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-6 for s in sizes)


def test_targets_and_taken_words(spark, tmp_path):
    rows = corpus()
    got = query(spark, tmp_path / "a", rows)
    check_taken(rows, got)
    assert sorted(map(str, got)) == sorted(map(str, query(spark, tmp_path / "b", rows[::-1])))
    per = Counter(r.shard for r in mx.mix_plan(documents(spark, rows))[1].collect())
    assert len(per) == 16 and max(per.values()) - min(per.values()) <= 1
    more = mx.mix_plan(documents(spark, rows), shard_words=100)[1].agg({"shard": "max"}).first()[0]
    assert more >= 127  # nothing caps the number of shards


def test_equal_rows_are_rows_of_their_own(spark, tmp_path):
    rows = [(7, "one two three four five six seven eight", "en", "a")] * 40 + [(100 + i, "w " * 5, "en", "b") for i in range(30)] + [(None, "x y z", "en", "c")] * 9
    check_taken(rows, query(spark, tmp_path, rows))
    docs = documents(spark, rows)
    groups = mx.mix_plan(docs)[0].collect()
    want = {r.doc_id: r.times * r.whole + r.extra for r in groups if r.source != "b"}
    mixed = Counter(r.doc_id for r in mx.mixed_rows(docs).collect())
    assert {i: mixed[i] for i in want} == want and max(want.values()) > 9


def test_numbered_goes_in_steps(spark):
    rows = spark.createDataFrame([("a", mx.STEP * 2 + 3), ("b", 0), ("c", 1)], "k string, n long")
    got = mx.numbered(rows, "n").groupBy("k").agg({"nth": "max", "k": "count"}).collect()
    assert sorted(map(tuple, got)) == [("a", mx.STEP * 2 + 3, mx.STEP * 2 + 3), ("c", 1, 1)]


def test_mixed_rows_repeat_whole_documents(spark):
    rows = [r for r in corpus() if r[0] < 1000]
    docs = documents(spark, rows).withColumnsRenamed({"size": "copy", "score": "key", "lang": "row"})
    plan = {r.doc_id: r.whole + r.extra for r in mx.mix_plan(docs)[0].collect()}
    mixed = mx.mixed_rows(docs)
    assert mixed.columns == [*docs.columns, "shard"]
    mixed = mixed.collect()
    assert Counter(r.doc_id for r in mixed) == Counter({k: v for k, v in plan.items() if v})
    texts = dict((r[0], r[1]) for r in rows)
    assert all(r.text == texts[r.doc_id] and (r.copy, r.key, r.row) == ("x", "y", "en") for r in mixed)


def test_empty_and_wordless(spark):
    assert mx.mix_plan(documents(spark, []))[0].collect() == []
    only = mx.mix_plan(documents(spark, [(1, None, "en", None), (2, "", "en", "a")]))[0].collect()
    assert {(r["size"], r.target, r.whole, r.extra) for r in only} == {(0, 0.0, 0, 0)}


def test_query_draws_from_the_tree(spark, tmp_path):
    rows = corpus() + [(2000 + i, t, "en", "wordless") for i, t in enumerate([None, "", " \t"])] + [(None, "no id", "en", "a")] * 2
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = mx.op2_mixing(spark, str(tmp_path)).collect()
    mixed = mx.mixed_rows(spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "source", "text")).collect()
    shards = defaultdict(list)
    for r in mixed:
        shards[r.shard].append(r.doc_id)
    drawn = defaultdict(dict)
    check_taken(rows, got)
    for r in got:
        assert [x.copy for x in r.draws] == list(range(1, r.copies + 1)) and r.taken == r["size"] * len(r.draws)
        assert r.shards == len({x.shard for x in r.draws})
        for x in r.draws:
            assert x.place not in drawn[x.shard]
            drawn[x.shard][x.place] = r.doc_id
    assert len(got) == len(rows) and len(shards) > 1 and any(r.shards > 1 for r in got) and any(not r.copies for r in got)
    assert {s: [p[i + 1] for i in range(len(p))] for s, p in drawn.items()} == dict(shards)


def test_rows_that_differ_anywhere_are_different_rows(spark):
    docs = spark.sql("""
        select 1L doc_id, 's' source, 'one two' text, timestamp'2024-01-01 00:00:00.000100' t, timestamp_ntz'2024-01-01 00:00:00.000100' z, 1.10BD d, x'00' b, named_struct('x', null, 'y', array(1, null)) n, map('a', date'2024-01-01') m
        union all select 1L, 's', 'one two', timestamp'2024-01-01 00:00:00.000400', timestamp_ntz'2024-01-01 00:00:00.000100', 1.10BD, x'00', named_struct('x', null, 'y', array(1, null)), map('a', date'2024-01-01')
        union all select 1L, 's', 'one two', timestamp'2024-01-01 00:00:00.000100', timestamp_ntz'2024-01-01 00:00:00.000400', 1.10BD, x'00', named_struct('x', null, 'y', array(1, null)), map('a', date'2024-01-01')
        union all select 1L, 's', 'one two', timestamp'2024-01-01 00:00:00.000100', timestamp_ntz'2024-01-01 00:00:00.000100', 1.11BD, x'00', named_struct('x', null, 'y', array(1, null)), map('a', date'2024-01-01')
        union all select 1L, 's', 'one two', timestamp'2024-01-01 00:00:00.000100', timestamp_ntz'2024-01-01 00:00:00.000100', 1.10BD, x'0000', named_struct('x', null, 'y', array(1, null)), map('a', date'2024-01-01')
        union all select 1L, 's', 'one two', timestamp'2024-01-01 00:00:00.000100', timestamp_ntz'2024-01-01 00:00:00.000100', 1.10BD, x'00', null, map('a', date'2024-01-01')
        union all select 1L, 's', 'one two', timestamp'2024-01-01 00:00:00.000100', timestamp_ntz'2024-01-01 00:00:00.000100', 1.10BD, x'00', named_struct('x', null, 'y', array(1)), map('a', date'2024-01-01')
        union all select 1L, 's', 'one two', timestamp'2024-01-01 00:00:00.000100', timestamp_ntz'2024-01-01 00:00:00.000100', 1.10BD, x'00', named_struct('x', null, 'y', array(1, null)), map('a', null)
        union all select 1L, 's', 'one two', timestamp'2024-01-01 00:00:00.000100', timestamp_ntz'2024-01-01 00:00:00.000100', 1.10BD, null, named_struct('x', null, 'y', array(1, null)), map('a', date'2024-01-01')
        """)
    assert {r.times for r in mx.mix_plan(docs)[0].collect()} == {1} and mx.mix_plan(docs)[0].count() == 9
    spell = lambda rows: Counter(str(r) for r in rows)
    assert spell(mx.mixed_rows(docs).drop("shard").collect()) == spell(docs.collect())
