import random
from collections import Counter

import numpy as np

import corpus_pipeline
from echograms.llm.packing import CONTEXT
from echograms.llm.tokens import encoder, read_vocabulary
from tests.llm.helpers import documents, groups, lower, odd_rows, shingles
from tests.llm.test_classifiers import TONGUES, sentence
from tests.llm.test_decontamination import brute as contaminated


def write_tables(spark, folder, rows, items):
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, out = docs.columns, {"documents": docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        out[name] = docs.collect()
    return out


def test_every_stage(spark, tmp_path):
    rng = random.Random(30)
    langs = list(TONGUES)
    rows = [(i, sentence(rng, langs[i % 4], 60), langs[i % 4], rng.choice("abc")) for i in range(200)]
    copies = [(500 + i, rows[i * 3][1] + (" tail" if i % 2 else ""), rows[i * 3][2], "b") for i in range(30)]
    item = "alpha beta gamma delta one two three four five six seven"
    leaks = [(700 + i, sentence(rng, "en", 30) + " " + item.upper() + " " + sentence(rng, "en", 20), "en", "c") for i in range(5)]
    junk = [(800, "1234 5678 !!", None, "a"), (801, None, None, "a")]
    rows = rows + copies + leaks + junk + [(900 + i, t, None, None) for i, (_, t) in enumerate(odd_rows())]
    folder = str(tmp_path / "sf")
    write_tables(spark, folder, rows, [(1, item)])
    got = stages(spark, folder)
    kept = {r.doc_id for r in got["language_id"]}
    assert not kept & {800, 801, 900, 901, 902} and kept >= set(range(200)) | {r[0] for r in copies + leaks}
    texts = {r.doc_id: r.text for r in got["language_id"]}
    sets = {i: shingles(t) for i, t in texts.items()}
    inverse = {}
    for i, s in sets.items():
        for x in s:
            inverse.setdefault(x, []).append(i)
    near = {(a, b) for l in inverse.values() for a in l for b in l if a < b}
    links = [(a, b) for a, b in near if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert {r.doc_id for r in got["near_duplicates"]} == set(groups(sets, links).values())
    left = [(r.doc_id, r.text) for r in got["near_duplicates"]]
    bad = {i for i, _, n, _, _ in contaminated(left, [(1, item)]) if n}
    assert bad >= {700, 701} and {r.doc_id for r in got["decontamination"]} == {i for i, _ in left} - bad
    times = Counter(r.doc_id for r in got["mixing"])
    assert set(times) <= {r.doc_id for r in got["decontamination"]} and max(times.values()) <= 3
    assert all(r.text == texts[r.doc_id] for r in got["mixing"])
    enc, whole = encoder(read_vocabulary()), Counter()
    for r in got["token_ids"]:
        ids = np.frombuffer(r.ids, np.uint16)
        assert len(ids) == CONTEXT
        for doc, a, b in zip(r.doc_ids, r.cu_seqlens, r.cu_seqlens[1:]):
            whole[doc] += b - a
    want = Counter()
    for r in got["mixing"]:
        if r.text:
            want[r.doc_id] += len(enc.ids(r.text)) + 1
    assert whole == want and lower("A") == "a"


def test_run_and_empty_tables(spark, tmp_path):
    folder = str(tmp_path / "none")
    write_tables(spark, folder, [], [])
    assert corpus_pipeline.run(spark, folder).collect() == []
