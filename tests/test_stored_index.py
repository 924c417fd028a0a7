import io
import random
import re
from contextlib import redirect_stdout

import numpy as np
import pyarrow as pa

from echograms.operators import search, sets, stored_index as si, suffixes
from echograms.plans import catalog
from tests import brute


def values():
    rng = random.Random(41)
    return ["", None, "x", "mississippi", "q" * 60, "ab" * 40, "é漢é🎈é漢", "\x00b\x00", *["".join(rng.choice("abcd"[: 2 + i % 3]) for _ in range(rng.randrange(1, 90))) for i in range(10)]]


def table(spark):
    return spark.createDataFrame(list(enumerate(values())), "text_id long, body string")


def patterns():
    rng = random.Random(42)
    words = {"", "x", "issi", "q" * 30, "q" * 61, "abab" * 7, "baba" * 9 + "b", "é", "漢é", "zz", "\x00"}
    for t in values():
        for _ in range(6 if t else 0):
            a = rng.randrange(len(t))
            words.add(t[a : a + rng.randrange(1, 40)])
    return sorted(words)


def occurrences(t, w):
    return [p for p in range(len(t) - len(w) + 1) if t.startswith(w, p)] if w else []


def test_prefix_index(spark, tmp_path):
    si.store_prefix_index(table(spark), str(tmp_path / "index"), width=5, parts=7)
    asked = spark.createDataFrame([(w, w) for w in [*patterns(), None]], "pattern_id string, pattern string")
    got = si.look_up(spark, str(tmp_path / "index"), asked).collect()
    texts = {i: t for i, t in enumerate(values()) if t}
    assert sorted((r.text_id, r.pattern_id, r.pos) for r in got) == sorted((i, w, p) for i, t in texts.items() for w in patterns() for p in occurrences(t, w))
    order = {i: brute.suffix_order(t) for i, t in texts.items()}
    assert all(order[r.text_id][r["rank"]] == r.pos for r in got)
    ranges = {(r.text_id, r.pattern_id): (r["from"], r["to"]) for r in si.looked_up_ranges(si.look_up(spark, str(tmp_path / "index"), asked)).collect()}
    assert ranges[3, "issi"] == (2, 4)


def test_look_ups_open_few_parts(spark, tmp_path):
    rng = random.Random(43)
    folder = str(tmp_path / "index")
    si.store_prefix_index(spark.createDataFrame([(1, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4000)))], "text_id long, body string"), folder, parts=20)
    found = si.look_up(spark, folder, spark.createDataFrame([(1, "ma"), (2, "mc")], "pattern_id long, pattern string"))
    out = io.StringIO()
    with redirect_stdout(out):
        found.explain("formatted")
    scans = [x for x in out.getvalue().splitlines() if x.startswith("PartitionFilters: [")]
    assert scans and all("part#" in x for x in scans), out.getvalue()
    opened = {n for x in scans for list_ in re.findall(r"IN \(([\d,]+)\)|part#\d+ = (\d+)", x) for n in "".join(list_).split(",")}
    assert 0 < len(opened) <= 3 and spark.read.parquet(f"{folder}/bounds").count() >= 15


def test_empty_index(spark, tmp_path):
    si.store_prefix_index(table(spark).where("body = ''"), str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "a")], "pattern_id long, pattern string")
    assert si.look_up(spark, str(tmp_path / "index"), asked).collect() == []
    si.store_prefix_index(table(spark), str(tmp_path / "full"))
    assert si.look_up(spark, str(tmp_path / "full"), asked.limit(0)).collect() == []


def test_transform_index(spark, tmp_path):
    texts = table(spark)
    si.store_transform_index(texts, str(tmp_path / "index"), block=8, sample=5)
    index = spark.read.parquet(str(tmp_path / "index"))
    assert {r.text_id: r.body for r in si.stored_texts(index).collect()} == {i: t for i, t in enumerate(values()) if t}
    asked = spark.createDataFrame([(i, w, w) for i in range(len(values())) for w in patterns()], "text_id long, pattern_id string, pattern string")
    found = si.search_index(index, asked, 7)
    got = {(r.text_id, r.pattern_id): r.places for r in found.collect()}
    assert got == {(i, w): o for i, t in enumerate(values()) if t for w in patterns() if (o := occurrences(t, w))}
    ranges = sorted(tuple(r)[:4] for r in found.collect())
    assert ranges == sorted(tuple(r) for r in search.backward_search(texts, asked).select("text_id", "pattern_id", "from", "to").collect())


def test_merged_orders(spark, tmp_path):
    texts = table(spark).where("body <> ''")
    si.store_transform_index(texts, str(tmp_path / "index"), block=16, sample=3)
    ids = [i for i, t in enumerate(values()) if t]
    relation = spark.createDataFrame([(a, b) for a in ids for b in ids if (a + b) % 3], "base_id long, other_id long")
    columns = ["base_id", "other_id", "rank", "is_other", "pos"]
    got = si.merged_suffixes(spark.read.parquet(str(tmp_path / "index")), relation).select(columns).collect()
    assert sorted(got) == sorted(sets.pair_suffixes(texts, relation).select(columns).collect())


def test_transform_steps_back():
    rng = random.Random(44)
    for _ in range(40):
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 50)))
        batch = pa.RecordBatch.from_pydict({"text_id": [1], "body": [t]})
        blocks = [r for b in si._blocks(4, 3)([batch]) for r in b.to_pylist()]
        index = si.Transform(blocks)
        assert index.places(np.arange(index.n)).tolist() == [len(t), *brute.suffix_order(t)]


def test_prefix_index_has_a_few_bytes_for_each_suffix_and_shuffles_none(spark, tmp_path):
    rng = random.Random(45)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(60)]
    si.store_prefix_index(spark.createDataFrame(list(enumerate(texts)), "text_id long, body string").coalesce(2), str(tmp_path / "index"), parts=4)
    size = sum(f.stat().st_size for f in (tmp_path / "index" / "suffixes").rglob("*.parquet"))
    assert size < 8 * sum(map(len, texts))
    found = si.look_up(spark, str(tmp_path / "index"), spark.createDataFrame([(1, texts[7][100:150])], "pattern_id long, pattern string"))
    assert (7, 100) in {(r.text_id, r.pos) for r in found.collect()}


def test_packed_rows_are_read_back(monkeypatch):
    monkeypatch.setattr(si, "RUN_POINTS", 40)
    texts = [t or "" for t in values()]
    for width in (1, 3, 12):
        batch = pa.RecordBatch.from_pydict({"text_id": list(range(len(texts))), "body": texts})
        got = []
        for out in si._packed(width, ["b", "q"])([batch]):
            for row in out.to_pylist():
                number, places, ranks, heads = si._unpacked(row, width)
                owners = np.frombuffer(row["owners"], "<i8")
                got += [(int(owners[t]), int(r), int(p), si._spelled(h)) for t, p, r, h in zip(number, places, ranks, heads)]
        assert sorted(got) == [(i, r, p, t[p : p + width]) for i, t in enumerate(texts) for r, p in enumerate(brute.suffix_order(t))]


def test_prefix_index_of_every_few_places(spark, tmp_path, monkeypatch):
    shared = [(i, t) for i, t in enumerate([*values(), "mississippi" * 3, "ÿĀÿ\U0010ffffa"])] + [(3, "issi mississippi issi"), (3, "mississippi")]
    texts = spark.createDataFrame(shared, "text_id long, body string")
    words = sorted({*patterns(), "ÿ", "Ā", "\U0010ffff", "i", "is", "iss", "miss", "mississippim", "pimississippimiss"})
    asked = spark.createDataFrame([(w, w) for w in [*words, None]], "pattern_id string, pattern string")
    want = sorted((i, w, p) for i, t in shared for w in words for p in occurrences(t or "", w))
    for step, width, few in ((2, 5, 200_000), (4, 12, 200_000), (4, 4, 200_000), (7, 3, 200_000), (4, 5, 10), (1, 5, 10)):
        monkeypatch.setattr(si, "BROADCAST_GRAMS", few)
        folder = str(tmp_path / f"index-{step}-{width}-{few}")
        si.store_prefix_index(texts, folder, width=width, parts=5, step=step)
        got = si.look_up(spark, folder, asked).collect()
        assert sorted((r.text_id, r.pattern_id, r.pos) for r in got) == want
        assert all((r["rank"] is None) == (step > 1) for r in got)


def test_grams_are_searched_for_in_few_suffixes_at_a_time(monkeypatch):
    monkeypatch.setattr(si, "HITS", 3)
    text = "abcabcabdabcab" * 5
    for step in (1, 3):
        (row,) = [r for b in si._packed(4, [], step)([pa.RecordBatch.from_pydict({"text_id": [9], "body": [text]})]) for r in b.to_pylist()]
        grams = ["a", "b", "ab", "bc", "abc", "cab", "abda", "zz", "c"]
        found = []
        for _, heads, befores, _ in si._rows_of([pa.RecordBatch.from_pylist([row])]):
            _, places, _, _ = si._unpacked(row, 4)
            for at, gram, shift in si.Asked(grams, 4, step).found(row["low"], row["high"], heads, befores):
                found += zip(gram.tolist(), (places[at] - shift).tolist())
        assert sorted(found) == [(i, p) for i, g in enumerate(grams) for p in occurrences(text, g)]


def test_index_of_documents_is_small_and_read_once(spark, tmp_path, monkeypatch):
    rng = random.Random(47)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [texts[3][10:90], "ab", "." + texts[5][:30] + "." + texts[6][700:703]]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(catalog, "_index_folder", lambda spark, what: str(tmp_path / "index"))
    found = catalog.QUERIES["indexed_occurrences"](spark, str(tmp_path))
    out = io.StringIO()
    with redirect_stdout(out):
        found.explain("formatted")
    assert len([x for x in out.getvalue().splitlines() if x.startswith("PartitionFilters: [")]) == 1, out.getvalue()
    want = sorted((i, p) for w in {x.strip() for t in items for x in t.split(".")} - {""} for i, t in enumerate(texts) for p in occurrences(t, w))
    assert sorted((r.text_id, r.pos) for r in found.collect()) == want
    assert sum(f.stat().st_size for f in (tmp_path / "index" / "suffixes").rglob("*.parquet")) < 4 * sum(map(len, texts))
