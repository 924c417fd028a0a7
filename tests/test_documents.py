"""Queries over whole documents that have no SQL, against plain definitions on a small table."""

import random
from collections import Counter

import pytest

from echograms.functions import codecs
from echograms.operators import search
from echograms.plans.catalog import QUERIES
from tests import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(40)
    texts = ["", "x", "abababab", None, "é漢é漢é漢 é", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"] + ["".join(rng.choice("abcd"[: 2 + i % 3]) for _ in range(60)) for i in range(8)]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{out}/documents.parquet")
    items = ["banana bandana", "cabin ban", "", None, "abracadabra", "nnn acgt nnnnnn"] + ["".join(rng.choice("abcn ") for _ in range(25)) for _ in range(4)]
    spark.createDataFrame([(96 + i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), {i: t for i, t in enumerate(texts) if t is not None}, {96 + i: t for i, t in enumerate(items) if t is not None}


def rows(spark, folder, name):
    return QUERIES[name](spark, folder[0]).collect()


def test_profile_complexity_and_coverage(spark, folder):
    docs = {i: t for i, t in folder[1].items() if t}
    profile = {r.text_id: (r.n, r.longest, r.total) for r in rows(spark, folder, "document_suffix_profile")}
    k = {r.text_id: r.k for r in rows(spark, folder, "document_complexity")}
    cover = {r.text_id: (r.n, r.covered_8, r.covered_32, r.covered_128) for r in rows(spark, folder, "document_repeat_coverage")}
    assert k[0] == 0.0 and set(profile) == set(cover) == set(docs)
    for i, t in docs.items():
        order = brute.suffix_order(t)
        heights = [brute.common(t[a:], t[b:]) for a, b in zip(order, order[1:])]
        assert profile[i] == (len(t), max(heights, default=0), sum(heights)) and abs(k[i] - brute.complexity(t)) < 1e-8
        best = [0] * len(t)
        for w, places in brute.repeats(t).items():
            for p in places:
                for q in range(p, p + len(w)):
                    best[q] = max(best[q], len(w))
        assert cover[i] == (len(t), *(sum(b >= c for b in best) for c in (8, 32, 128)))


def test_repeats(spark, folder):
    found = Counter((r.text_id, r.len, r.occs) for r in rows(spark, folder, "document_maximal_repeats"))
    assert found == Counter((i, len(w), len(p)) for i, t in folder[1].items() for w, p in brute.repeats(t).items())
    places = {(r.text_id, r.first_pos, r.len): r.occs for r in rows(spark, folder, "document_supermaximal_repeats")}
    assert places == {(i, p[0], len(w)): len(p) for i, t in folder[1].items() for w, p in brute.supermaximal(t).items()}


def test_previous_repeats_and_measures(spark, folder):
    got = {r.text_id: tuple(r)[1:] for r in rows(spark, folder, "document_longest_previous")}
    for i, t in folder[1].items():
        want = [x for x in brute.previous(t) if x[0]]
        lengths, distances = [x for x, _ in want], [x for _, x in want]
        assert got[i] == (len(want), sum(lengths), max(lengths, default=0), sum(distances), max(distances, default=0))
    got = {r.text_id: r for r in rows(spark, folder, "document_measures")}
    assert set(got) == {i for i, t in folder[1].items() if t}
    for i, r in got.items():
        want = sizes(folder[1][i])
        assert (r.n - r.zeros, r.est_bytes, r.cost8, r.cost3, r.cost3_free) == tuple(want[m] for m in ("coded", "est_bytes", "cost8", "cost3", "cost3_free")) and abs(r.k - want["k"]) < 1e-8


def test_sets_of_documents(spark, folder):
    docs = folder[1]
    held = lambda w, t: w in t
    longest = lambda a, p, b: max(n for n in range(len(a) - p + 1) if held(a[p : p + n], b))
    for r in (got := rows(spark, folder, "document_matches")):
        a, b = docs[r.base_id], docs[r.other_id]
        match = [longest(a, p, b) for p in range(len(a))]
        assert (r.total, r.longest, r.long_places) == (sum(match), max(match), sum(m >= 32 for m in match))
    assert {(r.base_id, r.other_id) for r in got} == {(i, j) for i in docs for j in (i + 1, i + 2) if j in docs and docs[i]}
    exclusive = {(r.text_id, r.len, r.first_pos) for r in rows(spark, folder, "document_exclusive_repeats")}
    assert exclusive == {(i, len(w), p[0]) for i, t in docs.items() for w, p in brute.supermaximal(t).items() if not any(held(w, docs.get(j, "")) for j in (i + 1, i + 2))}
    for r in rows(spark, folder, "document_pair_repeats"):
        both = brute.repeats(docs[r.text_id] + chr(1) + docs[r.text_id + 1])
        middle = len(docs[r.text_id])
        kinds = Counter("both" if p[0] < middle < p[-1] else "left" if p[0] < middle else "right" for p in both.values())
        assert (r.patterns, r.left, r.right, r.both) == (len(both), kinds["left"], kinds["right"], kinds["both"])
        assert r.longest == max((len(w) for w, p in both.items() if p[0] < middle < p[-1]), default=None)


def test_rectangles_and_factors(spark, folder):
    for r in rows(spark, folder, "document_rectangles"):
        t = folder[1][r.text_id]
        order = brute.suffix_order(t)
        heights = [brute.common(t[a:], t[b:]) for a, b in zip(order, order[1:])]
        assert r.area == max(min(heights[a:b]) * (b - a + 1) for a in range(len(heights)) for b in range(a + 1, len(heights) + 1))
    assert {r.text_id: r.value for r in rows(spark, folder, "document_lz_factors")} == {i: codecs.factors(t) for i, t in folder[1].items()}


def test_codes(spark, folder):
    docs = folder[1]
    assert {r.text_id: r.codes for r in rows(spark, folder, "mtf_codes")} == {i: bytes(brute.front(t.encode())).hex().upper() for i, t in docs.items()}
    for r in rows(spark, folder, "front_statistics"):
        codes = brute.front(brute.transform(docs[r.text_id]).encode())
        assert (r.n, r.zeros, r.falls, r.est_bytes) == (len(codes), codes.count(0), sum(bool(a) and not b for a, b in zip(codes, codes[1:])), brute.coded_bytes(codes))
    for r in rows(spark, folder, "lzw_code_counts"):
        codes = codecs.phrases(docs[r.text_id].encode())
        assert r.codes == len(codes) and codecs.from_phrases(codes) == docs[r.text_id].encode()


def test_run_statistics(spark, folder):
    items = {i: t for i, t in folder[2].items() if t}
    got = {r.text_id: r for r in rows(spark, folder, "run_statistics")}
    assert set(got) == set(items)
    for i, t in items.items():
        bwt = brute.transform(t)
        codes, r = brute.front(bwt.encode()), got[i]
        assert sorted(t[k:] + t[:k] for k in range(len(t)))[r.prim] == t
        assert (r.n, r.zero_mtf, r.nzz_est, r.mtf_entropy) == (len(codes), codes.count(0), sum(bool(a) and not b for a, b in zip(codes, codes[1:])), brute.coded_bytes(codes))
        found = brute.repeats(t)
        assert (r.mrs or 0, r.longest or 0) == (len(found), max(map(len, found), default=0)) and abs(r.kinv_lcp - brute.complexity(t)) < 1e-8
        phrases = codecs.phrases(bwt.encode())
        assert codecs.from_phrases(phrases) == bwt.encode() and r.lzw_codes == len(phrases)
        heap = sorted(Counter(phrases).values())
        bits = heap[0] if len(heap) == 1 else 0
        while len(heap) > 1:  # the two rarest become one; the weights of all that are made add up to the bits
            bits += heap[0] + heap[1]
            heap = sorted([*heap[2:], heap[0] + heap[1]])
        assert r.huf_len == -(-bits // 8)


def test_reads(spark, folder):
    docs = folder[1]
    table = spark.createDataFrame(list(docs.items()), "text_id long, body string")
    reads = {r.pattern_id: r.pattern for r in search.sampled_reads(table, 24, 2).collect()}
    got = {r.pattern_id: (r.occs, r.texts, r["class"]) for r in rows(spark, folder, "read_classes")}
    assert got.keys() == reads.keys() and len(reads) == 2 * sum(len(t) >= 24 for t in docs.values())
    for i, w in reads.items():
        per = [sum(t.startswith(w, p) for p in range(len(t))) for t in docs.values()]
        assert w in docs[int(i.split(":")[0])] and got[i] == (sum(per), sum(n > 0 for n in per), sum(sum(per) >= b for b in (1, 2, 10, 100)))


def sizes(text):
    codes = brute.front(brute.transform(text).encode())
    return {"coded": len(codes) - codes.count(0), "est_bytes": brute.coded_bytes(codes), "cost8": brute.code_cost(text, 8, True), "cost3": brute.code_cost(text, 3, True), "cost3_free": brute.code_cost(text, 3, False), "k": brute.complexity(text)}


def test_distances(spark, folder):
    items = {i: t for i, t in folder[2].items() if t}
    got = rows(spark, folder, "measure_distances")
    assert {(r.base_id, r.other_id) for r in got} == {(100, i) for i in items if i != 100} and len(got) > 5
    own = {i: sizes(t) for i, t in items.items()}
    for r in got:
        both = sizes(items[r.base_id] + chr(0xE000) + items[r.other_id])
        for m, v in both.items():
            a, b = own[r.base_id][m], own[r.other_id][m]
            assert abs(r[f"d_{m}"] - (v - min(a, b)) / max(a, b)) < 1e-8, m


def test_statistics(spark, folder):
    letters = "ACGTN" * 6
    got = {r.text_id: r for r in rows(spark, folder, "sequence_statistics")}
    for i, t in folder[2].items():
        dna = "".join(letters[ord(c) - 97] for c in t.lower() if "a" <= c <= "z")
        assert (i in got) == bool(dna)
        if not dna:
            continue
        runs = [x for x in dna.replace("A", " ").replace("C", " ").replace("G", " ").replace("T", " ").split()]
        short = dna
        for n in sorted({len(x) for x in runs if len(x) > 2}, reverse=True):
            short = short.replace("N" * n, "n" * (2 + len(f"{n - 2:b}")))
        short = short.upper()
        want = sizes(short)
        r = got[i]
        assert (r.long_source, r.cnt_A, r.cnt_C, r.cnt_G, r.cnt_T, r.cnt_N) == (len(dna), *(dna.count(c) for c in "ACGTN"))
        assert r.n_blocks == sum(len(x) >= 5 for x in runs) and r.long_input == len(short)
        assert (r.long_input - r.zero_mtf, r.mtf_entropy, r.lpat_size, r.lpat3_size, r.lpat3dl0_size) == tuple(want[m] for m in ("coded", "est_bytes", "cost8", "cost3", "cost3_free"))
        codes = codecs.phrases(brute.transform(short).encode())
        bits = sum(codecs.code_lengths(Counter(codes))[c] for c in codes)
        assert (r.lzw_codes, r.est_size) == (len(codes), brute.coded_bytes(codes)) and r.huf_len == -(-(bits + r.huf_tbl_bit) // 8) and r.long_output == r.huf_len + 8
        assert abs(r.kinv_lcp - want["k"]) < 1e-8


def test_rows_that_share_an_id_have_sizes_of_their_own(spark, tmp_path):
    spark.createDataFrame([(1, "acgt acgg acgt nnnnnn a"), (1, "tttttttt"), (2, "ggca")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.text_id, r.long_source) for r in QUERIES["document_sequence_statistics"](spark, str(tmp_path)).collect()) == [(1, 8), (1, 19), (2, 4)]
    assert sorted((r.text_id, r.n) for r in QUERIES["document_measures"](spark, str(tmp_path)).collect()) == [(1, 8), (1, 23), (2, 4)]
