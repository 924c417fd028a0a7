import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echograms.functions import codecs, complexity as cx, sequences as sq, suffix_kernels
from echograms.operators import ranges, repeats, suffixes
from echograms.plans import catalog
from echograms.sources import texts as src
from tests import brute


def table(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "text_id long, body string")


RAW = st.lists(st.tuples(st.sampled_from(b"ab\x00\xff"), st.sampled_from([1, 2, 3, 4, 5, 258, 259, 260, 261, 600])), max_size=6).map(lambda x: b"".join(bytes([v]) * n for v, n in x))


@settings(max_examples=150, deadline=None)
@given(RAW)
def test_codecs_round_trip(raw):
    assert codecs.from_front(codecs.move_to_front(raw)) == raw
    assert codecs.from_run_lengths(codecs.run_lengths(raw)) == raw


@settings(max_examples=15, deadline=None)
@given(st.binary(max_size=3000) | RAW)
def test_phrases_round_trip(raw):
    assert codecs.from_phrases(codecs.phrases(raw)) == raw


def test_run_length_format(spark):
    assert codecs.run_lengths(b"X" * 280) == b"XXXX\xffX\x14" and codecs.run_lengths(b"aaab") == b"aaab" and codecs.run_lengths(b"aaaa") == b"aaaa\x00"
    values = ["X" * 280, "aaab", "", "a" * 259, "a" * 260 + "é" * 9, "ab" * 50]
    sizes = {r.text_id: r.bytes for r in codecs.run_length_size(table(spark, values)).collect()}
    assert sizes == {i: len(codecs.run_lengths(v.encode())) for i, v in enumerate(values)}


def test_prefix_codes(spark):
    for counts in ({0: 5, 1: 2, 2: 1, 3: 1}, {7: 3}, {}, {i: 2**i for i in range(12)}):
        bits = codecs.code_lengths(counts)
        codes = codecs.prefix_codes(bits)
        assert not any(a != b and y.startswith(x) for a, x in codes.items() for b, y in codes.items())
        if len(counts) > 1:
            assert sum(2.0 ** -b for b in bits.values()) == 1.0
    rows = {r.text_id: r.bits for r in codecs.huffman_bits(cx.symbol_frequency(table(spark, ["aaaaabbcd", "zzz"]))).collect()}
    assert rows == {0: 5 + 4 + 3 + 3, 1: 3}


def test_factors():
    """A factor is new where it ends: all strings that start earlier are kept in a set, and a factor grows until it is not among them."""
    rng = random.Random(24)
    for _ in range(300):
        s = "".join(rng.choice("ab") for _ in range(rng.randint(0, 25)))
        known, grown, count = set(), "", 0
        for start_of_next, letter in enumerate(s, 1):
            grown += letter
            start = start_of_next - len(grown)
            known |= {s[i:j] for i in range(start) for j in range(i + 1, len(s) + 1)}
            if grown not in known:
                count, grown = count + 1, ""
        assert codecs.factors(s) == count + bool(grown)


def test_size_of_the_code_description(spark):
    """Lengths 1, 2, 3, 3: 5 bits for the longest, 1 + 1 for how many codes have length 1 and 2, and lists of one symbol for these two, 4 bits each. One
    symbol of four: 3 + 1 bits, and a distance of two base-3 digits. No symbol: 1 bit."""
    rows = [(1, 0, 5), (1, 1, 2), (1, 2, 1), (1, 3, 1), (2, 2, 7)]
    got = codecs.huffman_table_bits(spark.createDataFrame(rows, "text_id long, sym int, n long"), 4).collect()
    assert {r.text_id: r.table_bits for r in got} == {1: 5 + 2 + 8, 2: 4 + 6}


def test_rectangles_of_common_prefixes(spark):
    rng = random.Random(27)
    values = ["", "x", "Mississippi", "a" * 9] + ["".join(rng.choice("ab") for _ in range(30)) for _ in range(6)]
    got = {(r.text_id, r.rank): (r.lcp, r.base) for r in cx.rectangles(table(spark, values)).collect()}
    want = {}
    for i, t in enumerate(values):
        order = brute.suffix_order(t)
        heights = [brute.common(t[a:], t[b:]) for a, b in zip(order, order[1:])]
        for k, h in enumerate(heights):
            spans = [(x, y) for x in range(k + 1) for y in range(k + 1, len(heights) + 1) if min(heights[x:y]) >= h]
            want[i, k] = (h, 1 + max(y - x for x, y in spans))
    assert got == want
    tests = spark.range(1).select(*[cx.in_lcp_class(F.lit(v), F.lit(n), kind).alias(f"{kind}{v}_{n}") for kind, v, n in (("long", 3, 64), ("long", 3, 65), ("below", 3, 65), ("half", 2, 65), ("ten", 10, 5))]).first()
    assert list(tests) == [True, False, True, True, True]


def test_complexity_of_a_word(spark):
    t = table(spark, ["Mississippi\u0000", "x"])
    counts = cx.lcp_counts(t)
    k = {r.text_id: r.k for r in cx.complexity(counts, t).collect()}
    assert abs(k[0] - 7.783333333333333) < 1e-12 and k[1] == 1.0
    array = [r.lcp for r in cx.lcp_array(counts).where("text_id = 0").orderBy("i").collect()]
    assert array == [0, 0, 0, 0, 1, 1, 1, 1, 2, 3, 4]
    six = cx.six_measures(cx.lcp_array(counts)).where("text_id = 0").first()
    low = [min(int(math.log(i + 1, 4) + 1e-9), v) for i, v in enumerate(array)]
    assert abs(six.k_offset - (1 + sum(1 / (v - m + 1) for v, m in zip(array, low)))) < 1e-9 and abs(six.k_inv - k[0]) < 1e-12


def test_entropy_and_zeros(spark):
    t = table(spark, ["aabb", "aaaa", "\u0000a"])
    e = {r.text_id: r for r in cx.entropy(cx.symbol_frequency(t)).collect()}
    assert (e[0].bits, e[0].est_bytes, e[1].bits) == (1.0, 1, 0.0)
    z = {r.text_id: r.zeros for r in cx.repeated_symbols(cx.symbols(t)).collect()}
    assert z == {i: sum(x == 0 for x in codecs.move_to_front(v.encode())) for i, v in enumerate(["aabb", "aaaa", "\u0000a"])}


def test_zeros_of_texts_make_no_row_for_each_character(spark, tmp_path):
    rng = random.Random(46)
    values = ["", None, "x", "aab\n\n\r\r\u2028\u2028", "\u0000\u0000a", "🎈🎈🎉🎉🎈", "é漢漢é", "e\u0301\u0301e", "$$\\\\1", "z" * 300_000, *["".join(rng.choice("ab🎈") for _ in range(200)) for _ in range(5)]]
    table(spark, values).select(F.col("text_id").alias("doc_id"), F.col("body").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES["repeated_symbols"](spark, str(tmp_path))
    assert {r.text_id: r.zeros for r in found.collect()} == {i: (v[0] == "\u0000") + sum(a == b for a, b in zip(v, v[1:])) for i, v in enumerate(values) if v}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan


def test_greedy_cost(spark):
    rng = random.Random(25)
    values = ["".join(rng.choice("ab") for _ in range(30)) for _ in range(5)]
    t = table(spark, values)
    previous = repeats.longest_previous(repeats.previous_runs(t))
    known = {(r.text_id, r.pos): (r.len, r.delta) for r in previous.collect()}

    def cost(i, at, covered, char, with_delta):
        """What the rest of a text costs, given the set of places that are coded."""
        if at == len(values[i]):
            return 0
        length, delta = known[i, at]
        fresh = frozenset(range(at, at + length)) - covered
        price = len(f"{length:b}") + (len(f"{delta:b}") if with_delta else 0)
        if len(fresh) * char > price:
            return price + cost(i, at + 1, covered | fresh, char, with_delta)
        return (0 if at in covered else char) + cost(i, at + 1, covered | {at}, char, with_delta)

    for char, with_delta in ((8, True), (3, True), (3, False)):
        got = {r.text_id: r.cost for r in codecs.greedy_cost(previous, char, with_delta).collect()}
        assert got == {i: cost(i, 0, frozenset(), char, with_delta) for i in range(len(values))}


def collapse(s):
    out, c = [], 0
    for x in s + "\n":
        if x == "N":
            c += 1
            continue
        out.append("N" * (c if c <= 2 else 2 + (c - 2).bit_length()) + x)
        c = 0
    return "".join(out)[:-1]


def test_gaps_and_positions(spark):
    values = ["ACGT", "NNNNNNNACNNGNNNNNNNNNNNNT", "N" * 40, "", "ANNNNNC" + "N" * 9 + "GNNN"]
    t = table(spark, values)
    got = {r.text_id: r.body for r in t.select("text_id", src.collapse_runs(F.col("body")).alias("body")).collect()}
    assert got == {i: collapse(v) for i, v in enumerate(values)}
    trace = src.gap_trace(src.n_runs(t), t)
    points = t.where("body <> ''").select("text_id", F.explode(F.sequence(F.lit(0).cast("long"), F.length("body") - F.lit(1).cast("long"))).alias("pos"))
    virtual = {(r.text_id, r.pos): r.virtual for r in src.to_virtual(points, trace).collect()}
    known = [(i, p, v) for (i, p), v in virtual.items() if v is not None]
    real = src.to_real(spark.createDataFrame([(i, v) for i, _, v in known], "text_id long, pos long"), trace)
    back = {(r.text_id, r.pos): r.real for r in real.collect()}
    assert all(back[i, v] == p for i, p, v in known)
    assert virtual[1, 0] == 0 and virtual[1, 3] is None and virtual[1, 7] == collapse(values[1]).index("A")


def test_points_in_the_trace_of_long_texts(spark):
    rng = random.Random(7)
    values = ["".join(rng.choice(["N" * rng.randrange(1, 40), "ACGT" * rng.randrange(30), "é"]) for _ in range(60)) for _ in range(6)] + ["NNNNNN", "A", ""]
    t = table(spark, values)
    assert {(r.text_id, r.start, r.len) for r in src.n_runs(t).collect()} == {(i, m.start(), len(m[0])) for i, v in enumerate(values) for m in re.finditer("N+", v)}
    trace = src.gap_trace(src.n_runs(t), t)
    points = spark.createDataFrame([(i, p) for i, v in enumerate(values) for p in [*range(len(v) + 300), 3, 3]] + [(99, 1)], "text_id long, pos long")
    events = sorted((r.text_id, r.virt_start, r.shift) for r in trace.collect())
    last = lambda i, p: max((e for e in events if e[0] == i and e[1] <= p), default=(i, 0, None))[2]
    real = Counter((r.text_id, r.pos, r.real) for r in src.to_real(points, trace).collect())
    assert real == Counter((i, p, None if last(i, p) is None else p + last(i, p)) for i, p in ((r.text_id, r.pos) for r in points.collect()))


def test_points_dealt_by_text_are_not_shuffled(spark):
    t = table(spark, ["ANNNNNC" + "N" * 9 + "GNNN"] * 3)
    found = src.to_virtual(catalog._positions(t), src.gap_trace(src.n_runs(t), t))
    lines = found._jdf.queryExecution().sparkPlan().toString().splitlines()  # before exchanges are added: the operators that the query asks for
    assert not any("Window" in x for x in lines[: next(i for i, x in enumerate(lines) if "Generate explode(sequence(0" in x)])


def test_sequences(spark):
    row = spark.createDataFrame([("ACCGTN",)], "s string").select(sq.reverse_complement(F.col("s")).alias("r"), sq.with_reverse_complement(F.col("s")).alias("w"), sq.four_letter_codes(F.col("s")).alias("c"), sq.from_four_letter_codes(sq.four_letter_codes(F.col("s"))).alias("b")).first()
    assert row.r == "NACGGT" and row.w == "ACCGTNNNACGGT" and row.b == "ACCGTN" and len(row.c) == 6
    fasta = ">one\nAC\nGT\n>two\nTT"
    t = table(spark, [fasta])
    assert [(r.offset, r.header) for r in sq.headers(t).collect()] == [(0, ">one"), (11, ">two")]
    masked = t.select(sq.masked_headers(F.col("body")).alias("m")).first().m
    assert masked == "NNNN\nAC\nGT\nNNNN\nTT" and len(masked) == len(fasta)
    spans = spark.createDataFrame([(0, 1, 2), (0, 2, 4), (0, 8, 9)], "text_id long, start long, end long")
    assert sq.kept_intervals(table(spark, ["0123456789"]), spans).first().body == "1234N89"
    changes = {r.letter: (r.total, r.lost, r.gained) for r in sq.letter_changes(spark.createDataFrame([(0, "AACG", "ATCC")], "text_id long, body string, other string")).collect()}
    assert changes == {"A": (2, 1, 0), "C": (1, 0, 1), "G": (1, 1, 0), "T": (0, 0, 1)}
    pieces = sq.joined(table(spark, ["a", "", "b"]).repartition(3), parts=2).orderBy("part", "text_id").collect()
    assert "".join(r.piece for r in pieces) == "a~~b" and sq.joined(table(spark, [])).collect() == []
    assert spark.range(1).select(sq.piece_at(F.lit(">h\nab c\nd"), 1, 2).alias("p")).first().p == "bc"


def test_sources(spark, tmp_path):
    assert src.parse_slice("a.fa[10K:2M]") == ("a.fa", 10_000, 2_000_000) and src.parse_slice("a.fa") == ("a.fa", None, None) and src.parse_slice("a.fa[:5]") == ("a.fa", None, 5)
    t = table(spark, ["a;b;c", "x;", ""])
    assert [(r.text_id, r.record, r.body) for r in src.records(t, ";").orderBy("text_id", "record").collect()] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "x")]
    reads = src.fastq_records(table(spark, ["@1\nACGT\n+\n!!!!\n@2\nAC\n+\n!!\n"]))
    assert [(r["read"], r.body) for r in reads.orderBy("read").collect()] == [(0, "ACGT"), (1, "AC")] and src.fastq_summary(reads).first().avg_len == 3.0
    import gzip

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("plain é")
    (tmp_path / "in" / "b.txt.gz").write_bytes(gzip.compress("packed".encode()))
    assert sorted(r.body for r in src.whole_files(spark, str(tmp_path / "in")).collect()) == ["packed", "plain é"]
    import bz2

    (tmp_path / "in" / "c.txt.bz2").write_bytes(bz2.compress("harder".encode()))
    assert src.whole_files(spark, str(tmp_path / "in" / "c.txt.bz2")).first().body == "harder"
    assert src.whole_files(spark, str(tmp_path / "in" / "b.txt")).first().body == "packed"  # from b.txt.gz
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        src.whole_files(spark, str(tmp_path / "in" / "none.txt")).collect()
    src.write_section(t, str(tmp_path / "store"), "texts")
    assert src.read_section(spark, str(tmp_path / "store"), "texts").count() == 3
    src.write_fasta(table(spark, ["A" * 100]), str(tmp_path / "fa"))
    assert sorted(len(r.value) for r in src.lines(spark, str(tmp_path / "fa")).collect()) == [2, 20, 80]
    body = spark.createDataFrame([(">h\nACGTx\nNN-",), ("AC",)], "b string").select(src.fasta_body(F.col("b")).alias("s")).collect()
    assert [r.s for r in body] == ["ACGTNN", "AC"]


def test_ranges(spark):
    rng = random.Random(26)
    arrays = {a: [rng.randint(0, 9) for _ in range(n)] for a, n in ((0, 5), (1, 700), (2, 1))}
    rows = spark.createDataFrame([(a, i, v) for a, x in arrays.items() for i, v in enumerate(x)], "array_id long, pos long, value long")
    asked = [(a, q, s, s + rng.choice([0, 1, 3, 300, 600])) for q, (a, s) in enumerate((a, rng.randrange(len(x))) for a, x in arrays.items() for _ in range(30))]
    got = {r.query_id: (r.low, r.high) for r in ranges.range_extremes(rows, spark.createDataFrame(asked, "array_id long, query_id long, start long, end long")).collect()}
    for a, q, s, e in asked:
        part = arrays[a][s:e]
        assert got[q] == ((min(part), max(part)) if part else (None, None))
    bound = [(a, q, p, rng.randint(-1, 9)) for q, (a, p) in enumerate((a, rng.randrange(len(x))) for a, x in arrays.items() for _ in range(30))]
    near = {r.query_id: (r.next, r.previous) for r in ranges.next_at_most(rows, spark.createDataFrame(bound, "array_id long, query_id long, pos long, bound long")).collect()}
    for a, q, p, b in bound:
        x = arrays[a]
        assert near[q] == (next((i for i in range(p, len(x)) if x[i] <= b), None), next((i for i in range(p, -1, -1) if x[i] <= b), None))
    bits = rows.select("array_id", "pos", (F.col("value") % 2).alias("bit"))
    for r in ranges.bit_ranks(bits).collect():
        assert r.rank1 == sum(v % 2 for v in arrays[r.array_id][: r.pos]) and r.rank0 == r.pos - r.rank1
    assert {(r.array_id, r.i): r.pos for r in ranges.bit_select(bits).collect()} == {(a, k + 1): p for a, x in arrays.items() for k, p in enumerate([i for i, v in enumerate(x) if v % 2])}
    overlay = ranges.updated(rows, spark.createDataFrame([(0, 2, 99)], "array_id long, pos long, value long")).where("array_id = 0").orderBy("pos").collect()
    assert [r.value for r in overlay] == arrays[0][:2] + [99] + arrays[0][3:]
    hits = ranges.overlapping(rows.select("array_id", "pos"), spark.createDataFrame([(1, 250, 260, 7)], "array_id long, start long, end long, interval_id long"))
    assert sorted(r.pos for r in hits.collect()) == list(range(250, 260))
    assert brute.common("ab", "ac") == 1


def test_ranges_of_long_and_gappy_arrays(spark, monkeypatch):
    """Three levels of chunks, places and values that are missing, questions beyond both ends, and a bound that is null."""
    monkeypatch.setattr(ranges, "CHUNK", 4)
    rng = random.Random(27)
    arrays = {a: {i: rng.choice([None, *range(9)]) for i in range(n) if a != 2 or rng.random() < 0.2} for a, n in ((0, 90), (1, 3), (2, 150), (3, 8))}
    rows = spark.createDataFrame([(a, i, v) for a, x in arrays.items() for i, v in x.items()], "array_id long, pos long, value long")
    known = {a: {i: v for i, v in x.items() if v is not None} for a, x in arrays.items()}
    asked = [(a, q, s, s + rng.choice([-1, 0, 1, 5, 17, 70, 400])) for q, (a, s) in enumerate((rng.choice([0, 1, 2, 3, 7]), rng.randrange(0, 160)) for _ in range(200))]
    got = {r.query_id: (r.low, r.high) for r in ranges.range_extremes(rows, spark.createDataFrame(asked, "array_id long, query_id long, start long, end long")).collect()}
    for a, q, s, e in asked:
        part = [v for i, v in known.get(a, {}).items() if s <= i < e]
        assert got[q] == ((min(part), max(part)) if part else (None, None)), (a, q, s, e)
    assert len(got) == len(asked)
    bounds = [(a, q, rng.randrange(0, 160), rng.choice([None, -1, 0, 1, 7, 8, 9])) for q, a in enumerate(rng.choice([0, 1, 2, 3, 7]) for _ in range(200))]
    table = spark.createDataFrame(bounds, "array_id long, query_id long, pos long, bound long")
    for of, passes in ((ranges.next_at_most, lambda v, b: v <= b), (ranges.next_at_least, lambda v, b: v >= b)):
        near = {r.query_id: (r.next, r.previous) for r in of(rows, table).collect()}
        assert len(near) == len(bounds)
        for a, q, p, b in bounds:
            fit = [i for i, v in known.get(a, {}).items() if b is not None and passes(v, b)]
            assert near[q] == (min((i for i in fit if i >= p), default=None), max((i for i in fit if i <= p), default=None)), (of, a, q, p, b)


def test_phrases_give_up_the_least_recently_used_and_start_afresh(monkeypatch):
    """Against the plain rule, with texts that use up all codes, and after other texts in the same process; a table is not seeded for each text."""
    seeds = codecs._Phrases().seeds

    def plain(raw):
        text, out, at, last = dict(enumerate(seeds)), [], 0, b""
        code, used = {v: k for k, v in text.items()}, list(range(256, len(seeds)))
        while at < len(raw):
            n = next(n for n in range(min(40, len(raw) - at), 0, -1) if raw[at : at + n] in code)
            phrase = raw[at : at + n]
            out.append(code[phrase])
            if out[-1] in used:
                used.remove(out[-1])
                used.append(out[-1])
            if last and last + phrase not in code and len(last + phrase) <= 40:
                old = used.pop(0)
                del code[text[old]]
                text[old], code[last + phrase] = last + phrase, old
                used.append(old)
            last, at = phrase, at + n
        return out

    rng = random.Random(31)
    texts = [bytes(rng.choices(range(256), k=20_000)), b"abcabcabcabc" * 2, b"", bytes(rng.choices(range(40, 60), k=900)), bytes(rng.choices(range(7), k=3000)), b"\0\0"]
    made, seeded = [], codecs._Phrases.__init__
    monkeypatch.setattr(codecs, "_book", None)
    monkeypatch.setattr(codecs._Phrases, "__init__", lambda self: made.append(self) or seeded(self))
    for raw in texts + texts[::-1]:
        codes = codecs.phrases(raw)
        assert codes == plain(raw) and codecs.from_phrases(codes) == raw
    assert len(made) == 1


def test_sinks(spark, tmp_path):
    from echograms.sources import sinks

    t = table(spark, ["abcabxab", "NNNNNNNNACGTACGT"])
    found, order = repeats.maximal_repeats(t), suffixes.suffix_array(t)
    places = {(r.text_id, r.pattern): r.places for r in sinks.readable(found, order).collect()}
    assert places[0, "ab"] == sorted([0, 3, 6], key=lambda i: "abcabxab"[i:])
    sinks.write_triples(found, str(tmp_path / "t"), as_text=True)
    assert all(len(r.value.split()) == 3 for r in spark.read.text(str(tmp_path / "t")).collect())
    sinks.write_readable(found, order, str(tmp_path / "r"))
    assert any(r.value.startswith("ab (2) #") for r in spark.read.text(str(tmp_path / "r")).collect())
    collapsed = t.select("text_id", src.collapse_runs(F.col("body")).alias("body"))
    rows = sinks.tracked(repeats.maximal_repeats(collapsed, 4), suffixes.suffix_array(collapsed), src.gap_trace(src.n_runs(t), t)).where("text_id = 1").collect()
    assert sorted(r.real for r in rows) == [0, 1, 8, 12]  # NNNN at 0 and 1, ACGT at 8 and 12
    wide = sinks.matrix(spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.25), (2, 3, 0.75)], "base_id long, other_id long, x double"), "x", [1, 2, 3]).orderBy("base_id").collect()
    with pytest.raises(ValueError):
        sinks.matrix(found, "len", list(range(sinks.COLUMNS + 1)))
    pairs = repeats.pair_repeats(spark.createDataFrame([(1, "abcabx", "zzabcq")], "text_id long, body string, other string"))
    sinks.write_sides(pairs, str(tmp_path / "s"), "both", 3)
    assert [r.value for r in spark.read.text(str(tmp_path / "s")).collect()] == ["3\t1\t1\tabc"]
    assert wide[0]["2"] == 0.5 and wide[2]["1"] == 0.25
    sinks.nothing(found)
    assert sinks.patterns_only(found).columns == ["value"]


def test_headers_come_back(spark):
    t = table(spark, [">one\nAC\n>two\nTT", "no header"])
    masked = t.select("text_id", sq.masked_headers(F.col("body")).alias("body"))
    assert {r.text_id: r.body for r in sq.with_headers(masked, sq.headers(t)).collect()} == {0: ">one\nAC\n>two\nTT", 1: "no header"}


def test_front_statistics(spark):
    values = ["aabb\u0000b", "", "zzzz"]
    for r in codecs.front_statistics(table(spark, values)).collect():
        c = codecs.move_to_front(values[r.text_id].encode())
        assert (r.n, r.zeros, r.falls) == (len(c), c.count(0), sum(bool(a) and not b for a, b in zip(c, c[1:])))


def test_codecs_answer_before_a_batch_is_through(monkeypatch):
    monkeypatch.setattr(codecs, "RUN_BYTES", 10)
    seen = []
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["abcd", "", None, "é" * 30, "efgh", "ij"])], ["text_id", "body"]).slice(1)
    out = list(codecs._map(lambda x: seen.append(x) or len((x or "").encode()), pa.int64())([batch]))
    assert len(out) > 1 and [v for b in out for v in b.column(1).to_pylist()] == [0, 0, 60, 4, 2] and [v for b in out for v in b.column(0).to_pylist()] == [1, 2, 3, 4, 5]


def test_intervals_of_many_groups_at_once(monkeypatch):
    rng = random.Random(3)
    for jumps in (64, 1):  # a slow end one by one gives the same
        monkeypatch.setattr(suffix_kernels, "JUMPS", jumps)
        for _ in range(60):
            texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(25))) for _ in range(4)] + ["a" * 20]
            order = suffix_kernels.SuffixOrder(texts)
            length, first, occs = suffix_kernels.repeat_intervals(order.common_prefixes(), order.lefts(), 1)
            found = Counter(zip(order.text[order.order[first]].tolist(), length.tolist(), occs.tolist()))
            assert found == Counter((i, len(w), len(p)) for i, t in enumerate(texts) for w, p in brute.repeats(t).items())


def test_move_to_front_codes_of_many_texts_at_once():
    rng = random.Random(51)
    raws = [bytes(rng.choice((0, 1, 5, 97, 98, 255)[: rng.randrange(1, 7)]) for _ in range(rng.randrange(40))) for _ in range(60)] + [rng.randbytes(700)]
    codes, offsets = codecs.front_codes(raws)
    assert [codes[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [brute.front(r) for r in raws]


def test_greedy_costs_of_many_texts_at_once():
    rng = random.Random(52)
    values = ["".join(rng.choice("abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(40))) for _ in range(60)]
    order = suffix_kernels.SuffixOrder(values)
    found = suffix_kernels.RepeatTree(order).previous()
    for char, far in ((8, True), (3, True), (3, False)):
        assert suffix_kernels.greedy_costs(*found, order.offsets, char, far) == [brute.code_cost(t, char, far) for t in values]
