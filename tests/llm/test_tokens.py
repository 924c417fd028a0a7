import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from echograms.llm import packing, token_lengths
from echograms.llm.tokens import encoder, read_vocabulary
from tests.llm.helpers import documents, odd_rows, prose

ENC = encoder(read_vocabulary())


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab' .\n\t\r1é漢  x")), max_size=30))
def test_ids_spell_the_text(text):
    assert ENC.count(text) == len(ENC.ids(text)) == len(ENC.lengths[ENC.ids(text)]) and ENC.lengths[ENC.ids(text)].sum() == len(text.encode())
    assert ENC.decode(ENC.ids(text)) == text.encode()


@pytest.mark.parametrize("run", [" " * 400_000, "\n" * 400_000, "\t \u2003" * 60_000, " " * 50_000, " " * 49_999, "\r\n" * 25_000 + "\xa0"])
def test_long_white_space_has_the_ids_of_the_plain_encoder(run):
    for text in (run, "a" + run, run + "b", "a" + run + "b", run + "'s" + run + "!", "x " + run + "\x1cy" + run, "a" + run + "b" + run[:60_000] + "c"):
        assert ENC.ids(text).tolist() == ENC.plain.encode_ordinary(text) and ENC.count(text) == len(ENC.ids(text))


@pytest.mark.parametrize("run", [" ", "\n"])
@pytest.mark.parametrize("size", [1_000_000, 5_000_000])
def test_very_long_white_space(run, size):
    short = 1000
    for text in ("{}", "{}b", "a{}", "a{} b"):
        ids, few = ENC.ids(text.format(run * size)), ENC.plain.encode_ordinary(text.format(run * short))
        assert ENC.decode(ids) == text.format(run * size).encode()
        assert ids[-1] == few[-1] and ids[0] == few[0]


def test_operators_take_very_long_white_space(spark):
    docs = documents(spark, [(1, "a" + " " * 1_000_000 + "b"), (2, "\n" * 1_500_000), (3, "plain")])
    want = {i: ENC.count(t) for i, t in ((1, "a" + " " * 1_000_000 + "b"), (2, "\n" * 1_500_000), (3, "plain"))}
    assert {r.n_tokens: r.n_docs for r in token_lengths.length_histogram(docs).collect()} == dict(Counter(want.values()))
    got = Counter()
    for doc, _, ids in unpack(packing.packed_ids(docs).collect()):
        got[doc] += len(ids)
    assert got == {i: n + 1 for i, n in want.items()}


def unpack(rows):
    """Segments of every packed row: (doc, start, ids)."""
    out = []
    for r in rows:
        ids, positions = np.frombuffer(r.ids, np.uint16), np.frombuffer(r.positions, np.uint16)
        assert len(ids) == len(positions) == packing.CONTEXT and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for doc, start, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
            out.append((doc, start, ids[a:b].tolist()))
    return out


def test_packing_round_trip(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.choice([1, 50, 500, 4000]))) for i in range(80)] + [(100 + i, t) for i, (_, t) in enumerate(odd_rows())]
    packed = packing.packed_ids(documents(spark, rows)).collect()
    parts = Counter()
    whole = {}
    for doc, start, ids in sorted(unpack(packed), key=lambda x: (x[0], x[1])):
        parts[doc, start] += 1
        whole.setdefault(doc, []).extend(ids)
    want = {}
    for i, t in rows:
        if t:
            want.setdefault(i, []).extend([*ENC.plain.encode_ordinary(t), ENC.size])
    assert {k: sorted(v) for k, v in whole.items()} == {k: sorted(v) for k, v in want.items()}
    assert all(whole[i] == want[i] for i in want if i != 105 and i != 104)
    assert len({r.pack_id for r in packed}) == len(packed)


def test_best_fit_decreasing():
    rng = random.Random(8)
    for _ in range(200):
        c = rng.randint(1, 40)
        sizes = [rng.randint(1, c) for _ in range(rng.randint(0, 60))]
        rows, free, want = packing.best_fit(sizes, c), [], []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            fits = [k for k in range(len(free)) if free[k] >= sizes[i]]
            if not fits:
                free.append(c)
                want.append([])
                fits = [len(free) - 1]
            least = min(free[k] for k in fits)
            k = next(k for k in fits if free[k] == least)
            free[k] -= sizes[i]
            want[k].append(i)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
        assert sorted(sum(sizes[i] for i in r) for r in rows) == sorted(c - f for f in free)


def test_length_report(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.choice([1, 2, 50, 700]))) for i in range(60)] + odd_rows()
    lengths = [len(ENC.plain.encode_ordinary(t or "")) for _, t in rows]
    got = token_lengths.context_report(token_lengths.length_histogram(documents(spark, rows))).collect()
    assert Counter(lengths) == {r.n_tokens: r.n_docs for r in got}
    for r in got:
        assert r.docs_longer == sum(n > r.n_tokens for n in lengths) and r.tokens_longer == sum(n for n in lengths if n > r.n_tokens)
        assert r.truncated_total == sum(min(n, r.n_tokens) for n in lengths)
        assert r.share_within == pytest.approx(sum(n <= r.n_tokens for n in lengths) / len(lengths))


def test_empty_tables(spark):
    assert packing.packed_ids(documents(spark, [])).collect() == []
    assert token_lengths.context_report(token_lengths.length_histogram(documents(spark, []))).collect() == []
    assert packing.packed_ids(documents(spark, [(1, None), (2, "")])).collect() == []


def test_limits_and_quantiles(spark):
    rng = random.Random(9)
    lengths = [rng.choice([0, 3, 5, 8, 300, 700]) for _ in range(60)]
    counts = Counter(lengths)
    report = token_lengths.context_report(spark.createDataFrame(list(counts.items()), "n_tokens long, n_docs long"))
    limits = [0, 1, 3, 4, 299, 300, 5000]
    for r in token_lengths.context_limits(report, limits).collect():
        at = r.context_limit
        assert (r.docs_longer, r.tokens_longer, r.truncated_total) == (sum(n > at for n in lengths), sum(n for n in lengths if n > at), sum(min(n, at) for n in lengths))
    bigger = token_lengths.context_report(spark.createDataFrame([(4, 2), (9, 1)], "n_tokens long, n_docs long"))
    assert [tuple(r) for r in token_lengths.context_limits(bigger, [2]).collect()] == [(2, 3, 17, 6)]
    for r in token_lengths.length_quantiles(report, [0.0, 0.25, 0.5, 1.0]).collect():
        assert r.n_tokens == min(n for n in lengths if sum(x <= n for x in lengths) >= r.share * len(lengths))
    none = token_lengths.context_report(spark.createDataFrame([], "n_tokens long, n_docs long"))
    assert token_lengths.context_limits(none, [1]).collect() == [] and token_lengths.length_quantiles(none, [0.5]).first().n_tokens is None
