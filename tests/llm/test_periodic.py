import hashlib
import random
import zlib

import numpy as np
import pytest
from tests.llm.helpers import WORDS, documents, odd_rows, prose

from echograms.llm.periodic import octaves, periodic_runs, planted_text, smallest_period, tile_fragments, word_ids, z_function


def runs_of(words):
    """By definition: every stretch with words q apart identical, as far as it goes, whose smallest period is q."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q):
                found.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute(doc, words):
    runs = sorted(runs_of(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc, len(words), len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def corpus():
    rng = random.Random(11)
    rows = odd_rows()
    for i in range(60):
        p = rng.choice((1, 2, 3, 5, 8, 13, 21, 34, 64))
        tail = prose(rng, p).split() * rng.randrange(2, 9)
        rows.append((100 + i, prose(rng, rng.randrange(50)) + " " + " ".join(tail[rng.randrange(p) :]) + " " + prose(rng, rng.randrange(50))))
    rows += [(200, "a " * 6), (201, "a " * 5), (202, "a " * 500), (203, "a b " * 4), (204, "a b " * 3 + "a"), (205, "a a a b " * 40), (206, ("a " * 8 + "b ") * 9)]
    word = ["a", "b"]
    while len(word[-1]) < 600:
        word.append(word[-1] + word[-2])
    rows += [(300, " ".join(word[-1])), (301, " ".join(bin(i).count("1") % 2 and "x" or "y" for i in range(700)))]
    rows += [(302, " ".join(rng.choice("ab") for _ in range(800))), (303, " ".join((["q"] * 7 + ["r"]) * 5 + ["s"] + ["t", "u"] * 60))]
    return rows + [(None, "z " * 9), (None, "z " * 9), (100, rows[20][1])]


def test_matches_brute_force(spark):
    rows = corpus()
    got = sorted([tuple(r) for r in periodic_runs(documents(spark, rows).repartition(3)).collect()], key=str)
    assert got == sorted([brute(r[0], WORDS.findall(r[1] or "")) for r in rows], key=str)
    assert sum(r[2] for r in got) > 60


def test_long_run_is_stitched_from_many_tiles(spark):
    rng = random.Random(1)
    phrase = [f"w{rng.randrange(10**6)}" for _ in range(37)]
    words = [*prose(rng, 101).split(), *(phrase * 400)[:14_003], "end"]
    row = periodic_runs(documents(spark, [(1, " ".join(words))]), with_text=True).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (1, 101, 14_003, 37, 1000 * 14_003 // 37)
    assert row.collapsed == " ".join(words[: 101 + 37] + ["end"])


def test_tiles_against_definition():
    rng = random.Random(4)
    for _ in range(60):
        words = [rng.choice("ab").encode() for _ in range(rng.randrange(200))] + [b"c", b"d", b"c"] * rng.randrange(12)
        ids = word_ids(words)
        seen = {}
        for size, c, q in octaves(ids, len(ids)):
            for period, start, end in tile_fragments(ids.tolist(), np.stack([c, q], axis=1), size):
                seen[start, end - start, period] = 1
        assert sorted(r for r in seen if r[1] >= max(6, 4 * r[2])) == runs_of(words)


def test_z_function_and_smallest_period():
    rng = random.Random(6)
    for _ in range(100):
        w = [rng.randrange(2) for _ in range(rng.randrange(1, 40))]
        z = z_function(w)
        for i in range(1, len(w)):
            k = 0
            while i + k < len(w) and w[k] == w[i + k]:
                k += 1
            assert z[i] == k
        assert smallest_period(w) == next(p for p in range(1, len(w) + 1) if all(w[i] == w[i + p] for i in range(len(w) - p)))


def test_planted_tail():
    words = [f"{i}".encode() for i in range(50)]
    for doc in range(300):
        h = zlib.crc32(str(doc).encode())
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        want = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)] if h % 10 == 0 else words
        assert planted_text(doc, words) == want


def test_bounds(spark):
    docs = documents(spark, [(1, "a")])
    for parameters in ({"exponent": 3}, {"least": 5}):
        with pytest.raises(ValueError):
            periodic_runs(docs, **parameters)
    assert periodic_runs(docs.limit(0)).collect() == []
