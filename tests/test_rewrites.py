import random
from itertools import product
from zlib import crc32

import pytest

from echograms.functions import rewrites


def shared(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def order_of(text):
    places = sorted(range(len(text)), key=lambda p: text[p:])
    return places, [shared(text[a:], text[b:]) for a, b in zip(places, places[1:], strict=False)]


def complexity(text):
    return (1 if text else 0) + sum(1 / (x + 1) for x in order_of(text)[1])


def right(text):
    places, lcp = order_of(text)
    repeat = lambda p: (lcp + [0])[places.index(p)]
    new, i = text, 0
    while i < len(text):
        a = repeat(i)
        if a == 0:
            i += 1
            continue
        copy, j = places[places.index(i) + 1], i + a
        if j >= len(text):
            break
        for step in range(max(0, (repeat(j) - a) // 2)):
            if max(i, copy) + a + step < len(text):
                new = new[: i + a + step] + new[copy + a + step] + new[i + a + step + 1 :]
        i = j
    return new


def left(text, score, kind, letter, claim, seed):
    places, lcp = order_of(text)
    k = next(k for k in range(99) if 4**k >= len(text))
    ranked = []
    for i, x in enumerate(lcp):
        height = sum(1 for r in range(len(places)) if all(y >= x for y in lcp[min(r, i) : max(r, i)]) and (r <= i or all(y >= x for y in lcp[i:r])))
        points = {"area": x * height, "length": x, "height": height}[score]
        if x > 0 and {"long": x >= k, "below": x == k - 1, "half": x == k // 2, "ten": x == 10}[kind]:
            ranked.append((-points, i))
    new, claimed = list(text), set()
    for _, i in sorted(ranked):
        if {places[i], places[i + 1]} & claimed:
            continue
        group = [i, i + 1]
        while group[0] > 0 and lcp[group[0] - 1] >= lcp[i] and places[group[0] - 1] not in claimed:
            group.insert(0, group[0] - 1)
        while group[-1] + 1 < len(places) and lcp[group[-1]] >= lcp[i] and places[group[-1] + 1] not in claimed:
            group.append(group[-1] + 1)
        starts = [places[r] for r in group]
        before = [p - 1 for p in starts if p > 0]
        seen = [new[p] for p in before]
        chosen = {"any": seen[0], "opposite": dict(zip("ACGT", "TGCA", strict=True)).get(new[starts[0]], seen[0]), "common": min(set(seen), key=lambda c: (-seen.count(c), c)), "random": "ACGT"[crc32(f"{seed}:{starts[0]}".encode()) % 4]}[letter]
        for p in before:
            new[p] = chosen
        claimed |= set(before) | {p + d for p in starts for d in range({"log": k, "repeat": lcp[i], "one": 1}[claim])}
    return "".join(new)


def settled(text, step, rounds):
    done = 0
    while rounds is None or done < rounds:
        new = step(text)
        if new == text or complexity(new) >= complexity(text) - 1e-12:
            break
        text, done = new, done + 1
    return text, done


def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 70))) for letters in ("ACGT", "AC", "ACGTN", "aé🎈") for _ in range(6)]
    unit = "ACGGT"
    return ["", "A", "AA", "AC", "A" * 40, unit * 9, unit * 4 + "T" + unit * 4 + "A" + unit * 3, "GATTACA" * 3 + "GATTAGA" * 3, *made]


def check(spark, got, step, rounds):
    bodies = texts()
    rows = {r.text_id: r for r in got.collect()}
    assert any(r.rounds and r.changed for r in rows.values())
    assert len(rows) == len(bodies) + 1 and rows[-1].body is None
    for i, body in enumerate(bodies):
        want, done = settled(body, step, rounds)
        r = rows[i]
        assert (r.body, r.rounds, r.changed) == (want, done, sum(a != b for a, b in zip(body, want, strict=True)))
        assert r.k_after <= r.k_before and abs(r.k_before - complexity(body)) < 1e-9 and abs(r.k_after - complexity(want)) < 1e-9


def table(spark):
    return spark.createDataFrame([(-1, None), *enumerate(texts())], "text_id long, body string")


@pytest.mark.parametrize("rounds", [1, None])
def test_right(spark, rounds):
    check(spark, rewrites.lowered_right(table(spark), rounds), right, rounds)


@pytest.mark.parametrize(("score", "kind"), list(product(rewrites.SCORES, ["long", "half"])))
def test_left_by_score(spark, score, kind):
    check(spark, rewrites.lowered_left(table(spark), score, kind), lambda t: left(t, score, kind, "any", "log", 0), 1)


@pytest.mark.parametrize(("letter", "claim"), [("any", "repeat"), ("opposite", "log"), ("common", "one"), ("random", "log"), ("common", "repeat")])
def test_left_until_nothing_changes(spark, letter, claim):
    check(spark, rewrites.lowered_left(table(spark), "area", "below", letter, claim, None, 7), lambda t: left(t, "area", "below", letter, claim, 7), None)


def test_long_periodic_texts_and_unknown_names(spark):
    bodies = [("ACGGT" * 20_000)[:60_000] + "T" + "ACGGT" * 8_000, "A" * 100_000]
    got = rewrites.lowered_left(spark.createDataFrame(list(enumerate(bodies)), "text_id long, body string"), claim="repeat").orderBy("text_id").collect()
    assert [len(r.body) for r in got] == [len(b) for b in bodies] and all(r.k_after <= r.k_before for r in got)
    assert [rewrites.least_power(n) for n in (0, 1, 2, 4, 5, 16, 17, 64, 65, 4**20, 4**20 + 1)] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 20, 21]
    with pytest.raises(ValueError, match="area, length, height"):
        rewrites.lowered_left(table(spark), "depth")


def test_rounds_that_need_not_lower_complexity(spark):
    got = rewrites.lowered_left(table(spark), letter="opposite", kind="half", rounds=2, falling=False)
    step = lambda t: left(t, "area", "half", "opposite", "log", 0)
    want = [step(step(t)) for t in texts()]
    assert [r.body for r in got.where("text_id >= 0").orderBy("text_id").collect()] == want and want != texts()
    assert [r.body for r in rewrites.lowered_right(table(spark), 1, False).where("text_id >= 0").orderBy("text_id").collect()] == [right(t) for t in texts()]
    with pytest.raises(ValueError, match="must have a number"):
        rewrites.lowered_right(table(spark), None, False)


def test_texts_of_a_run_are_sorted_together(monkeypatch):
    calls, kernel = [], rewrites.SuffixOrder
    monkeypatch.setattr(rewrites, "SuffixOrder", lambda texts: calls.append(len(texts)) or kernel(texts))
    bodies = ["".join("ACGT"[crc32(f"{i} {k % 17}".encode()) % 4] for k in range(60)) for i in range(30)] + [""]
    got = rewrites._rewritten(bodies, rewrites.extended_right, 1, False)
    assert [g[0] for g in got] == [right(t) for t in bodies] and calls[0] == 31 and len(calls) == 2
