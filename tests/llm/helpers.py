"""Brute-force versions in plain Python."""

import random
import re

ASCII_LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string"


def lower(text):
    return (text or "").translate(ASCII_LOWER)


def shingles(text, k=5):
    w = WORDS.findall(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


def prose(rng, n, words="the of on red blue fish über été one two three four alpha beta gamma delta"):
    return " ".join(rng.choice(words.split()) for _ in range(n))


def documents(spark, rows):
    """rows of (doc_id, text[, lang, source]) with extra columns whose names clash with those that operators make."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), "x", "y") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows():
    """Nulls, empties, white space, ties, repeated rows and one long text."""
    rng = random.Random(3)
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One two"), (5, "One two"), (6, prose(rng, 40)), (7, "x" * 5000), (8, prose(rng, 3000)), (9, "ÀÉ ñ ß 漢字 🎈")]
