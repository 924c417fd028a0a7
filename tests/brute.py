"""Plain definitions on short strings."""

import math
from collections import Counter, defaultdict


def repeats(text):
    """{string: positions} of all maximal repeats."""
    seen = defaultdict(list)
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            seen[text[i:j]].append(i)
    out = {}
    for w, places in seen.items():
        left = [text[p - 1] if p else ("start", p) for p in places]
        right = [text[p + len(w)] if p + len(w) < len(text) else ("end", p) for p in places]
        if len(places) > 1 and len(set(left)) > 1 and len(set(right)) > 1:
            out[w] = places
    return out


def supermaximal(text):
    found = repeats(text)
    return {w: p for w, p in found.items() if not any(w != o and w in o for o in found)}


def suffix_order(text):
    return sorted(range(len(text)), key=lambda i: text[i:])


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def substrings(text):
    return {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}


def transform(text):
    """Last letters of the sorted rotations."""
    turns = sorted((text[i:] + text[:i], i) for i in range(len(text)))
    return "".join(t[-1] for t, _ in turns)


def front(raw):
    """Each byte as the number of different bytes since it was last seen; before that, as if all bytes had been seen from the last to the first."""
    seen, out = bytes(range(255, -1, -1)), []
    for b in raw:
        out.append(len(set(seen[seen.rfind(b) + 1 :])))
        seen += bytes([b])
    return out


def coded_bytes(values):
    """Bytes that an arithmetic coder of these values comes near."""
    if not values:
        return 0
    counts = Counter(values)
    bits = -sum(n * math.log2(n / len(values)) for n in counts.values())
    return (math.ceil(round(bits, 6)) + 7) // 8


def previous(text):
    """For each place the longest maximal repeat there that has an earlier occurrence, with the distance to the nearest."""
    best = [(0, 0)] * len(text)
    for w, places in repeats(text).items():
        for before, p in zip(places, places[1:]):
            if len(w) > best[p][0]:
                best[p] = (len(w), p - before)
    return best


def code_cost(text, char, with_delta):
    known, covered, total = previous(text), set(), 0
    for at, (length, delta) in enumerate(known):
        fresh = set(range(at, at + length)) - covered
        price = len(f"{length:b}") + (len(f"{delta:b}") if with_delta else 0)
        if len(fresh) * char > price:
            total, covered = total + price, covered | fresh
        elif at not in covered:
            total, covered = total + char, covered | {at}
    return total


def complexity(text):
    order = suffix_order(text)
    return 1 + sum(1 / (common(text[a:], text[b:]) + 1) for a, b in zip(order, order[1:]))
