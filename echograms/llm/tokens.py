"""Byte-level BPE. The vocabulary file is read on the driver and sent to the tasks; its path is a parameter."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from pathlib import Path

import numpy as np
import tiktoken

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern that this vocabulary was made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: the characters that \s means in that pattern.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pattern engine keeps a stack entry for each character of a run of white space, and a run of a million overflows it; longer runs than this are cut out.
LONG_RUN = 50_000
_LONG = re.compile(f"[{SPACES}]{{{LONG_RUN},}}")


def pieces(text: str) -> Iterator[tuple[bool, str]]:
    """The text in parts (is a run, part) that the pattern never crosses. A long run of white space is one piece, but for its last character where something
    follows: that belongs to what follows, as the pattern says."""
    at = 0
    for m in _LONG.finditer(text) if len(text) >= LONG_RUN else ():
        stop = m.end() - (m.end() < len(text))
        if m.start() > at:
            yield False, text[at : m.start()]
        yield True, text[m.start() : stop]
        at = stop
    if at < len(text):
        yield False, text[at:]


class Encoder:
    """Texts to ids and back. Every text is ordinary text: no string in it becomes a special token."""

    def __init__(self, vocabulary: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        self.plain = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * self.size
        for token, i in ranks.items():
            self.bytes[i] = token
        self.lengths = np.array([len(x) for x in self.bytes], dtype=np.int64)

    @cached_property
    def runs(self) -> tiktoken.Encoding:
        """Takes a run of white space as one piece; made only where a long run is met."""
        return tiktoken.Encoding("runs", pat_str=r"\s+", mergeable_ranks=self.ranks, special_tokens={})

    def _lists(self, text: str) -> Iterator[list[int]]:
        for is_run, part in pieces(text):
            yield (self.runs if is_run else self.plain).encode_ordinary(part)

    def ids(self, text: str) -> np.ndarray:
        lists = [np.array(x, dtype=np.uint32) for x in self._lists(text)]
        return np.concatenate(lists) if lists else np.zeros(0, np.uint32)

    def count(self, text: str) -> int:
        return sum(map(len, self._lists(text)))

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes[i] for i in ids])


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    return Path(path).read_bytes()


@lru_cache(maxsize=2)
def encoder(vocabulary: bytes) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(vocabulary)
