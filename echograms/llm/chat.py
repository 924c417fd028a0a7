"""Chat formatting with offset-aligned loss masks.

A user turn is rendered as [INST]text[/INST], any other as [TURN]role[/TURN]text</s>. Roles and texts are escaped: where one holds a control string,
perhaps with backslashes after its first character, one more backslash goes there; unescaping takes one away. So control strings stand only where
the template puts them, and rendering can be read back. Control strings have ids of their own after the vocabulary's, so no token crosses a turn.

Turns are dealt by conversation and sorted; a task renders and encodes them in order. A conversation is one row up to `part` characters, a parameter; a longer
one leaves the task in several numbered rows of whole turns, so memory is bounded however long it is. As control strings always end a token, no
token crosses such a row: the rows' ids, one after the other, are those of the conversation encoded whole, first_token and first_byte tell where in it
each row begins, and joined_parts puts them together."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echograms.llm.tokens import VOCABULARY, encoder, read_vocabulary

#: The control strings, in the order of their ids after the vocabulary.
CONTROLS = ("[INST]", "[/INST]", "[TURN]", "[/TURN]", "</s>")
PART, HELD = 4_000_000, 4_000_000
FORMATTED = "conv_id long, part int, n_turns int, first_token long, first_byte long, ids binary, loss_mask binary"
_CONTROL = re.compile("(" + "|".join(map(re.escape, CONTROLS)) + ")")
_RAW = re.compile(r"([<\[])(\\*)(?=/?INST\]|/?TURN\]|/?s>)")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=/?INST\]|/?TURN\]|/?s>)")


def escape(text: str) -> str:
    return _RAW.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendered conversation, and the (start, end) byte spans of assistant texts in it."""
    pieces: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0
    for role, text in turns:
        head, tail = ("[INST]", "[/INST]") if role == "user" else (f"[TURN]{escape(role)}[/TURN]", "</s>")
        safe = escape(text)
        start = at + len(head.encode())
        end = start + len(safe.encode())
        if role == "assistant":
            spans.append((start, end))
        at = end + len(tail)
        pieces += (head, safe, tail)
    return "".join(pieces), spans


class Chat:
    """Encodes rendered conversations: the vocabulary's tokens, and the control strings as tokens of their own."""

    def __init__(self, vocabulary: bytes):
        self.plain = enc = encoder(vocabulary)
        self.bytes = enc.bytes + [c.encode() for c in CONTROLS]
        self.lengths = np.array([len(x) for x in self.bytes], dtype=np.int64)
        self.control = {c: np.array([enc.size + i], dtype=np.uint32) for i, c in enumerate(CONTROLS)}

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, byte offset of each token, and of the end): the tokens spell the text byte for byte, so their lengths add up to the offsets. What is between
        control strings is encoded as ordinary text."""
        lists = [self.control[x] if i % 2 else self.plain.ids(x) for i, x in enumerate(_CONTROL.split(text))]
        ids = np.concatenate(lists)
        return ids, np.concatenate([[0], np.cumsum(self.lengths[ids])])

    def masked(self, turns: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of a whole conversation, rendered and encoded once: 1 for each token that lies in an assistant's text. The tokens of each span are
        found by binary search of its ends among the token offsets."""
        text, spans = render(turns)
        ids, offsets = self.encode(text)
        bounds = np.array(spans, dtype=np.int64).reshape(-1, 2)
        edges = np.searchsorted(offsets, bounds)
        step = np.zeros(len(ids) + 1, dtype=np.int64)
        np.add.at(step, edges[:, 0], 1)
        np.add.at(step, edges[:, 1], -1)
        return ids, np.cumsum(step[:-1]).astype(np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode()


@lru_cache(maxsize=2)
def chat_encoder(vocabulary: bytes) -> Chat:
    """One for each worker process and vocabulary."""
    return Chat(vocabulary)


def _format(vocabulary, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chat = chat_encoder(vocabulary.value)
        now, part, size, turns, tokens, spelled = None, 0, 0, [], 0, 0
        out: list[tuple] = []

        def close(final: bool) -> None:
            nonlocal part, size, turns, tokens, spelled
            if turns:
                ids, mask = chat.masked(turns)
                out.append((now[0], part, len(turns), tokens, spelled, ids.tobytes(), mask.tobytes()))
                tokens, spelled = tokens + len(ids), spelled + int(chat.lengths[ids].sum())
            part, size, turns = part + 1, 0, []
            if final:
                part = tokens = spelled = 0

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            rows = [pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(rows, [x.split()[0] for x in FORMATTED.split(", ")])

        for batch in batches:
            held = 0
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if now != (conv,):
                    close(True)
                    now = (conv,)
                turns.append((role or "", text or ""))
                size += len(text or "") + 16
                held += len(text or "")
                if size >= most:
                    close(False)
                if held >= HELD and out:
                    held = 0
                    yield flush()
            if out:
                yield flush()
        close(True)
        if out:
            yield flush()

    return run


def format_conversations(conversations: DataFrame, vocabulary: str = VOCABULARY, part: int = PART) -> DataFrame:
    """(conv_id, part, n_turns, first_token, first_byte, ids, loss_mask): ids as little-endian 32-bit integers, loss_mask one byte for each id. Conversations of
    less than `part` characters (16 for each turn added) are one row; of longer ones each row begins at first_token and first_byte of the conversation.

    Turns are in order of turn, then role and text where turns tie. Null roles and texts count as empty; rows with a null conv_id are one conversation
    with that id. Repeated rows are turns of their own. An empty table gives an empty result. Other columns are ignored. A text of any length is kept
    whole."""
    ranks = conversations.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    rows = conversations.select(*[conversations[f"`{c}`"].alias(c) for c in ("conv_id", "role", "text", "turn")])
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(_format(ranks, part), FORMATTED)


def joined_parts(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, ids, loss_mask): conversations whole, one row each, whatever their length. A conversation must then fit into a row."""
    rows = F.sort_array(F.collect_list(F.struct("first_token", "n_turns", "ids", "loss_mask")))
    whole = lambda c: F.aggregate(f"r.{c}", F.lit(b""), lambda x, y: F.concat(x, y)).alias(c)
    return formatted.groupBy("conv_id").agg(rows.alias("r"), F.sum("n_turns").cast("int").alias("n_turns")).select("conv_id", "n_turns", whole("ids"), whole("loss_mask"))


_TURN = re.compile(r"\[INST\](.*?)\[/INST\]|\[TURN\](.*?)\[/TURN\](.*?)</s>", re.S)


def _digest(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chat = chat_encoder(vocabulary.value)
        state, rows = None, []

        def close() -> None:
            if state:
                rows.append((state["id"], state["n"], state["turns"].hexdigest(), state["loss"], state["loss_sha"].hexdigest(), state["all"]))

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            rows.clear()
            return out

        for batch in batches:
            for conv, part, ids, mask in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2), batch.column(3), strict=True):
                ids, mask = np.frombuffer(ids.as_buffer(), np.uint32), np.frombuffer(mask.as_buffer(), np.uint8)
                if part == 0:
                    close()
                    state = {"id": conv, "n": 0, "turns": hashlib.sha256(), "loss": 0, "loss_sha": hashlib.sha256(), "all": 0}
                text = chat.decode(ids)
                state["all"] += len(text)
                for m in _TURN.finditer(text):
                    role, said = ("user", m[1]) if m[2] is None else (unescape(m[2]), unescape(m[3]))
                    said = unescape(said) if m[2] is None else said
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{said}\n".encode())
                edges = np.flatnonzero(np.diff(mask, prepend=0, append=0))
                for a, b in edges.reshape(-1, 2):
                    said = unescape(chat.decode(ids[a:b]))
                    state["loss"] += len(said)
                    state["loss_sha"].update(said.encode())
            if rows:
                yield flush()
        close()
        if rows:
            yield flush()

    return run


def read_back(formatted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Digests of each conversation, from its ids and mask alone: turns parsed from the decoded text, and the text under the mask.

    The parts of a conversation are brought together and in order here, so formatted may come from a stored table, dealt in any way."""
    ranks = formatted.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    columns = [formatted[c] for c in ("conv_id", "part", "ids", "loss_mask")]
    ordered = formatted.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(_digest(ranks), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op8_chat(spark, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of the planted one, read back from their formatted form. Nulls, ties, repeated rows and empty tables: as in
    format_conversations; the planted conversation is there in any case."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    return read_back(format_conversations(rows.unionByName(planted)))
