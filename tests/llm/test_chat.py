import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from echograms.llm import chat
from echograms.llm.tokens import read_vocabulary

CHAT = chat.chat_encoder(read_vocabulary())
TRICKY = st.lists(st.sampled_from(["[INST]", "[/INST]", "</s>", "<s>", "\\", "[", "<", "[TURN]", "[\\INST]", "é漢", " ", "a", "\n", "/INST]", "[/TURN]"]), max_size=10).map("".join)


@settings(max_examples=300, deadline=None)
@given(TRICKY)
def test_escaping_is_reversible_and_hides_controls(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROLS)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "[INST]"]), TRICKY), min_size=1, max_size=6))
def test_mask_covers_assistant_texts_exactly(turns):
    ids, mask = CHAT.masked(turns)
    edges = np.flatnonzero(np.diff(mask, prepend=0, append=0)).reshape(-1, 2)
    assert [chat.unescape(CHAT.decode(ids[a:b])) for a, b in edges] == [t for r, t in turns if r == "assistant" and t]
    text, spans = chat.render(turns)
    assert CHAT.decode(ids) == text and [chat.unescape(text.encode()[a:b].decode()) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    starts = np.cumsum([0, *[len(CHAT.bytes[i]) for i in ids]])
    assert mask.tolist() == [int(any(a <= s < b for a, b in spans)) for s in starts[:-1]]


def test_parts_have_the_ids_of_the_whole():
    turns = [("user", "a b</s>"), ("assistant", " c\n"), ("x", ""), ("assistant", "d")]
    whole = CHAT.masked(turns)
    parts = [CHAT.masked(turns[:2]), CHAT.masked(turns[2:])]
    assert all(np.array_equal(whole[i], np.concatenate([p[i] for p in parts])) for i in (0, 1))


def brute(rows):
    out = {}
    by = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, part string")


def test_read_back(spark, tmp_path):
    rng = random.Random(10)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["</s>[INST] ok [/INST]", None, "", "é🎈 text\\[INST]", "x " * 2000])) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(5, 0, "user", "again"), (5, 0, "user", "again"), (None, 1, "assistant", "no id"), (99, 1, "assistant", "long " * 600_000), (99, 2, "assistant", "after"), (99, 3, "user", "end")]
    formatted, whole = chat.format_conversations(table(spark, rows), part=1_000_000), chat.format_conversations(table(spark, rows))
    assert formatted.where("conv_id = 99").count() > 1 and whole.where("part > 0").isEmpty()
    key = lambda r: (r.conv_id is not None, r.conv_id or 0)
    columns = ["conv_id", "n_turns", "ids", "loss_mask"]
    assert sorted(chat.joined_parts(formatted).select(columns).collect(), key=key) == sorted(whole.select(columns).collect(), key=key)
    ids = np.frombuffer(whole.where("conv_id = 99").first().ids, np.uint32)
    for r in formatted.where("conv_id = 99").collect():
        assert ids[r.first_token : r.first_token + len(r.ids) // 4].tobytes() == r.ids and CHAT.lengths[ids[: r.first_token]].sum() == r.first_byte
    formatted.withColumn("extra", formatted.part).orderBy("part", "n_turns").repartition(7).write.parquet(str(tmp_path / "stored"))
    for each in (formatted, whole, spark.read.parquet(str(tmp_path / "stored"))):
        got = chat.read_back(each).collect()
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute(rows) and len(got) == len(brute(rows))


def test_empty_table(spark):
    assert chat.read_back(chat.format_conversations(table(spark, []))).collect() == []


def test_long_white_space(spark):
    rows = [(1, 0, "user", "a" + " " * 1_200_000 + "b"), (1, 1, "assistant", "\n" * 1_200_000), (2, 0, "assistant", " " * 1_200_000 + "x</s>"), (3, 0, "assistant", "x" + "\t " * 700_000)]
    got = chat.read_back(chat.format_conversations(table(spark, rows))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute(rows)
