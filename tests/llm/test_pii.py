import hashlib
import re

from pyspark.sql import functions as F

from echograms.llm import pii
from tests.llm.helpers import documents, odd_rows

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
TEXTS = [
    "mail a.b+c@d-e.co.uk, x@y, a@b.com_x@y.z and é🎈 q@w.e.r", "ip 1.2.3.4.5.6.7.8 and 300.1.1.1 or 0255.000.1.01 host 1.2.3", "card 4111 1111 1111 1111 no 4111-1111-1111-1112 and 4111111111111111222", "call +49 (30) 1234-5678. +1 2 or +123456789012345678",
    "iban DE89 3704 0044 0532 0130 00 ok, DE89370400440532013001 no, bank GB82WEST12345698765432", "1" * 3000, "a." * 2000 + "@" + "b." * 2000 + "c", "漢字+1 555 555 5555漢字 99.99.99.99", "é a@b.cd 1.2.3.4 " * 900,
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    spans = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]():
                spans.append((m.start(), rank, m.end(), kind))
    return sorted(spans)


def test_spans_equal_brute_force(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, t) for i, (_, t) in enumerate(odd_rows())]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in pii.op9_personal_data(spark, str(tmp_path)).collect()}
    for i, t in rows:
        want = brute(t)
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), (i, got[i].spans, listed)
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(x[1] == k for x in want) for k in range(4)]
    second = TEXTS[4].index("GB82")
    assert got[4].spans == f"iban:5:32,iban:{second}:{second + 22}"


def test_context_raises_the_score_and_redaction_keeps_the_rest(spark):
    docs = documents(spark, [(1, "write to a@b.cd now"), (2, "zzz a@b.cd zzz"), (3, None)])
    found = pii.personal_data(docs)
    rows = {r.doc_id: r for r in found.withColumn("red", pii.redacted(found)).collect()}
    assert rows[1].spans[0].score > rows[2].spans[0].score and rows[1].red == "write to [email] now" and rows[3].red is None and rows[3].spans == []


def test_empty_table(spark):
    assert pii.personal_data(documents(spark, [])).collect() == []


def test_columns_named_like_internal_ones(spark):
    docs = documents(spark, [(1, "a@b.cd"), (None, None)]).withColumnsRenamed({"size": "t", "score": "m_email", "lang": "row", "source": "h_ip", "n_chars": "spans"})
    found = pii.personal_data(docs)
    assert sorted(found.columns) == sorted(docs.columns)
    got = {r.doc_id: r for r in found.collect()}
    assert (got[1].t, got[1].m_email, got[1].row, got[1].h_ip) == ("x", "y", "en", "s") and [x.kind for x in got[1].spans] == ["email"] and got[None].spans == []


def test_native_plan(spark):
    plan = pii.personal_data(documents(spark, [(1, "a")])).select(F.size("spans"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
