"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score. DataFrame functions only, one map pass.

Offsets count code points, ends are exclusive. A match's place comes from the pieces between matches: regexp_extract_all gives the matches of a
text in order, split gives the pieces around the same matches, and running sums of both lengths give the starts. Possessive quantifiers keep
every pattern linear where greedy and possessive mean the same; a look-behind or \\G starts a match only where one could start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds in the order that breaks ties of start, with pattern, cheap test, context words, and score without and with context.
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]", r"(?i)mail|contact|write|kontakt|correo|courriel", 0.9),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?i)\bip\b|host|server|address|adresse|direcci", 0.7),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){13}", r"(?i)card|visa|credit|karte|carte|tarjeta", 0.8),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", r"(?i)phone|call|tel|fax|mobil|llam|appel", 0.7),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]{8}", r"(?i)iban|bank|konto|compte|cuenta", 0.8),
}
BASE = ("email", "ip", "card", "phone")
BEFORE, AFTER, BONUS, BLOCK = 40, 20, 0.15, 256
SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,score:double>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    back = F.reverse(digits)
    digit = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether a code of capitals and digits passes the mod-97 test: first four characters last, A = 10 ... Z = 35, remainder 1."""
    moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, F.lit(1), F.lit(4)))
    point = lambda i: F.ascii(F.substring(moved, i, F.lit(1)))
    step = lambda acc, i: F.when(point(i) >= 65, (acc * 100 + point(i) - 55) % 97).otherwise((acc * 10 + point(i) - 48) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _confirmed(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        bare = lambda part: F.ltrim(part, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda part: (F.length(bare(part)) <= 3) & (F.right(F.concat(F.lit("000"), bare(part)), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34) & mod97(F.replace(value, F.lit(" "), F.lit("")))
    return F.lit(True)


def _places(kind: str) -> Column:
    """Start of each match: running sums over blocks of BLOCK matches, then inside each block, so that long lists of matches take no quadratic time."""
    m, p = F.col(f"m_{kind}"), F.col(f"p_{kind}")
    none = F.array().cast("array<bigint>")
    sizes = F.transform(m, lambda x, i: F.struct(F.length(F.get(p, i)).cast("bigint").alias("gap"), F.length(x).cast("bigint").alias("size")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / BLOCK).cast("int")), lambda k: F.slice(sizes, k * BLOCK + 1, F.lit(BLOCK)))
    start = lambda at: F.struct(at.alias("at"), none.alias("out"))
    zero = F.lit(0).cast("bigint")

    def block(acc, x):
        total = F.aggregate(x, zero, lambda n, y: n + y["gap"] + y["size"])
        return F.struct((acc["at"] + total).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def match(acc, x):
        here = acc["at"] + x["gap"]
        return F.struct((here + x["size"]).alias("at"), F.concat(acc["out"], F.array(here)).alias("out"))

    bases = F.aggregate(blocks, start(zero), block, lambda acc: acc["out"])
    starts = F.flatten(F.zip_with(blocks, bases, lambda x, base: F.aggregate(x, start(base), match, lambda acc: acc["out"])))
    return F.when(F.size(m) == 0, none).otherwise(starts)


def personal_data(docs: DataFrame, text: str = "text", kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """docs with spans: array<struct<start, rank, end, kind, score>>, in order of start, then kind.

    Null and empty texts have no spans. Kinds are searched on their own, so spans of different kinds may overlap. A match that its test rejects is
    dropped and not tried again. score is the kind's own plus a bonus if one of its words stands within 40 characters before or 20 after. Repeated rows
    give repeated results, an empty table an empty one. Columns of docs may have any name; one named spans is replaced."""
    kept = [c for c in docs.columns if c != "spans"]
    out = docs.select(F.struct(*[docs[f"`{c}`"] for c in kept]).alias("row"), F.coalesce(docs[f"`{text}`"], F.lit("")).alias("t"))
    empty = F.array().cast("array<string>")
    for k in kinds:
        pattern, test, _, _ = KINDS[k]
        hit = F.col("t").rlike(test)
        if k in ("email", "phone"):
            hit = F.contains(F.col("t"), F.lit("@" if k == "email" else "+")) & hit
        out = out.withColumn(f"h_{k}", hit)
    out = out.withColumns({f"m_{k}": F.when(F.col(f"h_{k}"), F.regexp_extract_all("t", F.lit(KINDS[k][0]), F.lit(0))).otherwise(empty) for k in kinds} | {f"p_{k}": F.when(F.col(f"h_{k}"), F.split("t", KINDS[k][0], -1)).otherwise(empty) for k in kinds})
    out = out.withColumns({f"s_{k}": _places(k) for k in kinds})

    def spans(k: str) -> Column:
        m, p, s = F.col(f"m_{k}"), F.col(f"p_{k}"), F.col(f"s_{k}")
        _, _, words, score = KINDS[k]

        def span(value, i):
            near = F.right(F.get(p, i), F.lit(BEFORE)).rlike(words) | F.left(F.get(p, i + 1), F.lit(AFTER)).rlike(words)
            return F.struct(F.get(s, i).alias("start"), F.lit(list(KINDS).index(k)).alias("rank"), (F.get(s, i) + F.length(value)).alias("end"), F.lit(k).alias("kind"), (F.lit(score) + F.when(near, BONUS).otherwise(0.0)).alias("score"), _confirmed(k, value).alias("ok"))

        confirmed = F.filter(F.transform(m, span), lambda x: x["ok"])
        slim = F.transform(confirmed, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"), x["score"].alias("score")))
        return F.when(F.size(m) == 0, F.array().cast(f"array<{SPAN}>")).otherwise(slim.cast(f"array<{SPAN}>"))

    return out.select(*[F.col("row")[c].alias(c) for c in kept], F.sort_array(F.flatten(F.array(*[spans(k) for k in kinds]))).alias("spans"))


def redacted(found: DataFrame, text: str = "text", least: float = 0.0) -> Column:
    """text with each span of at least that score replaced by [kind]; of overlapping spans the first counts."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        return F.when((x["start"] < acc["at"]) | (x["score"] < least), acc).otherwise(F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substring(found[text], (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit("["), x["kind"], F.lit("]")).alias("out")))

    return F.aggregate(found["spans"], start, step, lambda acc: F.concat(acc["out"], F.substring(found[text], (acc["at"] + 1).cast("int"), F.length(found[text]))))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op9_personal_data(spark, sf_dir: str) -> DataFrame:
    """Counts and spans of all documents, with personal_data's rules for nulls, long texts, ties, repeated rows and empty tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = personal_data(docs)
    s = F.col("spans")
    number = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *[number(k).alias(f"n_{k}") for k in BASE], F.sha2(_listed(F.filter(s, lambda x: x["kind"] != "iban")), 256).alias("base_sha256"), _listed(s).alias("listed"), s.alias("scored")).withColumnRenamed("listed", "spans")
