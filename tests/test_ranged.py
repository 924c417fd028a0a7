import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

from echograms.operators import long_suffixes, suffixes
from echograms.sources import ranged, texts as src

TEXTS = ["", "x", "\n", "\n\n\n", ">only a header", ">h\n", "a\nb", "a\nb\n", "é漢🎈\n" * 9, "@1\nACGT\n+\n!!!!\n@2\n\n+\n!!\n", "@1\n", ">h é\nACGTx\nNN-é\nAC", ">" + "h" * 40 + "\n" + "ACGTN\n" * 8, "no end " * 12]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("ranged")
    for i, text in enumerate(TEXTS):
        (folder / f"{i:02}.txt").write_bytes(text.encode())
    (folder / "_SUCCESS").write_text("not read")
    (folder / ".hidden").write_text("not read")
    return str(folder)


def whole(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "text_id long, body string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def glued(pieces):
    found = {i: "" for i in range(len(TEXTS))}
    for text, piece, body in rows(pieces):
        assert len(found[text]) == piece and body
        found[text] += body
    return list(found.values())


@pytest.mark.parametrize("separator", ["\n", "é", "漢", "🎈"])
@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_each_record_begins_in_one_range(monkeypatch, separator, block):
    monkeypatch.setattr(ranged, "BLOCK", block)
    rng, sep = random.Random(block), separator.encode()
    for text in [*TEXTS, *("".join(rng.choice("aé漢🎈\n") for _ in range(rng.randrange(30))) for _ in range(20))]:
        raw = text.encode()
        for size in (1, 2, 3, 5, 8, 64):
            edges = [*range(0, max(1, len(raw)), size), len(raw) + 1]
            got = []
            for lo, hi in zip(edges, edges[1:], strict=False):
                found = [r for b in ranged.record_blocks(io.BytesIO(raw), lo, hi, sep) for r in b]
                assert len(found) == ranged.records_begun(io.BytesIO(raw), lo, hi, sep)
                got += found
            parts = raw.split(sep)
            assert got == [*((p, True) for p in parts[:-1]), (parts[-1], False)]
            pieces = [b[0] for lo, hi in zip(edges, edges[1:], strict=False) for b in ranged.text_blocks(io.BytesIO(raw), lo, min(hi, len(raw)), b"")]
            assert "".join(pieces) == text


def test_broken_characters_are_neither_lost_nor_doubled(monkeypatch):
    monkeypatch.setattr(ranged, "BLOCK", 3)
    raw = b"a" + b"\x80" * 11 + b"\xf0\x9f" + b"b\xe6\xbc"
    pieces = "".join(b[0] for lo in range(0, len(raw), 4) for b in ranged.text_blocks(io.BytesIO(raw), lo, min(lo + 4, len(raw)), b""))
    assert pieces.count("�") >= 12 and pieces.replace("�", "") == "ab"


@pytest.mark.parametrize("size", [11, 1 << 20])
def test_files_by_ranges_equal_whole_files(spark, folder, size):
    texts = whole(spark)
    ended = ranged.records(spark, folder, "\n", size).where("ended").drop("ended")
    assert rows(ended) == rows(src.records(texts))
    assert rows(ranged.fastq_records(spark, folder, size)) == rows(src.fastq_records(texts))
    assert glued(ranged.text_pieces(spark, folder, size)) == TEXTS
    bodies = [r.body for r in texts.select("text_id", src.fasta_body(F.col("body")).alias("body")).orderBy("text_id").collect()]
    assert glued(ranged.fasta_pieces(spark, folder, size=size)) == bodies
    for start, stop in ((2, 9), (7, None), (None, 5), (5, 5)):
        named = f"{folder}[{'' if start is None else start}:{'' if stop is None else stop}]"
        assert {(t, p, b) for t, p, b in rows(ranged.fasta_pieces(spark, named, size=size))} == {(t, p, b) for t, p, b in sliced(bodies, start, stop, ranged.fasta_pieces(spark, folder, size=size))}


def sliced(bodies, start, stop, pieces):
    lo = start or 0
    for text, piece, body in rows(pieces):
        hi = len(bodies[text]) if stop is None else stop
        a, b = max(piece, lo), min(piece + len(body), hi)
        if a < b:
            yield text, a, bodies[text][a:b]


def test_files_are_listed_and_dropped_characters_counted(spark, folder, tmp_path):
    assert [(r.text_id, r.path[-6:], r.size) for r in ranged.files(spark, folder).orderBy("text_id").collect()] == [(i, f"{i:02}.txt", len(t.encode())) for i, t in enumerate(TEXTS)]
    counted = {r.text_id: (r.kept, r.dropped) for r in ranged.fasta_lengths(spark, folder, size=5).collect()}
    assert counted[11] == (8, 3) and counted[12] == (40, 0) and counted[0] == (0, 0)
    assert ranged.fastq_records(spark, f"file://{folder}/09.txt", 4).orderBy("read").select("body").collect() == [("ACGT",), ("",)]
    (tmp_path / "a.fa.gz").write_bytes(gzip.compress(b"ACGT"))
    with pytest.raises(Exception, match="whole_files"):
        ranged.text_pieces(spark, str(tmp_path)).collect()
    (tmp_path / "none").mkdir()
    assert ranged.text_pieces(spark, str(tmp_path / "none")).collect() == [] and ranged.files(spark, str(tmp_path / "none")).collect() == []
    with pytest.raises(Exception, match="missing"):
        ranged.text_pieces(spark, str(tmp_path / "missing")).collect()
    with pytest.raises(ValueError, match="one character"):
        ranged.records(spark, folder, "~~")


def test_only_the_ranges_of_a_slice_are_read(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">g\n" + "ACGTACGTAC\n" * 1000)
    asked = ranged.fasta_pieces(spark, f"{tmp_path}/g.fa[4K:4100]", size=256)
    assert asked.rdd.getNumPartitions() <= 3
    assert "".join(b for _, _, b in rows(asked)) == ("ACGTACGTAC" * 1000)[4000:4100]


def test_pieces_of_a_file_are_sorted_without_putting_them_together(spark, tmp_path):
    rng = random.Random(3)
    body = "".join(rng.choice("ACGT") for _ in range(700))
    (tmp_path / "g.fa").write_text(">g\n" + "\n".join(body[i : i + 80] for i in range(0, len(body), 80)) + "\n")
    pieces = ranged.fasta_pieces(spark, str(tmp_path / "g.fa"), size=100)
    got = rows(long_suffixes.pieced_suffix_array(pieces, 4).select("text_id", "rank", "pos"))
    assert got == rows(suffixes.suffix_array(spark.createDataFrame([(0, body)], "text_id long, body string")).select("text_id", "rank", "pos"))
