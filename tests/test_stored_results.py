import os
import random
from collections import Counter

import pytest

from echograms.operators import sets
from echograms.sources.texts import read_section, write_section
from echograms.streaming import folding


def test_folds_of_batches_in_any_order_equal_one_run(spark, tmp_path):
    rng = random.Random(51)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 25)))
    bases = spark.createDataFrame([(1, word()), (2, word()), (3, "")], "text_id long, body string")
    rows = [(rng.choice((1, 2, 3, 9)), 100 + i, None if i == 4 else word()) for i in range(12)]
    schema = "base_id long, text_id long, body string"
    texts = bases.union(spark.createDataFrame([r[1:] for r in rows], "text_id long, body string"))
    relation = spark.createDataFrame([r[:2] for r in rows], "base_id long, other_id long").where("base_id < 9")
    statistics = sets.matching_statistics(texts, relation)
    want = {(r.base_id, r.pos): r.len for r in sets.fold(statistics, "all").collect()}, {(r.base_id, r.pos): r.len for r in sets.fold(statistics, "any").collect()}
    many = Counter(r.base_id for r in relation.collect())
    for order in ((0, 1, 2), (2, 0, 1)):
        path, folder, checkpoint = (f"{tmp_path}/{name}{order[0]}" for name in ("texts", "fold", "checkpoint"))
        for part in order:
            spark.createDataFrame(rows[part::3], schema).coalesce(1).write.mode("append").parquet(path)
            folding.fold_stream(spark.readStream.schema(schema).parquet(path), bases, folder, checkpoint).awaitTermination()
        got = folding.stored_fold(spark, folder).collect()
        assert {(r.base_id, r.pos): (r.held_by_all, r.held_by_any, r.texts) for r in got} == {k: (v, want[1][k], many[k[0]]) for k, v in want[0].items()}
    folding.fold_batch(bases, folder)(spark.createDataFrame(rows[order[1] :: 3], schema), 1)  # the second batch once more
    assert sorted(folding.stored_fold(spark, folder).collect()) == sorted(got)
    folding.fold_stream(spark.readStream.schema(schema).parquet(path), bases, folder, checkpoint).awaitTermination()  # nothing new
    assert sorted(folding.stored_fold(spark, folder).collect()) == sorted(got)


def test_replacing_one_part_of_a_section_leaves_the_others(spark, tmp_path):
    files = lambda: {(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(tmp_path / "sec") for f in names if f.endswith(".parquet")}
    write_section(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "text_id long, body string"), str(tmp_path), "sec", "text_id")
    before = files()
    write_section(spark.createDataFrame([(2, "new"), (2, "er")], "text_id long, body string"), str(tmp_path), "sec", "text_id", only_given=True)
    assert sorted((r.text_id, r.body) for r in read_section(spark, str(tmp_path), "sec").collect()) == [(1, "a"), (2, "er"), (2, "new"), (3, "c")]
    after = files()
    assert {k: v for k, v in before.items() if "text_id=2" not in k[0]} == {k: v for k, v in after.items() if "text_id=2" not in k[0]}
    with pytest.raises(ValueError):
        write_section(spark.createDataFrame([(1,)], "x long"), str(tmp_path), "sec", only_given=True)
    write_section(spark.createDataFrame([(7, "z")], "text_id long, body string"), str(tmp_path), "sec", "text_id")
    assert [r.text_id for r in read_section(spark, str(tmp_path), "sec").collect()] == [7]
