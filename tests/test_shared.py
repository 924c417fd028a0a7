import os

import pytest

from echograms.operators import long_suffixes
from echograms.sources.shared import cut, shared_folder, steps_removed


def below(folder):
    return [f for _, _, names in os.walk(folder.removeprefix("file:").replace("//", "/")) for f in names if f.endswith(".parquet")]


def test_steps_go_when_the_block_ends(spark, tmp_path):
    base, kept = shared_folder(spark), cut(spark.range(3), "kept")
    texts = spark.createDataFrame([(0, "banana" * 9), (1, "bandana" * 9)], "text_id long, body string")
    with steps_removed(spark) as folder:
        found = long_suffixes.pieced_suffix_array(long_suffixes.text_pieces(texts, 5), 3)
        found.write.parquet(str(tmp_path / "order"))
        assert folder.startswith(f"{base}/steps-") and shared_folder(spark) == folder and below(folder)
        with steps_removed(spark.newSession()) as other:
            assert not other.startswith(folder)
        with steps_removed(spark) as inner:
            cut(spark.range(2), "inner")
            assert inner.startswith(folder) and below(inner)
        assert not below(inner) and below(folder) and shared_folder(spark) == folder
    assert not os.path.exists(folder.removeprefix("file://")) and shared_folder(spark) == base
    assert spark.read.parquet(str(tmp_path / "order")).count() == 54 + 63 and kept.count() == 3


def test_steps_go_after_an_error(spark):
    base = shared_folder(spark)
    with pytest.raises(ZeroDivisionError), steps_removed(spark) as folder:
        cut(spark.range(2), "lost")
        raise ZeroDivisionError
    assert not os.path.exists(folder.removeprefix("file://")) and shared_folder(spark) == base
    with steps_removed(spark):
        pass  # nothing was written
