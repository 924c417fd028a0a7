"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

STEPS = "echograms.steps"  # a setting of the session: where steps go inside steps_removed


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or that of steps_removed below it. Where the setting is missing, a temporary one, but only if driver and tasks are one
    local process."""
    folder = spark.conf.get(STEPS, None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def steps_removed(spark: SparkSession) -> Iterator[str]:
    """Steps that any operator writes inside the block go to one folder below the shared one, which is removed at the end of the block, also after an error. A
    DataFrame made inside may read them, so its result must be written, elsewhere, inside too. Blocks can be nested; a session has one at a time, so jobs that
    run beside each other take a session each (spark.newSession())."""
    outer = spark.conf.get(STEPS, None)
    folder = f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}"
    spark.conf.set(STEPS, folder)
    try:
        yield folder
    finally:
        spark.conf.set(STEPS, outer) if outer else spark.conf.unset(STEPS)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: later steps start from files that any executor can read."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
