"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from diegrid.sources.tables import shared_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
TEXTS = 2 << 20          # bytes of an Arrow batch of texts, about


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile goes to Python in Arrow batches of about `TEXTS` bytes.

    A task holds a batch several times outside of its heap and again in Python. Else a batch is 10,000 rows, mostly
    all texts of a split."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, str(TEXTS))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_BYTES) if before is None else spark.conf.set(BATCH_BYTES, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` as Parquet below spark.checkpoint.dir and reads it back: lineage ends here, and a
    lost executor costs no more than the tasks that it ran. The folder's owner clears it.

    The shuffle files of the write are deleted when it ends: those of a long chain of steps would fill the disks else.
    The cleaner alone does not do it, as it spares what a DataFrame that is still held refers to."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)
