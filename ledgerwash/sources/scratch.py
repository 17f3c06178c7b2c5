"""Tables that a job writes for itself, and what it leaves on the executors' disks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """A write inside the block deletes its shuffle files at its end. Otherwise they stay
    until the driver's memory is collected, and pile up over the jobs before that. For
    writes, whose plan runs once; one that ran again would compute them anew."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to a shared folder and read back: computed once, kept by column and
    compressed. Whoever named the folder deletes it (``deleted``)."""
    spark = df.sparkSession
    with shuffles_released(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def beside(path: str) -> str:
    """The name of a new scratch folder next to ``path``; readers of the folder that both
    are in pass over it."""
    parent, slash, name = path.rstrip("/").rpartition("/")
    return f"{parent}{slash}_{name}-{uuid.uuid4().hex}"


def deleted(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
