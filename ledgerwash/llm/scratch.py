"""Tables in the folder that the cluster shares (``spark.checkpoint.dir``).

Iterative jobs and tables that are used twice are written there and read
again: the lineage ends at the files, so a lost executor costs one read and
not the whole chain of rounds. Parquet keeps them smaller than ``checkpoint``,
and each is computed once.

Results are lazy and read these tables when they run, so an operator cannot delete
them itself. Its caller can: ``owned`` deletes at its end what was written within."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from ledgerwash.session import ensure_checkpoint_dir

_owner: ContextVar[Tables | None] = ContextVar("owner of written tables", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    if (tables := _owner.get()) is not None:
        tables.paths.append(path)  # also if the write fails midway
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a ``written`` table that nothing needs any more
    (a round that the next one has replaced)."""
    files = df.inputFiles()
    if files:
        _delete(spark, files[0].rsplit("/", 1)[0])


class Tables:
    """The tables written inside a block of ``owned``."""

    def __init__(self, outer: Tables | None) -> None:
        self.paths: list[str] = []
        self.outer = outer

    def kept(self, df: DataFrame) -> DataFrame:
        """``df``, a ``written`` table, outlives the block; an outer block gets it."""
        folders = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in df.inputFiles()}
        stay = [p for p in self.paths if p.rsplit("/", 1)[-1] in folders]
        self.paths = [p for p in self.paths if p not in stay]
        if self.outer is not None:
            self.outer.paths += stay
        return df


@contextmanager
def owned(spark: SparkSession) -> Iterator[Tables]:
    """The tables that operators write inside the block are deleted at its end, also
    after an error, but those handed to ``kept``. Write or collect results inside it."""
    tables = Tables(_owner.get())
    token = _owner.set(tables)
    try:
        yield tables
    finally:
        _owner.reset(token)
        for path in tables.paths:
            _delete(spark, path)
