"""Incremental cleaning with Structured Streaming.

Raw files landing in a folder are cleaned batch by batch and appended to a
cleaned table. Deduplication keeps the first arrival of every
``transaction_id`` over the whole stream:

* inside a micro-batch, the same rule as the batch pipeline (``dedup_first``,
  by ``ingest_seq`` or the place in the files);
* across micro-batches, by an index of the ids that are in (``seen_index``): Bloom
  bitmaps tell new ids at once, and a null-safe anti join (NULL ids form one group
  like in the batch rule) reads the ids of those buckets only that hold a possible
  match. Spark picks the join by its own size estimates.

Each batch writes the partition ``run_id=R/batch_id=N`` with dynamic partition
overwrite. R is stored in the checkpoint folder: a batch replayed after a
failure replaces its own output instead of appending twice, while a stream
that starts from a new checkpoint gets a new R, overwrites nothing, and counts
everything that earlier runs wrote as seen.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.incremental_marts import IncrementalMarts
from ..operators.cleaning import DEFAULT_DEDUP_ORDER, cleaned_rows
from .seen_index import SeenIndex
from ..sources.raw import PLACE, with_arrival
from ..sources.publish import Publication
from ..sources.schema import RAW_TRANSACTIONS_SCHEMA
from ..sources.scratch import beside, shuffles_released

BATCH_COLUMN = "batch_id"
RUN_COLUMN = "run_id"
_SEEN_SCHEMA = f"transaction_id string, {RUN_COLUMN} string, {BATCH_COLUMN} bigint"


def _path(spark: SparkSession, path: str):
    """(file system, path) of the JVM, for any scheme."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def run_id(spark: SparkSession, checkpoint_path: str) -> str:
    """The id that belongs to a checkpoint folder; made on first use."""
    fs, p = _path(spark, f"{checkpoint_path.rstrip('/')}/ledgerwash_run_id")
    if fs.exists(p):
        return spark.read.text(p.toString()).first()[0]
    new = uuid.uuid4().hex
    out = fs.create(p, False)
    out.write(bytearray(new.encode()))
    out.close()
    return new


def clean_batch(batch: DataFrame, batch_id: int, output_path: str, run: str, *, null_notes: str = "sql",
                on_error: str = "fail", dedup_order=DEFAULT_DEDUP_ORDER) -> DataFrame:
    """Clean one micro-batch and write it as partition ``run``, ``batch_id``; returns
    the rows that it added, read back."""
    spark = batch.sparkSession
    index, folder = index_of(spark, output_path), beside(output_path)
    with cleaned_rows(batch, folder, null_notes=null_notes, on_error=on_error, dedup_order=dedup_order) as rows:
        if index.empty() and (ids := _ids_before(spark, output_path, run, batch_id)) is not None:
            index.add(ids, "earlier output", 0)
        fresh = index.unseen(rows, "transaction_id", run, batch_id, f"{folder}/lookup")
        out = fresh.withColumn(RUN_COLUMN, F.lit(run)).withColumn(BATCH_COLUMN, F.lit(batch_id).cast("bigint"))
        with shuffles_released(spark):
            (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy(RUN_COLUMN, BATCH_COLUMN).parquet(output_path))
    added = spark.read.schema(out.schema).parquet(output_path)
    added = added.where((F.col(RUN_COLUMN) == run) & (F.col(BATCH_COLUMN) == batch_id)).drop(RUN_COLUMN, BATCH_COLUMN)
    index.add(added.select("transaction_id"), run, batch_id)
    index.compact()
    return added


def index_of(spark: SparkSession, output_path: str) -> SeenIndex:
    """The index of an output's ids: a folder beside it."""
    return SeenIndex(Publication(spark, f"{output_path.rstrip('/')}.seen"))


def _ids_before(spark: SparkSession, output_path: str, run: str, batch_id: int) -> DataFrame | None:
    """The ids of an output that has none indexed (written before there was an index)."""
    fs, p = _path(spark, output_path)
    if not fs.exists(p):  # any other problem with the history must fail the batch, not count as no history
        return None
    history = spark.read.schema(_SEEN_SCHEMA).parquet(output_path)
    return history.where((F.col(RUN_COLUMN) != run) | (F.col(BATCH_COLUMN) < batch_id)).select("transaction_id")


def start_cleaning_stream(spark: SparkSession, raw_path: str, output_path: str, checkpoint_path: str, *,
                          fmt: str = "parquet", max_files_per_trigger: int | None = None,
                          available_now: bool = False, processing_time: str | None = None,
                          null_notes: str = "sql", on_error: str = "fail", marts: IncrementalMarts | None = None,
                          **reader_options) -> StreamingQuery:
    """Watch ``raw_path`` for raw transaction files and keep ``output_path``
    cleaned. ``checkpoint_path`` must be a shared folder (it records which
    files and batches are done). ``marts``, if given, are brought up to date
    after each batch from the rows that it added."""
    reader = spark.readStream.schema(RAW_TRANSACTIONS_SCHEMA).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    for key, value in reader_options.items():
        reader = reader.option(key, value)
    raw = reader.load(raw_path).select("*", *(F.col(f"_metadata.{c}").alias(c) for c in PLACE))
    own_run = run_id(spark, checkpoint_path)

    def run(batch: DataFrame, batch_id: int) -> None:
        added = clean_batch(with_arrival(batch), batch_id, output_path, own_run, null_notes=null_notes, on_error=on_error)
        if marts is not None:
            marts.apply(added, own_run, batch_id)

    writer = raw.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_path)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def read_cleaned(spark: SparkSession, output_path: str) -> DataFrame:
    return spark.read.parquet(output_path).drop(RUN_COLUMN, BATCH_COLUMN)
