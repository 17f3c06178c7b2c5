"""Land-raw readers (A3, A7): every business column is read as text with the
declared schema; nothing is inferred or cast on arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import CUSTOMERS_SCHEMA, RAW_TRANSACTIONS_SCHEMA


#: What a scan knows of a row's place in the files.
PLACE = ("file_modification_time", "file_path", "file_block_start")


def load_raw(spark: SparkSession, path: str, fmt: str = "parquet", schema=RAW_TRANSACTIONS_SCHEMA,
             **options) -> DataFrame:
    """Read a raw transactions table with an explicit schema, and with column
    ``arrival``, the place of each row (``with_arrival``), which decides the
    first arrival where the files have no ``ingest_seq``.

    For CSV, empty fields are read as NULL unless ``emptyValue`` says
    otherwise: how the loader treats empty text decides whether a note is
    NULL or '' (and with it which rows keep an amount, see the ``null_notes``
    switch of the pipeline). CSV columns are matched by position, in the
    declared order. Columns of ``schema`` missing from the files
    (``ingest_seq``, ``k``) come back NULL.
    """
    df = _read(spark, path, fmt, schema, options)
    return with_arrival(df.select("*", *(F.col(f"_metadata.{c}").alias(c) for c in PLACE)))


def _read(spark: SparkSession, path: str, fmt: str, schema, options: dict) -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true").option("inferSchema", "false")
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.format(fmt).load(path)


def load_customers(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return _read(spark, path, fmt, CUSTOMERS_SCHEMA, options)


def with_arrival(df: DataFrame) -> DataFrame:
    """Turn the ``PLACE`` columns of a scan into ``arrival`` for rows without an
    ``ingest_seq``: a text that sorts by the file's modification time, its path,
    the split's start, and the position in the split; and fill a missing ``k`` from a hash of the row. Must stand right
    above the scan, where a task's rows are still in file order. No shuffle."""
    number = lambda c: F.lpad(c.cast("string"), 20, "0")
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    place = [number(F.unix_micros("file_modification_time")), F.col("file_path"), number(F.col("file_block_start")),
             number(position)]
    text_cols = [F.col(c) for c in df.columns if c not in ("ingest_seq", "k", *PLACE)]
    return (df.withColumn("arrival", F.when(F.col("ingest_seq").isNull(), F.concat_ws("|", *place)))
            .withColumn("k", F.coalesce(F.col("k"), F.xxhash64(*text_cols))).drop(*PLACE))
