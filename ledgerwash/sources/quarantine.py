"""Quarantine of bad rows.

The strict pipeline stops at a row that it cannot read, the lenient one turns its
values into NULL. Here each line that was read is either accepted or rejected, and the
rejected ones are kept with the file they came from, their place in it, the text and
all reasons:

* ``malformed line``: more or fewer columns than declared, or text that the reader
  cannot take apart (the reader's corrupt-record column);
* ``amount is not a decimal(15,2)`` and ``transaction_date does not exist``: the casts
  for which ``clean_transactions(on_error="fail")`` would raise.

Lines are sorted out before deduplication, so a broken first copy does not stand in
the way of a sound one that came later. Accepted and rejected rows together are the
input, line by line; one scan writes both, as two folders of one table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cleaning import AMOUNT_ERROR, DATE_ERROR, cast_errors
from .raw import PLACE, with_arrival
from .schema import RAW_TRANSACTIONS_SCHEMA

LINE = "_line"
REASONS = {"malformed": "malformed line", "amount": "amount is not a decimal(15,2)", "date": "transaction_date does not exist"}
POSITION = "position"
_STATE = "rejected"


def load_checked(spark: SparkSession, path: str, fmt: str = "csv", schema=RAW_TRANSACTIONS_SCHEMA, **options) -> DataFrame:
    """``raw.load_raw`` for text files (csv, json) that also keeps the line of a
    malformed row (``_line``, NULL for others) and each row's file, split and position
    in the split. CSV lines have the 13 text columns of the schema."""
    text = T.StructType([f for f in schema.fields if f.name not in ("ingest_seq", "k")]) if fmt == "csv" else schema
    reader = spark.read.schema(T.StructType([*text.fields, T.StructField(LINE, T.StringType())])).option("mode", "PERMISSIVE")
    reader = reader.option("columnNameOfCorruptRecord", LINE)
    if fmt == "csv":
        reader = reader.option("header", "true").option("enforceSchema", "true")
    for key, value in options.items():
        reader = reader.option(key, value)
    rows = reader.format(fmt).load(path).select("*", *(F.col(f"_metadata.{c}").alias(c) for c in PLACE))
    for field in schema.fields:
        if field.name not in rows.columns:
            rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
    # The position is taken right above the scan, like the arrival.
    place = rows.withColumn(POSITION, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    kept = {c: F.col(c).alias(f"_{c}") for c in ("file_path", "file_block_start", POSITION)}
    arrived = with_arrival(place.select(*(c for c in place.columns if c != POSITION), *kept.values()))
    return arrived.withColumnsRenamed({f"_{c}": c for c in kept})


def reasoned(rows: DataFrame, null_notes: str = "sql") -> DataFrame:
    """``rows`` of ``load_checked`` with ``reasons``, an array that is empty for a sound
    row. A malformed line has that one reason: its columns may stand anywhere."""
    told = cast_errors(rows, null_notes)
    amount, date = F.col(AMOUNT_ERROR), F.col(DATE_ERROR)
    # One branch a case: a higher-order function (array_compact) would take the whole projection out of compiled code.
    told_as = lambda *names: F.array(*(F.lit(REASONS[n]) for n in names)).cast("array<string>")
    reasons = (F.when(F.col(LINE).isNotNull(), told_as("malformed")).when(amount & date, told_as("amount", "date"))
               .when(amount, told_as("amount")).when(date, told_as("date")).otherwise(told_as()))
    return told.withColumn("reasons", reasons).drop(AMOUNT_ERROR, DATE_ERROR)


def sort_out(rows: DataFrame, path: str, null_notes: str = "sql", mode: str = "error") -> None:
    """Write accepted and rejected rows in one pass."""
    reasoned(rows, null_notes).withColumn(_STATE, F.size("reasons") > 0).write.mode(mode).partitionBy(_STATE).parquet(path)


def _read(spark: SparkSession, path: str, rejected: bool) -> DataFrame:
    return spark.read.parquet(path).where(F.col(_STATE) == rejected).drop(_STATE)


def accepted(spark: SparkSession, path: str) -> DataFrame:
    """The sound rows, ready for ``clean_transactions`` (which cannot raise for them)."""
    return _read(spark, path, False).drop("reasons", LINE, "file_path", "file_block_start", POSITION)


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """The rejected rows: ``file_path``, ``file_block_start`` and ``position`` (the row's
    number in that split of the file), ``reasons``, the raw columns and the ``_line`` of
    a malformed one."""
    rows = _read(spark, path, True)
    first = ["file_path", "file_block_start", POSITION, "reasons"]
    return rows.select(*first, *(c for c in rows.columns if c not in (*first, "arrival")))


def reject_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rejected rows by file and reason, most first."""
    return (rejects(spark, path).select("file_path", F.explode("reasons").alias("reason")).groupBy("file_path", "reason")
            .count().orderBy(F.col("count").desc(), "file_path", "reason"))
