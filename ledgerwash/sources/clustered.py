"""A fact laid out for selective readers (V1, D3): month folders, files and row groups
clustered by customer, Bloom filters on ids.

* by date: a filter on the date also filters on the month folder, which is derived
  from it, so other months are not listed (``between``);
* by customer: within a month the rows are range-partitioned and sorted by customer,
  so each file and row group holds a narrow range of customers and its minimum and
  maximum exclude it for others;
* by transaction id: ids are scattered over all files, so minima and maxima say
  nothing; each row group has a Parquet Bloom filter on the id, and those that cannot
  hold it are skipped.

The layout costs one sort at the write. A customer with many rows in a month is cut
over several files (the id is the last sort key).
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import shuffles_released

MONTH = "year_month"
DATE = "transaction_date_clean"
#: Rows without a date live in this folder.
NO_MONTH = "none"


def write_clustered(fact: DataFrame, path: str, *, date_col: str = DATE, cluster: str = "customer_id", bloom: tuple[str, ...] = ("transaction_id",),
                    files: int | None = None, expected_ids: int = 1_000_000, mode: str = "error") -> None:
    """Write ``fact`` in month folders, sorted by ``cluster``, with Bloom filters on the
    columns ``bloom`` (sized for ``expected_ids`` values a row group). ``files``: range
    partitions of the sort; by default as many as the session's shuffle partitions,
    merged by AQE where they are small."""
    by = [MONTH, cluster, *bloom]
    rows = fact.withColumn(MONTH, F.coalesce(F.date_format(date_col, "yyyy-MM"), F.lit(NO_MONTH)))
    dealt = rows.repartitionByRange(files, *by) if files else rows.repartitionByRange(*by)
    out = dealt.sortWithinPartitions(*by).write.mode(mode).partitionBy(MONTH)
    for column in bloom:
        out = out.option(f"parquet.bloom.filter.enabled#{column}", "true").option(
            f"parquet.bloom.filter.expected.ndv#{column}", str(expected_ids))
    with shuffles_released(fact.sparkSession):
        out.parquet(path)


def read_clustered(spark: SparkSession, path: str) -> DataFrame:
    """The fact, with its month column as text."""
    found = spark.read.parquet(path).schema
    text = T.StructType([T.StructField(f.name, T.StringType() if f.name == MONTH else f.dataType) for f in found.fields])
    return spark.read.schema(text).parquet(path)


def between(fact: DataFrame, first: datetime.date, last: datetime.date, date_col: str = DATE) -> DataFrame:
    """Rows of the days ``first`` to ``last``: the folders of their months only."""
    months = F.col(MONTH).between(f"{first:%Y-%m}", f"{last:%Y-%m}")
    return fact.where(months & F.col(date_col).between(F.lit(first), F.lit(last))).drop(MONTH)


def of_customers(fact: DataFrame, customers: list[str], cluster: str = "customer_id") -> DataFrame:
    return fact.where(F.col(cluster).isin(customers)).drop(MONTH)


def of_ids(fact: DataFrame, ids: list[str], column: str = "transaction_id") -> DataFrame:
    """Rows of a few ids. One value is an equality, which Bloom filters answer."""
    wanted = F.col(column) == ids[0] if len(ids) == 1 else F.col(column).isin(ids)
    return fact.where(wanted).drop(MONTH)
