"""Running totals over any key by a two-pass prefix sum.

A window ``PARTITION BY key ORDER BY ...`` sends all rows of a key to one task. Here the
rows are sorted by (key, order) over range partitions, which cut through a key, even
through one day of it, wherever it is long:

1. the sorted rows are written with the number of their range partition (their block);
2. each block is summed per key, and a window over these sums, one row a block and key,
   gives what stands before the block (block sums, scan);
3. each row adds its running total within its block and key.

The second pass deals rows by block, so tasks are as even as the sort made them. All
sums are exact decimals, so the result does not depend on the cuts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

BLOCK = "_block"


def blocks(rows: DataFrame, key: str, order: list[Column], partitions: int | None = None) -> DataFrame:
    """``rows`` in blocks of the order (key, ``order``), written to the shared folder."""
    by = [F.col(key).asc_nulls_first(), *order]
    dealt = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    path = f"{ensure_checkpoint_dir(rows.sparkSession).rstrip('/')}/prefix-{uuid.uuid4().hex}"
    dealt.sortWithinPartitions(*by).withColumn(BLOCK, F.spark_partition_id()).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def running_totals(rows: DataFrame, key: str, order: list[Column], value: str, total: str, number: str,
                   partitions: int | None = None) -> DataFrame:
    """``rows`` with ``total``, the sum of ``value`` over the rows of the key up to this
    one in ``order`` (which must be total within a key), and ``number``, how many they
    are. NULL is a key like any other; NULL values add nothing. Runs a job (the sort)
    while the plan is built."""
    sorted_ = blocks(rows, key, order, partitions)
    sums = sorted_.groupBy(BLOCK, key).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col(BLOCK).alias("_b"), F.col(key).alias("_k"), F.sum("_sum").over(earlier).alias("_sum_before"),
                         F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"))
    # Range partitioning by block clusters (block, key), so the window needs no shuffle of its own.
    dealt = sorted_.repartitionByRange(partitions, BLOCK) if partitions else sorted_.repartitionByRange(BLOCK)
    within = Window.partitionBy(BLOCK, key).orderBy(*order)
    running = F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    told = dealt.withColumns({"_running": running, "_row": F.row_number().over(within)})
    same = (F.col(BLOCK) == F.col("_b")) & F.col(key).eqNullSafe(F.col("_k"))
    zero = F.lit(0)
    whole = F.when(F.col("_running").isNotNull() | F.col("_sum_before").isNotNull(),
                   F.coalesce("_running", zero) + F.coalesce("_sum_before", zero))
    return told.join(before, same).select(
        *rows.columns, whole.alias(total), (F.col("_rows_before") + F.col("_row")).cast("bigint").alias(number))
