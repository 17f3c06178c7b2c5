"""A bitmap of keys to broadcast, which tells rows that surely have none of them.

The bits lie in rows of ``PAGE`` bits (4 KB), about ``BITS`` a key and at most ``MOST``
rows (64 MB), however many keys there are: beyond that more rows are marked that have no
key, never fewer that have one. So a join that concerns few rows of a wide table need
shuffle little more than those."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = 32768  # bits of a row, as bitmap_construct_agg makes them
BITS = 16
MOST = 1 << 14


def split(rows: DataFrame, keys: DataFrame, key: list[str], most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """``rows`` as (those without any of ``keys``, those that may have one); each row is in
    one of them. Both tables have the columns ``key``, which may hold nulls (a null is a
    key like any other). ``keys`` is counted, so it should be a written table."""
    pages = min(most, max(1, -(-keys.count() * BITS // PAGE)))
    spot = F.pmod(F.xxhash64(*key), F.lit(pages * PAGE))
    page, bit = F.floor(spot / PAGE).alias("_page"), (spot % PAGE).alias("_bit")
    bitmap = keys.select(page, bit).groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    placed = rows.select("*", page, bit).join(F.broadcast(bitmap), "_page", "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, CAST(_bit DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    held = placed.withColumn("_held", F.coalesce(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1, F.lit(False)))
    return tuple(held.where(F.col("_held") == side).select(*rows.columns) for side in (False, True))
