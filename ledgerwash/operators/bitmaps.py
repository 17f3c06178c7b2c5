"""Exact distinct counts over stored parts (V3, V5, Q5, V4).

``COUNT(DISTINCT customer)`` of months does not add up: a customer active in two
months is one customer. Here customers are numbered by a dictionary, and each group
keeps the set of its customers as bitmaps (``bitmap_construct_agg``: one row of 4 KB
for 32,768 numbers), which are stored. Any union of groups, such as a range of months,
is then ``bitmap_or_agg`` over stored rows, without a look at the facts.

The dictionary only grows: ``extended`` gives customers that it lacks the next numbers
and leaves the others alone, so stored bitmaps stay valid. Numbers are dense, so a
bitmap row of n customers costs n / 8 bytes when a group has most of them; a rare one
costs its 4 KB page.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

DICTIONARY = "value string, number bigint"


def extended(values: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """``dictionary`` (value, number from 1) and new numbers for the distinct non-NULL
    values of one column that it lacks. Written to the shared folder.

    Numbers are dealt by a sort over range partitions: a value's number is its place in
    its partition after the sizes of the partitions before (one row a partition)."""
    spark = values.sparkSession
    known = dictionary if dictionary is not None else spark.createDataFrame([], DICTIONARY)
    named = values.select(F.col(values.columns[0]).alias("value")).where("value IS NOT NULL").distinct()
    fresh = named.join(known, "value", "left_anti")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/dictionary-{uuid.uuid4().hex}"
    placed = fresh.repartitionByRange("value").sortWithinPartitions("value").withColumn("_at", F.monotonically_increasing_id())
    placed.write.parquet(f"{base}/sorted")
    placed = spark.read.parquet(f"{base}/sorted").select("value", F.shiftright("_at", 33).alias("_part"),
                                                         F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    used = known.agg(F.coalesce(F.max("number"), F.lit(0)).alias("m")).first()["m"]
    numbered = placed.join(starts, "_part").select("value", (F.col("_start") + F.col("_row") + 1 + F.lit(used)).alias("number"))
    known.select("value", "number").unionByName(numbered).write.parquet(f"{base}/numbers")
    return spark.read.schema(DICTIONARY).parquet(f"{base}/numbers")


def bitmaps(rows: DataFrame, groups: list[str], column: str, dictionary: DataFrame) -> DataFrame:
    """(groups, page, bits): the sets of ``column``'s values by group, as bitmap rows.
    Repeated rows of a group and value meet before the shuffle."""
    numbers = dictionary.select(F.col("value").alias(column), "number")
    told = rows.select(*groups, column).distinct().join(numbers, column)
    number = F.col("number")
    return told.groupBy(*groups, F.bitmap_bucket_number(number).alias("page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))


def merged(sets: DataFrame, groups: list[str]) -> DataFrame:
    """The unions of stored sets by ``groups`` (some of theirs, or none)."""
    return sets.groupBy(*groups, "page").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_counts(sets: DataFrame, groups: list[str], name: str) -> DataFrame:
    """(groups, ``name``): how many values the unions of stored sets hold."""
    counted = merged(sets, groups).groupBy(*groups).agg(F.sum(F.bitmap_count("bits")).alias(name))
    return counted if groups else counted.select(F.coalesce(name, F.lit(0)).alias(name))
