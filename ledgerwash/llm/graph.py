"""Connected components by alternating large and small stars.

Every step is a grouped minimum and a join, so a node with many neighbours is
reduced before the shuffle and its rows may be split by AQE. Each round is a
table in the shared folder; nothing is collected but two numbers per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwash.llm.scratch import dropped, written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return (moved.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (two non-null columns ``a``, ``b``)
    but the roots themselves; the root is a component's smallest node. The number
    of rounds grows with the logarithm of the longest path."""
    spark = edges.sparkSession
    now, before = written(edges.select("a", "b").where("a <> b").distinct(), "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
        then = written(_small_star(_large_star(now).distinct()).distinct(), "edges")
        dropped(spark, now)
        now = then
