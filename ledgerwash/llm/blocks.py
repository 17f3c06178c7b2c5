"""Rows in one global order, dealt to blocks of bounded size.

``numbered`` gives every row its place in a total order by a range-partitioned
sort. ``BLOCK`` neighbouring places make a block, so a key with a third of all rows
is spread over many. ``scan`` then gives each block what all earlier (or later)
blocks of its key amount to, for any associative ``combine``: a tree over the
blocks folds at most ``1 << RADIX`` rows a group, so no task sees a whole key."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwash.llm.scratch import written

BLOCK = 12  # bits of a place within its block
RADIX = 9
_ROWS = (1 << 33) - 1  # monotonically_increasing_id keeps a row's number within its partition there


def block_of(place: str, bits: int = BLOCK) -> Column:
    return F.shiftright(F.col(place), bits)


def numbered(rows: DataFrame, *keys: str, without: tuple[str, ...] = (), name: str = "numbered") -> DataFrame:
    """``rows`` with ``place``, their number (from 0) in ascending order of ``keys``;
    rows that are equal in all of these stand in any order. Columns in ``without``
    take part in the sort only."""
    at = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                 .withColumn("_at", F.monotonically_increasing_id()).drop(*without), name)
    sizes = at.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"))
    # One row a partition of the sort: as many as the session has partitions.
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    return (at.withColumn("_part", F.shiftright("_at", 33)).join(starts, "_part")
            .withColumn("place", F.col("_start") + F.col("_at").bitwiseAND(F.lit(_ROWS))).drop("_part", "_at", "_start"))


Combine = Callable[[np.ndarray, np.ndarray], np.ndarray]


def scan(blocks: DataFrame, combine: Combine, last_first: bool = False, radix: int = RADIX) -> DataFrame:
    """(key, block, before): ``combine`` of the values of all blocks of the key that
    come before (after, if ``last_first``); null for the first. ``blocks``: key string,
    block long (unique for a key), value array<long>. ``combine`` always gets the
    earlier block's value first."""
    kind = "key string, block bigint, value array<bigint>"

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        value = None
        for v in group["value"]:
            value = v if value is None else combine(value, v)
        return pd.DataFrame({"key": [group["key"].iloc[0]], "block": [int(group["up"].iloc[0])], "value": [value]})

    def push(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block", ascending=not last_first)
        value, before = group["above"].iloc[0], []
        for v in group["value"]:
            before.append(value)
            value = v if value is None else combine(v, value) if last_first else combine(value, v)
        return pd.DataFrame({"key": group["key"], "block": group["block"], "before": before})

    levels = [blocks.select("key", "block", "value")]
    while not levels[-1].groupBy("key").count().where("count > 1").isEmpty():
        low = levels[-1].withColumn("up", F.shiftright("block", radix))
        levels.append(written(low.groupBy("key", "up").applyInPandas(fold, kind), "scan"))
    done = levels.pop().select("key", "block", F.lit(None).cast("array<bigint>").alias("before"))
    for level in reversed(levels):
        above = done.select("key", F.col("block").alias("up"), F.col("before").alias("above"))
        low = level.withColumn("up", F.shiftright("block", radix)).join(above, ["key", "up"])
        done = low.groupBy("key", "up").applyInPandas(push, "key string, block bigint, before array<bigint>")
    return done
