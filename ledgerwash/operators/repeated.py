"""Which keys of a written table come more than once, and its rows by that.

A join or window over wide rows shuffles them all, though it concerns the few whose key
comes again. Here the keys alone are counted, by a hash of theirs, and the repeated ones
marked in a bitmap that is small enough to broadcast: a row without its mark surely has
a key of its own and stays where it is. A mark may stand for another key, then a row is
looked at in vain, never missed.

The bitmap has about ``BITS`` bits a key, in rows of ``PAGE`` bits (4 KB), and at most
``MOST`` rows (64 MB), however many keys there are; beyond about 30 million more rows
are looked at, in the end all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import shuffles_released, written

PAGE = 32768  # bits of a row, as bitmap_construct_agg makes them
BITS = 16
MOST = 1 << 14
MARK = "_mark"


def repeated(rows: DataFrame, key: str, folder: str) -> DataFrame:
    """The marks (column ``MARK``) of the keys that more than one row has, NULL among
    them, written to ``folder``."""
    counts = rows.groupBy(F.xxhash64(key).alias(MARK)).agg(F.count(F.lit(1)).alias("rows"))
    return written(counts.where("rows > 1").select(MARK), folder)


def split(rows: DataFrame, marks: DataFrame, key: str, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """``rows`` as (those whose key surely has none of ``marks``, those whose key may have
    one); each row is in one of them. ``marks``, a written table of ``MARK``, is counted."""
    with shuffles_released(rows.sparkSession):
        found = marks.count()
    bits = min(most, max(1, -(-found * BITS // PAGE))) * PAGE
    spot = lambda mark: F.pmod(mark, F.lit(bits))
    page = lambda mark: F.floor(spot(mark) / PAGE).alias("_page")
    bit = lambda mark: (spot(mark) % PAGE).alias("_bit")
    bitmap = marks.select(page(F.col(MARK)), bit(F.col(MARK))).groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    placed = rows.select("*", page(F.xxhash64(key)), bit(F.xxhash64(key))).join(F.broadcast(bitmap), "_page", "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, CAST(_bit DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1, F.lit(False))
    return tuple(placed.where(held if side else ~held).select(*rows.columns) for side in (False, True))
