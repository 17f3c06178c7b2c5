"""Index of the ids that a stream has seen.

Ids are dealt to hash buckets, a folder each, so a lookup lists and reads only the
buckets that it needs. For each bucket there is a Bloom filter, kept as bitmap rows
(``bitmap_construct_agg``; those of several batches merge by ``bitmap_or_agg``): an id
without all its bits set has not been seen. A lookup

1. probes the bitmaps (4 KB each, of the buckets that the batch has ids in),
2. reads the buckets that hold an id with all bits set, and no others,
3. looks those ids up there and writes the ones found to a scratch folder: rows of
   other ids (``operators.repeated``) take no part in the null-safe anti join that
   removes them, so what is shuffled follows the copies and not the batch.

So a batch of new ids reads bitmaps only, however long the history; a full filter
costs more buckets, never a wrong answer. NULL is an id like any other.

The index is a publication: each batch appends one segment of ids and one of bitmaps
with one commit that names the batch. A batch that is replayed looks at the version
before its own commit, and is not added twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.repeated import MARK, split
from ..session import ensure_checkpoint_dir
from ..sources.publish import Publication, Version
from ..sources.scratch import shuffles_released, written

PAGE = 32768  # bits of one bitmap row
HASHES = 4


class SeenIndex:
    """``buckets`` and ``pages`` are fixed when an index is begun (its notes hold them):
    ``buckets * pages * PAGE / 10`` ids keep false alarms near one in a hundred."""

    def __init__(self, publication: Publication, buckets: int = 64, pages: int = 16):
        self.publication = publication
        notes = publication.version().notes
        self.buckets, self.pages = notes.get("buckets", buckets), notes.get("pages", pages)

    def empty(self) -> bool:
        return not self.publication.versions()

    def bucket(self, id_col: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(1), id_col), F.lit(self.buckets)).cast("int")

    def _bits(self, ids: DataFrame) -> DataFrame:
        """(id, bucket, page, bit) for each of an id's bits."""
        spots = F.array(*(F.pmod(F.xxhash64(F.lit(2 + i), "id"), F.lit(self.pages * PAGE)) for i in range(HASHES)))
        at = F.col("at")
        return ids.select("id", self.bucket("id").alias("bucket"), F.explode(F.array_distinct(spots)).alias("at")).select(
            "id", "bucket", F.floor(at / PAGE).cast("int").alias("page"), (at % PAGE).alias("bit"))

    def _before(self, run: str, batch: int) -> Version:
        """The version that a batch looks at: the newest, or the one before its own."""
        version = self.publication.version()
        if version.notes.get("batches", {}).get(run, -1) >= batch:
            return self.publication.version(version.notes["bases"][run])
        return version

    def add(self, ids: DataFrame, run: str, batch: int) -> Version:
        """Record one column of ids as those of a batch of a run."""
        version = self.publication.version()
        batches, bases = version.notes.get("batches", {}), version.notes.get("bases", {})
        if batches.get(run, -1) >= batch:
            return version
        named = ids.select(F.col(ids.columns[0]).alias("id"))
        bitmaps = self._bits(named).groupBy("bucket", "page").agg(F.bitmap_construct_agg("bit").alias("bits"))
        segments = self._written(named, bitmaps)
        return self.publication.commit(version, appended=segments, notes={
            "buckets": self.buckets, "pages": self.pages, "batches": batches | {run: batch}, "bases": bases | {run: version.number}})

    def _written(self, ids: DataFrame, bitmaps: DataFrame) -> dict[str, list[str]]:
        placed = ids.select("id", self.bucket("id").alias("bucket")).hint("rebalance", F.col("bucket"))
        return self.publication.write({"ids": placed, "bitmaps": bitmaps}, by={"ids": "bucket"})

    def maybe_seen(self, ids: DataFrame, version: Version) -> DataFrame:
        """Those of distinct ``ids`` (column id) whose bits are all set, with bucket."""
        bits = self._bits(ids)
        held = self.publication.read("bitmaps", version.number).groupBy("bucket", "page").agg(F.bitmap_or_agg("bits").alias("bits"))
        byte = F.conv(F.hex(F.expr("substring(bits, CAST(bit DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
        is_set = F.expr("getbit(byte, CAST(bit % 8 AS INT))") == 1
        probed = bits.join(held, ["bucket", "page"]).withColumn("byte", byte).where(is_set)
        # An id's bits differ (array_distinct), so all are set if as many are found as it has.
        found = probed.groupBy("id", "bucket").agg(F.count("*").alias("set"))
        wanted = F.size(F.array_distinct(F.array(*(F.pmod(F.xxhash64(F.lit(2 + i), "id"), F.lit(self.pages * PAGE)) for i in range(HASHES)))))
        return found.where(F.col("set") == wanted).select("id", "bucket")

    def _ids(self, version: Version, buckets: list[int]) -> DataFrame:
        return self.publication.read("ids", version.number).where(F.col("bucket").isin(buckets)).select("id")

    def unseen(self, rows: DataFrame, id_col: str, run: str, batch: int, folder: str | None = None) -> DataFrame:
        """``rows`` without those whose id an earlier batch has. Runs jobs over the ids,
        which write those found to ``folder`` (default: a new one in the shared folder);
        the result reads them there."""
        version = self._before(run, batch)
        if "ids" not in version.tables:
            return rows
        spark = rows.sparkSession
        folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/lookup-{uuid.uuid4().hex}"
        ids = rows.select(F.col(id_col).alias("id")).distinct()
        maybe = written(self.maybe_seen(ids, version), f"{folder}/maybe")
        with shuffles_released(spark):  # as many numbers as there are buckets, at most
            buckets = sorted(r.bucket for r in maybe.select("bucket").distinct().collect())
        if not buckets:
            return rows
        wanted = maybe.select(F.col("id").alias("_wanted"))
        seen = self._ids(version, buckets).join(wanted, F.col("id").eqNullSafe(F.col("_wanted")), "left_semi")
        seen = written(seen.select(F.col("id").alias("_seen_id"), F.xxhash64("id").alias(MARK)), f"{folder}/seen")
        fresh, again = split(rows, seen, id_col)
        return fresh.unionByName(again.join(seen.drop(MARK), again[id_col].eqNullSafe(F.col("_seen_id")), "left_anti"))

    def compact(self, most: int = 24) -> Version:
        """Rewrite an index of more than ``most`` segments as one of each kind, and
        sweep up what no version names any more."""
        version = self.publication.version()
        if len(version.tables.get("ids", [])) <= most:
            return version
        ids = self.publication.read("ids", version.number).select("id")
        bitmaps = self.publication.read("bitmaps", version.number).groupBy("bucket", "page").agg(F.bitmap_or_agg("bits").alias("bits"))
        done = self.publication.commit(version, replaced=self._written(ids, bitmaps))
        self.publication.expire(keep=4)
        return done
