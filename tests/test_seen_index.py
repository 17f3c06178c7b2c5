"""The index of seen ids: exact answers, only the buckets that matter are read."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerwash.session import ensure_checkpoint_dir
from ledgerwash.sources.publish import Publication
from ledgerwash.streaming.incremental import index_of, read_cleaned, start_cleaning_stream
from ledgerwash.streaming.seen_index import SeenIndex


def new(spark, **sizes):
    return SeenIndex(Publication(spark, os.path.join(ensure_checkpoint_dir(spark), f"seen-{uuid.uuid4().hex[:8]}")), **sizes)


def ids(spark, a, b):
    return spark.range(a, b).select(F.concat(F.lit("T"), F.col("id")).alias("id"))


def left(df):
    return sorted(r.id or "" for r in df.collect())


@pytest.mark.parametrize("pages", [1, 16])
def test_only_ids_of_earlier_batches_are_seen(spark, pages):
    index = new(spark, buckets=16, pages=pages)
    assert index.unseen(ids(spark, 0, 50), "id", "r", 0).count() == 50
    index.add(ids(spark, 0, 4000), "r", 0)
    index.add(ids(spark, 4000, 9000).unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS id")), "r", 1)
    rows = ids(spark, 8900, 9100).unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS id")).unionByName(ids(spark, 9050, 9060))
    assert left(index.unseen(rows, "id", "r", 2)) == left(ids(spark, 9000, 9100).unionByName(ids(spark, 9050, 9060)))


def test_a_filter_that_is_full_still_gives_exact_answers(spark):
    index = new(spark, buckets=1, pages=1)
    index.add(ids(spark, 0, 30_000), "r", 0)  # nearly all of 32,768 bits are set
    assert index.unseen(ids(spark, 29_990, 30_400), "id", "r", 1).count() == 400


def test_only_touched_buckets_are_read(spark):
    index = new(spark, buckets=64, pages=2)
    index.add(ids(spark, 0, 20_000), "r", 0)
    version = index.publication.version()
    # New ids: bitmaps alone decide, no bucket is read.
    fresh = index.unseen(ids(spark, 50_000, 50_050), "id", "r", 1)
    assert not [f for f in fresh.inputFiles() if "/ids/" in f]
    assert index.maybe_seen(ids(spark, 50_000, 55_000), version).count() < 100
    # Three known ids: their buckets, a twentieth of the history.
    again = index.unseen(ids(spark, 50_000, 50_050).unionByName(ids(spark, 7, 10)), "id", "r", 1)
    assert again.count() == 50
    read = index._ids(version, [r.bucket for r in index.maybe_seen(ids(spark, 7, 10), version).collect()])
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert read.count() < 20_000 * 5 / 64


def test_a_batch_that_adds_no_id(spark):
    index = new(spark, buckets=8, pages=1)
    index.add(ids(spark, 0, 100), "r", 0)
    index.add(ids(spark, 0, 0), "r", 1)
    assert left(index.unseen(ids(spark, 90, 110), "id", "r", 2)) == left(ids(spark, 100, 110))


def test_a_replayed_batch_does_not_see_itself(spark):
    index = new(spark, buckets=8, pages=1)
    index.add(ids(spark, 0, 100), "r", 0)
    index.add(ids(spark, 100, 200), "r", 1)
    assert index.unseen(ids(spark, 50, 200), "id", "r", 1).count() == 100
    assert index.add(ids(spark, 100, 200), "r", 1).number == 2
    # Another run's batch of that number is another batch.
    assert index.unseen(ids(spark, 50, 250), "id", "other", 1).count() == 50


def test_compaction_changes_no_answer(spark):
    index = new(spark, buckets=8, pages=1)
    for batch in range(4):
        index.add(ids(spark, 100 * batch, 100 * batch + 100), "r", batch)
    index.compact(most=3)
    version = index.publication.version()
    assert {n: len(s) for n, s in version.tables.items()} == {"ids": 1, "bitmaps": 1}
    assert SeenIndex(index.publication, buckets=999).buckets == 8  # an index keeps its sizes
    assert index.unseen(ids(spark, 350, 450), "id", "r", 4).count() == 50
    assert index.unseen(ids(spark, 250, 400), "id", "r", 3).count() == 100


def test_an_output_written_before_there_was_an_index_is_indexed(spark, tables):
    base = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex[:8]}")
    first = F.expr("ingest_seq = 1 AND (k % 2 = 0 OR transaction_id IS NULL)")
    tables.raw.filter(first).coalesce(2).write.parquet(f"{base}/raw")
    start_cleaning_stream(spark, f"{base}/raw", f"{base}/out", f"{base}/a", available_now=True).awaitTermination(300)
    held = read_cleaned(spark, f"{base}/out").count()
    p = index_of(spark, f"{base}/out").publication
    p._fs.delete(p._path(""), True)
    start_cleaning_stream(spark, f"{base}/raw", f"{base}/out", f"{base}/b", available_now=True).awaitTermination(300)
    assert read_cleaned(spark, f"{base}/out").count() == held
    assert index_of(spark, f"{base}/out").publication.version().notes["batches"]["earlier output"] == 0
