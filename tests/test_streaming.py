"""Incremental cleaning: two arrivals of raw files give the same cleaned
rows as the batch pipeline over both (first arrival wins)."""

import os
import uuid

from pyspark.sql import functions as F

from ledgerwash.operators.cleaning import clean_transactions
from ledgerwash.session import ensure_checkpoint_dir
from ledgerwash.streaming.incremental import read_cleaned, start_cleaning_stream


def test_stream_matches_batch_pipeline(spark, tables):
    base = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex[:8]}")
    raw_dir, out_dir, ckpt = f"{base}/raw", f"{base}/out", f"{base}/ckpt"
    raw = tables.raw
    # First arrival: half of the originals; second: the other half plus all
    # re-sent copies (some of ids from the first arrival, some of their own).
    # The same folder and checkpoint across both runs, as for a live stream.
    raw.filter("ingest_seq = 1 AND (k % 2 = 0 OR transaction_id IS NULL)").coalesce(2).write.mode("append").parquet(raw_dir)
    first = start_cleaning_stream(spark, raw_dir, out_dir, ckpt, available_now=True)
    first.awaitTermination(300)
    raw.filter("NOT (ingest_seq = 1 AND (k % 2 = 0 OR transaction_id IS NULL))").write.mode("append").parquet(raw_dir)
    second = start_cleaning_stream(spark, raw_dir, out_dir, ckpt, available_now=True)
    second.awaitTermination(300)
    batches = [r[0] for r in spark.read.parquet(out_dir).select("batch_id").distinct().collect()]
    assert sorted(batches) == [0, 1]

    streamed = read_cleaned(spark, out_dir)
    batch = clean_transactions(raw)
    assert streamed.count() == batch.count()
    cols = [c for c in batch.columns]
    diff = streamed.select(cols).exceptAll(batch.select(cols)).count() + \
        batch.select(cols).exceptAll(streamed.select(cols)).count()
    assert diff == 0
    assert streamed.groupBy("transaction_id").count().filter(F.col("count") > 1).count() == 0


def _drained(spark, raw_dir, out_dir, ckpt):
    query = start_cleaning_stream(spark, raw_dir, out_dir, ckpt, available_now=True)
    query.awaitTermination(300)


def test_a_replaced_checkpoint_loses_nothing_and_repeats_nothing(spark, tables):
    base = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex[:8]}")
    raw_dir, out_dir = f"{base}/raw", f"{base}/out"
    first = F.expr("ingest_seq = 1 AND (k % 2 = 0 OR transaction_id IS NULL)")
    tables.raw.filter(first).coalesce(2).write.mode("append").parquet(raw_dir)
    _drained(spark, raw_dir, out_dir, f"{base}/ckpt-1")
    before = read_cleaned(spark, out_dir).count()
    tables.raw.filter(~first).write.mode("append").parquet(raw_dir)
    _drained(spark, raw_dir, out_dir, f"{base}/ckpt-2")  # batch ids begin at 0 again, over all files
    after = read_cleaned(spark, out_dir)
    assert before < after.count() == tables.clean.count()
    assert after.groupBy("transaction_id").count().filter("count > 1").count() == 0


def test_a_replayed_batch_replaces_itself(spark, tables):
    from ledgerwash.streaming.incremental import clean_batch, run_id
    base = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex[:8]}")
    run = run_id(spark, f"{base}/ckpt")
    assert run == run_id(spark, f"{base}/ckpt") != run_id(spark, f"{base}/other")
    for _ in range(2):
        clean_batch(tables.raw, 0, f"{base}/out", run)
    assert read_cleaned(spark, f"{base}/out").count() == tables.clean.count()


def test_a_cluster_needs_a_shared_checkpoint_folder():
    import pytest
    from types import SimpleNamespace as N
    conf = N(get=lambda *_: None)
    context = N(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(N(conf=conf, sparkContext=context))


def test_the_stream_keeps_marts_up_to_date(spark, tables):
    from ledgerwash.plans import views as V
    from ledgerwash.plans.incremental_marts import IncrementalMarts
    from ledgerwash.sources.publish import Publication
    base = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex[:8]}")
    marts = IncrementalMarts(Publication(spark, f"{base}/marts"))
    first = F.expr("ingest_seq = 1 AND (k % 2 = 0 OR transaction_id IS NULL)")
    for arrival in (tables.raw.filter(first), tables.raw.filter(~first)):
        arrival.coalesce(2).write.mode("append").parquet(f"{base}/raw")
        start_cleaning_stream(spark, f"{base}/raw", f"{base}/out", f"{base}/ckpt", available_now=True, marts=marts).awaitTermination(300)
    assert marts.publication.versions() == [1, 2]
    fact = V.clean_fact(read_cleaned(spark, f"{base}/out"))
    got = marts.marts(tables.customers)
    for name, want in (("vw_monthly_summary", V.vw_monthly_summary(fact)), ("kpi_summary", V.kpi_summary(fact))):
        assert sorted(map(repr, got[name].collect())) == sorted(map(repr, want.collect()))
