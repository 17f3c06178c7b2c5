"""What queries that write leave on the disks when their writes are done."""

import os
import re
import time

import pytest

from ledgerwash.plans.registry import REGISTRY
from ledgerwash.session import ensure_checkpoint_dir

SF = "/root/testdata/sf0.001"
WRITERS = ["a10_write_and_read_clean_fact", "a8_views_by_name", "d_profile_one_pass", "v1_quarter_from_clustered_fact",
           "s01_incremental_clean", "a3_load_raw_csv", "v_incremental_marts"]


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (found.apply(i).getName() for i in range(found.size())) if name.startswith("shuffle_")}


def settled(found, wanted, seconds=20):
    """``found()`` once it is ``wanted``; files are deleted in the background."""
    end = time.time() + seconds
    while found() != wanted and time.time() < end:
        time.sleep(0.2)
    return found()


@pytest.mark.parametrize("name", WRITERS)
def test_writes_leave_no_shuffle_files_and_no_scratch(spark, name):
    base = ensure_checkpoint_dir(spark)
    before, folders = shuffle_files(spark), set(os.listdir(base))
    result = REGISTRY[name](spark, SF)
    assert settled(lambda: shuffle_files(spark) - before, set()) == set()
    assert not [f for f in set(os.listdir(base)) - folders if f.startswith(("rows-", "_", "lookup-"))]
    assert result.count() > 0


def test_only_rows_of_seen_ids_are_joined_to_the_index(spark):
    from pyspark.sql import functions as F

    from ledgerwash.sources.publish import Publication
    from ledgerwash.streaming.seen_index import SeenIndex
    index = SeenIndex(Publication(spark, f"{ensure_checkpoint_dir(spark)}/seen-{time.time_ns()}"), buckets=8, pages=1)
    rows = spark.range(3010).select(F.concat(F.lit("T"), F.nullif("id", F.lit(3))).alias("id"), F.col("id").alias("n"))
    index.add(rows.where("n < 10").select("id"), "r", 0)
    fresh = index.unseen(rows, "id", "r", 1)
    once, again = fresh._jdf.queryExecution().executedPlan().toString().split("Union")[1].split("LeftAnti")
    # Of the others only the bitmap's pages cross an exchange.
    assert set(re.findall(r"Exchange hashpartitioning\((\w+)#", once.rsplit("Join", 1)[0])) == {"_page"} and "_bits" in again
    assert sorted(r.n for r in fresh.collect()) == list(range(10, 3010))


def test_raw_text_lands_compressed(spark):
    base = ensure_checkpoint_dir(spark)
    before = set(os.listdir(base))
    result = REGISTRY["a3_load_raw_csv"](spark, SF)
    landed, = (f for f in set(os.listdir(base)) - before if f.startswith("csv-"))
    files = [f for f in os.listdir(f"{base}/{landed}") if f.startswith("part-")]
    assert files and all(f.endswith(".csv.gz") for f in files)
    assert result.count() == REGISTRY["clean_transactions"](spark, SF).count()
