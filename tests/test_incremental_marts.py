"""Marts kept up by deltas against their recomputation from all rows."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerwash.plans import views as V
from ledgerwash.plans.incremental_marts import IncrementalMarts
from ledgerwash.session import ensure_checkpoint_dir
from ledgerwash.sources.publish import Publication


@pytest.fixture
def marts(spark):
    return IncrementalMarts(Publication(spark, os.path.join(ensure_checkpoint_dir(spark), f"inc-{uuid.uuid4().hex[:8]}")))


@pytest.fixture(scope="module")
def clean(spark, tables):
    return spark.createDataFrame(tables.clean.collect(), tables.clean.schema)


def recomputed(clean, customers):
    fact = V.clean_fact(clean)
    return {"vw_category_summary": V.vw_category_summary(fact), "vw_monthly_summary": V.vw_monthly_summary(fact),
            "vw_customer_summary": V.vw_customer_summary(fact, customers), "vw_merchant_summary": V.vw_merchant_summary(fact),
            "vw_flagged_transactions": V.vw_flagged_transactions(fact), "kpi_summary": V.kpi_summary(fact)}


def same(got, want):
    assert set(got) == set(want)
    for name, df in want.items():
        assert got[name].columns == df.columns, name
        assert sorted(map(repr, map(tuple, got[name].collect()))) == sorted(map(repr, map(tuple, df.collect()))), name


def test_three_batches_give_the_full_recomputation_at_each_step(spark, tables, clean, marts):
    customers = tables.customers
    part = F.pmod(F.xxhash64("k"), F.lit(3))
    for batch in range(3):
        marts.apply(clean.where(part == batch), "r", batch)
    same(marts.marts(customers), recomputed(clean, customers))
    # Each version is a whole of its own, and a replayed batch changes nothing.
    same(marts.marts(customers, 2), recomputed(clean.where(part < 2), customers))
    assert marts.apply(clean.where(part == 1), "r", 1).number == 3
    same({"kpi_summary": marts.marts(customers)["kpi_summary"]}, {"kpi_summary": V.kpi_summary(V.clean_fact(clean))})
    # Compaction rewrites the segments and no result.
    version = marts.compact(most=2)
    assert version.number == 4 and {len(s) for s in version.tables.values()} == {1}
    same(marts.marts(customers), recomputed(clean, customers))
    assert marts.compact(most=2).number == 4


def test_a_failing_batch_leaves_the_marts_as_they_were(spark, tables, clean, marts):
    marts.apply(clean.where("k % 2 = 0"), "r", 0)
    before = marts.marts(tables.customers)["vw_category_summary"].collect()
    failing = clean.where("k % 2 = 1").withColumn("status", F.when(F.col("k") % 501 == 0, F.raise_error(F.lit("lost"))).otherwise(F.col("status")))
    with pytest.raises(Exception, match="lost"):
        marts.apply(failing, "r", 1)
    assert marts.publication.versions() == [1]
    assert marts.marts(tables.customers)["vw_category_summary"].collect() == before
    marts.apply(clean.where("k % 2 = 1"), "r", 1)
    same(marts.marts(tables.customers), recomputed(clean, tables.customers))


def test_a_later_batch_changes_flags_of_earlier_rows(spark, tables, clean, marts):
    """The baseline of a customer moves, so rows of earlier batches are judged again."""
    one = clean.where("transaction_type = 'debit' AND amount_clean IS NOT NULL").limit(1).withColumns(
        {"customer_id": F.lit("C"), "notes": F.lit(None).cast("string"), "transaction_date_clean": F.lit("2024-01-02").cast("date")})
    rows = one.crossJoin(spark.range(40)).withColumn("amount_clean", F.when(F.col("id") == 0, 900).otherwise(F.col("id") % 7 + 10).cast("decimal(15,2)"))
    first, rest = rows.where("id < 8").drop("id"), rows.where("id >= 8").drop("id")
    marts.apply(first, "r", 0)
    assert marts.marts(tables.customers)["kpi_summary"].first().flagged_transactions == 0  # too short a history
    marts.apply(rest, "r", 1)
    assert marts.marts(tables.customers)["kpi_summary"].first().flagged_transactions == 1
    same(marts.marts(tables.customers), recomputed(rows.drop("id"), tables.customers))


def test_summaries_read_no_facts(spark, tables, clean, marts):
    marts.apply(clean, "r", 0)
    files = lambda df: {f.split("/snapshots/")[1].split("/")[1] for f in df.inputFiles()}
    got = marts.marts(tables.customers)
    assert files(got["vw_category_summary"]) == files(got["vw_merchant_summary"]) == {"by_customer"}
    assert files(got["vw_monthly_summary"]) == {"by_month"}
    assert "fact" not in files(got["kpi_summary"])


def scanned(df):
    """Rows that the scan of one segment handed on, and folders that it read."""
    df.collect()
    metrics = df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
    return metrics.apply("numOutputRows").value(), metrics.apply("numPartitions").value()


def test_a_batch_reads_the_buckets_of_its_customers_only(spark, tables, clean, marts):
    many = clean.withColumn("customer_id", F.when(F.col("k") % 97 > 0, F.concat(F.lit("C"), F.col("k") % 500)))
    few = many.where("customer_id IN ('C7', 'C8') AND k % 2 = 0")
    marts.apply(many.join(few.select("k"), "k", "left_anti"), "r", 0)
    marts.apply(few, "r", 1)
    assert few.count() and marts.publication.version().notes["buckets"] == 64
    same(marts.marts(tables.customers), recomputed(many, tables.customers))
    # What the second batch looked at: at most two of 64 folders of either table.
    buckets = [r[0] for r in few.select(F.pmod(F.xxhash64("customer_id"), F.lit(64)).cast("int")).distinct().collect()]
    first = marts.publication.version(1)
    for name in ("fact", "by_customer"):
        part, = marts._parts(name, first, buckets=buckets)
        (rows, folders), (all_rows, all_folders) = scanned(part), scanned(marts.publication.read(name, 1))
        assert rows == part.count() < all_rows / 8 and folders <= 2 < all_folders, name


def test_sums_take_no_shuffle_of_the_states(spark, tables, clean, marts):
    """What only adds up over batches crosses no exchange by the states' key, nor facts one by another than the join's."""
    for batch in range(2):
        marts.apply(clean.where(F.pmod("k", F.lit(2)) == batch), "r", batch)
    found = marts.marts(tables.customers)
    keyed = lambda name: [line for line in found[name]._jdf.queryExecution().executedPlan().toString().split("\n")
                          if "Exchange hashpartitioning(customer_id" in line and "merchant_name" in line.split("ENSURE")[0]]
    assert keyed("vw_merchant_summary")  # its distinct customers need them
    assert not any(keyed(name) for name in ("vw_category_summary", "vw_flagged_transactions", "kpi_summary"))


def test_batches_without_rows_between_others(spark, tables, clean, marts):
    marts.apply(clean.where("k % 2 = 0"), "r", 0)
    marts.apply(clean.limit(0), "r", 1)
    marts.apply(clean.where("k % 2 = 1"), "r", 2)
    same(marts.marts(tables.customers), recomputed(clean, tables.customers))
    marts.compact(most=1)
    same(marts.marts(tables.customers), recomputed(clean, tables.customers))


def test_one_customer_with_most_rows(spark, tables, clean, marts):
    hot = clean.withColumn("customer_id", F.when(F.col("k") % 3 > 0, F.lit("C1")).otherwise(F.col("customer_id")))
    marts.apply(hot, "r", 0)
    same(marts.marts(tables.customers), recomputed(hot, tables.customers))


def test_an_empty_batch_and_empty_marts(spark, tables, clean, marts):
    marts.apply(clean.limit(0), "r", 0)
    same(marts.marts(tables.customers), recomputed(clean.limit(0), tables.customers))
