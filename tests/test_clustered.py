"""Files and row groups that selective reads skip."""

import datetime
import os
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerwash.session import ensure_checkpoint_dir
from ledgerwash.sources import clustered as C
from ledgerwash.sources.sinks import write_clean_fact

ROWS = 60_000


@pytest.fixture(scope="module")
def laid(spark):
    base = os.path.join(ensure_checkpoint_dir(spark), f"clustered-{uuid.uuid4().hex[:8]}")
    rows = spark.range(ROWS).select(
        F.sha2(F.col("id").cast("string"), 256).alias("transaction_id"), F.format_string("C%04d", F.col("id") * 7919 % 500).alias("customer_id"),
        F.expr("date_add(DATE'2024-01-15', CAST(id % 11 * 15 AS INT))").alias("transaction_date_clean"), F.col("id").alias("k"))
    C.write_clustered(rows, f"{base}/clustered", files=24, expected_ids=5000)
    write_clean_fact(rows.repartition(4), f"{base}/plain")
    return base, rows


def scanned(df):
    """Rows that the scan handed on, and files that it read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan
    metrics = plan.collectLeaves().head().metrics()
    return metrics.apply("numOutputRows").value(), metrics.apply("numFiles").value()


def test_dates_prune_month_folders(spark, laid):
    base, rows = laid
    fact = C.read_clustered(spark, f"{base}/clustered")
    first, last = datetime.date(2024, 2, 1), datetime.date(2024, 3, 10)
    some = C.between(fact, first, last)
    want = rows.where(F.col("transaction_date_clean").between(first, last))
    assert some.exceptAll(want).isEmpty() and some.count() == want.count() > 0
    read, files = scanned(some)
    assert read < 0.5 * ROWS and files < 0.5 * len(fact.inputFiles())
    assert "PartitionFilters: [isnotnull(year_month" in some._jdf.queryExecution().executedPlan().toString()


def test_customers_skip_files_by_minimum_and_maximum(spark, laid):
    base, rows = laid
    some = C.of_customers(C.read_clustered(spark, f"{base}/clustered"), ["C0007", "C0010"])
    assert some.count() == rows.where("customer_id IN ('C0007', 'C0010')").count() == 240
    assert scanned(some)[0] < 0.4 * ROWS
    # The plain layout spreads each customer over every file.
    assert scanned(spark.read.parquet(f"{base}/plain").where("customer_id = 'C0007'"))[0] > 0.9 * ROWS


def test_ids_skip_row_groups_by_bloom_filter(spark, laid):
    base, rows = laid
    wanted = rows.where("k = 4711").first().transaction_id
    some = C.of_ids(C.read_clustered(spark, f"{base}/clustered"), [wanted])
    assert [r.k for r in some.collect()] == [4711]
    assert scanned(some)[0] < 0.15 * ROWS
    assert scanned(spark.read.parquet(f"{base}/plain").where(F.col("transaction_id") == wanted))[0] > 0.5 * ROWS
    none = C.of_ids(C.read_clustered(spark, f"{base}/clustered"), ["no such id"])
    assert none.count() == 0


def test_rows_without_a_date_or_customer_stay(spark):
    path = os.path.join(ensure_checkpoint_dir(spark), f"clustered-{uuid.uuid4().hex[:8]}")
    rows = spark.createDataFrame([("T1", None, None, 1), (None, "C1", datetime.date(2024, 1, 1), 2)],
                                 "transaction_id string, customer_id string, transaction_date_clean date, k int")
    C.write_clustered(rows, path)
    fact = C.read_clustered(spark, path)
    assert sorted(r.k for r in fact.collect()) == [1, 2] and fact.schema[C.MONTH].dataType.simpleString() == "string"
    assert [r.k for r in C.between(fact, datetime.date(2024, 1, 1), datetime.date(2024, 1, 31)).collect()] == [2]
