"""Rows of keys that come once stay where they are: split, and cleaning for a write."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from helpers import tx
from ledgerwash.operators.cleaning import clean_transactions, cleaned_rows
from ledgerwash.operators.profile import tally, tallied
from ledgerwash.operators.repeated import repeated, split
from ledgerwash.session import ensure_checkpoint_dir


@pytest.fixture
def folder(spark):
    return os.path.join(ensure_checkpoint_dir(spark), f"repeated-{uuid.uuid4().hex[:8]}")


def keyed(spark):
    """4,000 keys once, 50 twice, one 500 times, NULL thrice."""
    key = F.when(F.col("id") < 4000, F.col("id")).when(F.col("id") < 4100, 4000 + F.col("id") % 50).when(F.col("id") < 4600, F.lit(9999))
    return spark.range(4603).select(F.concat(F.lit("T"), key).alias("key"), "id")


@pytest.mark.parametrize("most", [1, 1 << 14])
def test_split_leaves_keys_of_one_row_where_they_are(spark, folder, most):
    rows = keyed(spark)
    once, again = split(rows, repeated(rows, "key", folder), "key", most)
    once, again = ({r.id for r in df.collect()} for df in (once, again))
    assert not once & again and once | again == set(range(4603))
    assert set(range(4000, 4603)) <= again and len(again) < 603 + 400


def test_split_by_many_marks_loses_nothing(spark, folder):
    rows = spark.range(120_000).select(F.concat(F.lit("T"), F.col("id") % 60_000).alias("key"), "id")
    once, again = split(rows, repeated(rows, "key", folder), "key", most=1)  # 60,000 marks in 32,768 bits
    assert once.isEmpty() and again.count() == 120_000


def test_split_without_marks(spark, folder):
    rows = spark.range(100).select(F.col("id").cast("string").alias("key"))
    once, again = split(rows, repeated(rows, "key", folder), "key")
    assert once.count() == 100 and again.isEmpty()


def odd(spark):
    return tx(spark, *({"transaction_id": f"T{i}"} for i in range(200)),
              *({"transaction_id": f"T{i}", "ingest_seq": 2, "notes": "late"} for i in range(0, 200, 9)),
              *({"transaction_id": None, "amount": a} for a in ("3.00", "1.00", None)),
              {"transaction_id": "T5", "ingest_seq": 3, "amount": "a dropped copy may hold junk"})


def same(got, want):
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("on_error", ["fail", "null"])
def test_cleaned_rows_are_the_pipelines(spark, folder, on_error):
    raw = odd(spark)
    with cleaned_rows(raw, folder, on_error=on_error) as rows:
        assert os.path.isdir(folder)
        same(rows, clean_transactions(raw, on_error=on_error))
        assert rows.count() == 201
    assert not os.path.exists(folder)


def test_cleaned_rows_with_tallies(spark, folder):
    raw = odd(spark)
    with cleaned_rows(raw, folder, tally=tally()) as rows:
        want = tallied(raw)
        same(rows.select(*want.columns), want)


def test_cleaned_rows_of_the_fixture_and_of_none(spark, tables, folder):
    with cleaned_rows(tables.raw, f"{folder}/a") as rows:
        same(rows, tables.clean)
    with cleaned_rows(tables.raw.limit(0), f"{folder}/b") as rows:
        assert rows.isEmpty() and rows.columns == tables.clean.columns


def test_a_kept_row_that_no_cast_takes_raises_and_leaves_no_folder(spark, folder):
    raw = tx(spark, {"transaction_id": "T1", "amount": "junk"}, {"transaction_id": "T2"})
    with pytest.raises(Exception, match="amount is not a decimal"):
        with cleaned_rows(raw, folder) as rows:
            rows.collect()
    assert not os.path.exists(folder)


def test_rows_of_ids_that_come_once_are_not_shuffled(spark, folder):
    raw = odd(spark)
    with cleaned_rows(raw, folder) as rows:
        text = rows._jdf.queryExecution().executedPlan().toString()
        once, again = text.split("Union")[1].split("Window")[0], text.split("Window", 1)[1]
        assert "Exchange hashpartitioning(transaction_id" not in once and "Exchange hashpartitioning(transaction_id" in again
