"""The one-pass profile: equal to the single checks, one scan, one job's own stage."""

import os
import re
import uuid

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from ledgerwash.operators import quality as D
from ledgerwash.operators.cleaning import clean_transactions
from ledgerwash.operators.profile import QualityError, require, tallied, watched, write_profiled
from ledgerwash.session import ensure_checkpoint_dir
from ledgerwash.sources.schema import TRANSACTION_LENGTH_LIMITS
from ledgerwash.sources.sinks import read_clean_fact


@pytest.fixture
def path(spark):
    return os.path.join(ensure_checkpoint_dir(spark), f"profile-{uuid.uuid4().hex[:8]}")


def singles(raw, null_notes="sql"):
    """The same numbers from the single checks."""
    upto = lambda s: clean_transactions(raw, upto=s, null_notes=null_notes)
    clean = clean_transactions(raw, null_notes=null_notes)
    rows = {"D2": D.duplicate_row_count(raw), "D4": D.row_count(upto("C1")), "D12": D.zero_amount_count(upto("C1")),
            "D15": D.flag_count(upto("C12b")), "D16": D.amount_profile(upto("C13")).drop("total_rows"),
            "D17": D.reversal_profile(upto("C14")).drop("status"), "D18": D.date_coverage(clean).drop("total_rows"),
            "D6": D.null_counts(clean, {"remaining_null_names": "customer_name", "remaining_null_categories": "category",
                                        "remaining_null_status": "status"})}
    out = {f"{check}.{c}": v for check, df in rows.items() for r in df.collect() for c, v in r.asDict().items()}
    return out | {f"A6.{r.column_name}": r.violations for r in D.length_violations(raw, TRANSACTION_LENGTH_LIMITS).collect()}


@pytest.mark.parametrize("null_notes", ["sql", "as_empty"])
def test_profile_equals_the_single_checks(spark, tables, path, null_notes):
    raw = tables.raw.withColumn("location", F.when(F.col("k") % 40 == 0, F.repeat("location", 40)).otherwise(F.col("location")))
    raw = spark.createDataFrame(raw.collect(), raw.schema)
    found = write_profiled(raw, path, null_notes=null_notes)
    want = singles(raw, null_notes)
    assert {k: found[k] for k in want} == want
    assert set(found) - set(want) == {"D1.arrived_rows", "D1.most_copies"}
    assert found["D1.arrived_rows"] == raw.count() and found["A6.location"] > 0
    written = read_clean_fact(spark, path)
    assert written.count() == found["D4.total_transactions_remaining"]
    assert written.columns == [c for c in clean_transactions(raw).columns]


def test_profile_scans_once_and_watches_the_last_stage(spark, tables, path):
    rows = watched(tallied(tables.raw).hint("rebalance", F.col("transaction_date_clean")), Observation("p"))
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("CollectMetrics") == 1
    above, below = plan.split("CollectMetrics")
    assert "Exchange" not in above.replace("ResultQueryStage", "")
    assert len(re.findall(r"FileScan parquet \[l_", below)) == 1 and len(re.findall(r"FileScan parquet \[o_", below)) == 1
    assert below.count("hashpartitioning(transaction_id") == 1


def test_profile_of_no_rows(spark, tables, path):
    found = write_profiled(tables.raw.limit(0), path)
    assert found["D1.arrived_rows"] == found["D2.total_duplicate_rows"] == found["D4.total_transactions_remaining"] == 0
    assert found["D16.average_transaction"] is None and found["A6.notes"] == 0


def test_a_gate_names_what_is_out_of_bounds(spark):
    found = {"D4.total_transactions_remaining": 10, "D18.rows_still_null": 3, "D16.average_transaction": None}
    require(found, {"D4.total_transactions_remaining": (1, None), "D18.rows_still_null": (None, 3)})
    with pytest.raises(QualityError, match=r"D18.rows_still_null = 3 \(allowed: None to 2\); D16.average_transaction = None"):
        require(found, {"D4.total_transactions_remaining": (1, None), "D18.rows_still_null": (None, 2), "D16.average_transaction": (0, None)})
