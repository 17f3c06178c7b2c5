"""Prefix sums over range partitions: exact for any cuts, even under a hot key and day."""

import random
from collections import Counter
from datetime import date, timedelta
from decimal import Decimal
from statistics import median

from pyspark.sql import functions as F

from ledgerwash.operators import prefix
from ledgerwash.plans import analysis as Q

SCHEMA = "customer_id string, transaction_id string, transaction_date_clean date, merchant_name string, amount_clean decimal(15,2)"


def rows_of(n, seed=1):
    """A third of the rows are of one customer and day."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        hot = i % 3 == 0
        out.append(("HOT" if hot else rng.choice([None, *"abcdefgh"]), f"T{i:06}", date(2024, 1, 1) + timedelta(0 if hot else rng.randrange(90)),
                    "m", rng.choice([None, Decimal(rng.randrange(-10 ** 6, 10 ** 6)).scaleb(-2)])))
    rng.shuffle(out)
    return out


def brute(rows):
    out = Counter()
    for key in {r[0] for r in rows}:
        total, seen = Decimal(0), False
        for n, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])), 1):
            seen |= r[4] is not None
            total += r[4] or 0
            out[r[1], n, total if seen else None] += 1
    return out


def test_running_totals_equal_a_sequential_sum_for_any_number_of_blocks(spark):
    rows = rows_of(900)
    want = brute(rows)
    for partitions in (1, 4, 23):
        got = Q.running_totals_all(spark.createDataFrame(rows, SCHEMA).repartition(5), partitions).collect()
        assert Counter((r.transaction_id, r.transaction_number, r.running_total_ngn) for r in got) == want


def test_a_hot_customer_and_day_is_cut_into_even_blocks(spark):
    df = spark.createDataFrame(rows_of(24_000), SCHEMA).repartition(6)
    order = [F.col("transaction_date_clean").asc_nulls_last(), F.col("transaction_id").asc_nulls_last()]
    cut = prefix.blocks(df, "customer_id", order, 24)
    sizes = [r["count"] for r in cut.groupBy(prefix.BLOCK).count().collect()]
    assert len(sizes) >= 20 and max(sizes) <= 2 * median(sizes)
    assert cut.where("customer_id = 'HOT'").select(prefix.BLOCK).distinct().count() >= 7
    # The second pass deals whole blocks, and the window needs no shuffle of its own.
    out = Q.running_totals_all(df, 24)
    tasks = [r["count"] for r in out.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    assert len(tasks) >= 12 and max(tasks) <= 3 * median(tasks)
    plan = out._jdf.queryExecution().executedPlan().toString()
    rows_only = plan[:plan.index("BroadcastExchange")] if "BroadcastExchange" in plan else plan
    assert "rangepartitioning(_block" in rows_only and "hashpartitioning(_block" not in rows_only


def test_no_rows(spark):
    assert Q.running_totals_all(spark.createDataFrame([], SCHEMA)).collect() == []
