"""Exact moments: the same digits whatever the partitioning."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerwash.functions.money import exact_stddev_samp, moment_sums, stddev_from
from ledgerwash.plans import views as V


def test_flags_and_baselines_do_not_depend_on_the_partitioning(spark, tables):
    fact = spark.createDataFrame(tables.fact.collect(), tables.fact.schema)
    seen = set()
    for parts in (1, 7, 211):
        rows = fact.repartition(parts, F.rand(parts))
        base = sorted(map(tuple, V.view_baseline(rows).collect()), key=str)
        flags = sorted((r.transaction_id or "", r.amount, r.sigma_score) for r in V.vw_flagged_transactions(rows, nonblank_flags_only=True).collect())
        seen.add((repr(base), repr(flags)))
    assert len(seen) == 1


def test_the_deviation_has_the_same_digits_in_any_order(spark):
    rows = [("c", Decimal("100.10"))] * 10 + [("c", Decimal("999999.99"))]
    got = {repr(spark.createDataFrame(random.Random(i).sample(rows, 11), "c string, a decimal(15,2)").repartition(i + 1)
                .groupBy("c").agg(exact_stddev_samp("a").alias("s")).first().s) for i in range(6)}
    assert len(got) == 1


def test_exact_deviation_equals_exact_arithmetic(spark):
    rng = random.Random(2)
    for low, high, n in ((0, 10 ** 7, 500), (10 ** 15 - 50, 10 ** 15, 300), (-10 ** 9, 10 ** 9, 200), (5, 6, 2)):
        cents = [rng.randrange(low, high) for _ in range(n)]
        df = spark.createDataFrame([(Decimal(c).scaleb(-2),) for c in cents], "a decimal(15,2)")
        numerator = n * sum(c * c for c in cents) - sum(cents) ** 2
        want = (numerator / (n * (n - 1))) ** 0.5 / 100
        assert df.agg(exact_stddev_samp("a").alias("s")).first().s == pytest.approx(want, rel=1e-15, abs=0)


def test_few_rows_nulls_and_overflow(spark):
    df = spark.createDataFrame([("one", Decimal("1.00")), ("none", None), ("same", Decimal("2.50")), ("same", Decimal("2.50"))], "g string, a decimal(15,2)")
    got = {r.g: r.s for r in df.groupBy("g").agg(exact_stddev_samp("a").alias("s")).collect()}
    assert got == {"one": None, "none": None, "same": 0.0}
    # n * s2 beyond 38 digits: from the exact sums in doubles.
    big = spark.sql("SELECT CAST(4000000000 AS BIGINT) AS n, CAST('0' AS DECIMAL(38,0)) AS s1, CAST('90000000000000000000000000000000000000' AS DECIMAL(38,0)) AS s2")
    assert big.select(stddev_from("n", "s1", "s2").alias("s")).first().s == pytest.approx((9e37 / 4e9) ** 0.5 / 100, rel=1e-9)


def test_sums_of_parts_give_the_whole(spark, tables):
    amounts = tables.fact.select("customer_id", "amount")
    n, s1, s2 = moment_sums("amount")
    parts = amounts.groupBy("customer_id", F.spark_partition_id().alias("p")).agg(n.alias("n"), s1.alias("s1"), s2.alias("s2"))
    merged = parts.groupBy("customer_id").agg(stddev_from(F.sum("n"), F.sum("s1"), F.sum("s2")).alias("s"))
    whole = amounts.groupBy("customer_id").agg(exact_stddev_samp("amount").alias("s"))
    assert sorted(map(repr, merged.collect())) == sorted(map(repr, whole.collect()))
