"""Stored bitmaps against COUNT(DISTINCT ...)."""

import random

from pyspark.sql import functions as F

from ledgerwash.operators import bitmaps as B


def test_unions_of_stored_sets_equal_count_distinct(spark):
    rng = random.Random(6)
    rows = [(f"2024-{1 + rng.randrange(12):02}", rng.choice("abc"), rng.choice([None, *(f"C{i}" for i in range(300))])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "month string, kind string, customer string").repartition(5)
    numbers = B.extended(df.select("customer"))
    assert sorted(r.number for r in numbers.collect()) == list(range(1, 301))
    sets = B.bitmaps(df, ["month", "kind"], "customer", numbers)
    for groups in (["month"], ["kind"], ["month", "kind"], []):
        want = df.groupBy(*groups).agg(F.count_distinct("customer").alias("n"))
        assert sorted(map(tuple, B.distinct_counts(sets, groups, "n").collect())) == sorted(map(tuple, want.collect()))
    some = "month BETWEEN '2024-03' AND '2024-05'"
    assert B.distinct_counts(sets.where(some), [], "n").first().n == df.where(some).select("customer").na.drop().distinct().count()
    assert B.distinct_counts(sets.where("month > '2030'"), [], "n").first().n == 0


def test_a_dictionary_grows_and_keeps_its_numbers(spark):
    ids = lambda a, b: spark.range(a, b).select(F.format_string("C%06d", "id").alias("c"))
    first = B.extended(ids(0, 40_000).repartition(4))
    then = B.extended(ids(39_000, 70_000).unionByName(ids(10, 20)), first)
    old, new = ({r.value: r.number for r in d.collect()} for d in (first, then))
    assert all(new[v] == n for v, n in old.items()) and sorted(new.values()) == list(range(1, 70_001))
    # Bitmaps of the old and of the new dictionary merge; numbers span several pages.
    both = B.bitmaps(ids(0, 40_000).withColumn("g", F.lit(1)), ["g"], "c", first).unionByName(
        B.bitmaps(ids(30_000, 70_000).withColumn("g", F.lit(2)), ["g"], "c", then))
    assert both.select("page").distinct().count() == 3
    assert B.distinct_counts(both, [], "n").first().n == 70_000
    assert {r.g: r.n for r in B.distinct_counts(both, ["g"], "n").collect()} == {1: 40_000, 2: 40_000}


def test_no_values(spark):
    none = spark.createDataFrame([(None, 1)], "c string, g int")
    numbers = B.extended(none.select("c"))
    assert numbers.collect() == [] and B.bitmaps(none, ["g"], "c", numbers).collect() == []


def test_active_customers_of_any_month_range_from_stored_sets(spark, tables):
    from ledgerwash.plans import views as V
    fact = spark.createDataFrame(tables.fact.collect(), tables.fact.schema)
    sets = V.monthly_customer_sets(fact, B.extended(fact.select("customer_id")))
    want = {r.year_month: r.active_customers for r in V.vw_monthly_summary(fact).collect()}
    assert {r.year_month: r.active_customers for r in B.distinct_counts(sets, ["year_month"], "active_customers").collect()} == want
    for low, high in (("2022-02", "2022-04"), ("2022-01", "2024-12"), ("1990-01", "1990-02")):
        rows = fact.where(F.date_format("transaction_date", "yyyy-MM").between(low, high))
        assert V.active_customers_between(sets, low, high).first().active_customers == rows.agg(F.count_distinct("customer_id")).first()[0]
