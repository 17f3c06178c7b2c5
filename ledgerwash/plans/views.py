"""Reporting views V1–V7 and dashboard feeds K1, K3.

``clean_fact`` is the cleaned fact restricted to reportable rows (a parsed
date, an amount, no zero or future flag), without the customer join. V2, V3,
V5 and V6 never read customer attributes, so they are built on
``clean_fact`` and skip the join that V1 carries; V4 aggregates per customer
first and joins the dimension to one row per customer. Results equal the
view stack as written because ``customer_id`` is the dimension's key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import avg2, exact_avg, exact_stddev_samp, ratio2, share_of_total, sum2
from ..operators import bitmaps
from ..sources.schema import CREDIT, DEBIT
from .analysis import AMT, DT, attach_customers, sigma, spend_filter

VIEW_NAMES = ("vw_clean_transactions", "vw_category_summary", "vw_monthly_summary",
              "vw_customer_summary", "vw_merchant_summary", "vw_flagged_transactions")


def clean_fact(clean: DataFrame) -> DataFrame:
    """V1 rows without the customer join, with the view's column names."""
    return (clean.filter(spend_filter(debit_only=False, exclude_future_note=True))
            .select("transaction_id", "customer_id", "customer_name",
                    F.col(DT).alias("transaction_date"), F.col(AMT).alias("amount"),
                    "currency", "transaction_type", "merchant_name", "category", "status", "location", "notes"))


def vw_clean_transactions(clean: DataFrame, customers: DataFrame) -> DataFrame:
    """V1: reportable rows with the customer's account type, credit score and
    city. A row-level join: the dimension is broadcast only under Spark's
    size threshold, otherwise sort-merge with AQE skew splitting."""
    fact = clean_fact(clean)
    dim = customers.select("customer_id", "account_type", "credit_score", F.col("city").alias("customer_city"))
    return fact.join(dim, "customer_id", "left").select(*fact.columns, "account_type", "credit_score", "customer_city")


def vw_category_summary(fact: DataFrame) -> DataFrame:
    """V2 (on ``clean_fact``)."""
    g = (fact.filter(F.col("transaction_type") == DEBIT).groupBy("category")
         .agg(F.count(F.lit(1)).alias("transaction_count"), sum2("amount").alias("total_spent_ngn"),
              avg2("amount").alias("avg_transaction_ngn"), F.sum("amount").alias("_sum")))
    return g.withColumn("pct_of_total", share_of_total("_sum")).drop("_sum")


def _when_type(kind: str, otherwise_zero: bool = True):
    amount = F.col("amount")
    expr = F.when(F.col("transaction_type") == kind, amount)
    return expr.otherwise(F.lit(0)) if otherwise_zero else expr


def vw_monthly_summary(fact: DataFrame) -> DataFrame:
    """V3 (on ``clean_fact``). ``month_start`` is the first instant of the
    month, a timestamp."""
    return (fact.groupBy(F.date_trunc("month", "transaction_date").alias("month_start"))
            .agg(F.count(F.lit(1)).alias("transaction_count"),
                 F.round(F.sum(_when_type(DEBIT)), 2).alias("total_debit_ngn"),
                 F.round(F.sum(_when_type(CREDIT)), 2).alias("total_credit_ngn"),
                 avg2("amount").alias("avg_transaction_ngn"),
                 F.count_distinct("customer_id").alias("active_customers"))
            .select(F.date_format("month_start", "yyyy-MM").alias("year_month"), "month_start",
                    "transaction_count", "total_debit_ngn", "total_credit_ngn", "avg_transaction_ngn",
                    "active_customers"))


def monthly_customer_sets(fact: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The active customers of each month as bitmaps to be stored (``operators.bitmaps``)."""
    months = fact.select(F.date_format("transaction_date", "yyyy-MM").alias("year_month"), "customer_id")
    return bitmaps.bitmaps(months, ["year_month"], "customer_id", dictionary)


def active_customers_between(sets: DataFrame, first: str, last: str) -> DataFrame:
    """V3's distinct count over a range of months, from stored sets alone."""
    return bitmaps.distinct_counts(sets.where(F.col("year_month").between(first, last)), [], "active_customers")


def vw_customer_summary(fact: DataFrame, customers: DataFrame) -> DataFrame:
    """V4 (on ``clean_fact``): aggregate per customer, then attach the
    dimension's attributes (one row per customer crosses the join).

    In two levels: the two distinct counts of a single aggregate would triple
    every fact row before the shuffle; over one row per (customer, category,
    merchant) they triple those rows only."""
    debit = _when_type(DEBIT, otherwise_zero=False)
    fine = (fact.groupBy("customer_id", "category", "merchant_name")
            .agg(F.count(F.lit(1)).alias("_n"), F.sum(_when_type(DEBIT)).alias("_debit"),
                 F.sum(_when_type(CREDIT)).alias("_credit"), F.sum(debit).alias("_debit_sum"),
                 F.count(debit).alias("_debit_n"), F.min("transaction_date").alias("_first"),
                 F.max("transaction_date").alias("_last")))
    g = (fine.groupBy("customer_id")
         .agg(F.sum("_n").alias("total_transactions"), F.round(F.sum("_debit"), 2).alias("total_debit_ngn"),
              F.round(F.sum("_credit"), 2).alias("total_credit_ngn"),
              ratio2(F.sum("_debit_sum"), F.sum("_debit_n")).alias("avg_debit_ngn"),
              F.min("_first").alias("first_transaction"), F.max("_last").alias("last_transaction"),
              F.count_distinct("category").alias("categories_used"),
              F.count_distinct("merchant_name").alias("merchants_used")))
    out = attach_customers(g, customers, ["full_name", "city", "account_type", "credit_score", "join_date"])
    return out.select("customer_id", "full_name", "city", "account_type", "credit_score", "join_date",
                      "total_transactions", "total_debit_ngn", "total_credit_ngn", "avg_debit_ngn",
                      "first_transaction", "last_transaction", "categories_used", "merchants_used")


def vw_merchant_summary(fact: DataFrame) -> DataFrame:
    """V5 (on ``clean_fact``)."""
    return (fact.filter(F.col("transaction_type") == DEBIT).groupBy("merchant_name", "category")
            .agg(F.count(F.lit(1)).alias("transaction_count"), sum2("amount").alias("total_spent_ngn"),
                 avg2("amount").alias("avg_transaction_ngn"),
                 F.count_distinct("customer_id").alias("unique_customers"),
                 F.min("transaction_date").alias("first_seen"), F.max("transaction_date").alias("last_seen")))


def view_baseline(fact: DataFrame, min_history: int = 10) -> DataFrame:
    """V6 sub-query: unrounded debit average and sample stddev per customer
    with at least ``min_history`` debit rows."""
    return (fact.filter(F.col("transaction_type") == DEBIT).groupBy("customer_id")
            .agg(exact_avg("amount").alias("avg_spend"), exact_stddev_samp("amount").alias("stddev_spend"),
                 F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") >= min_history).drop("_n"))


def with_sigma(fact: DataFrame, min_history: int = 10) -> DataFrame:
    """Fact rows with their unrounded sigma against the customer baseline
    (NULL without a baseline). The baseline is one row per customer: it is
    broadcast under the size threshold, else sort-merge joined."""
    base = view_baseline(fact, min_history)
    return (fact.join(base, "customer_id", "left")
            .withColumn("_sigma", sigma(F.col("amount"), F.col("avg_spend"), F.col("stddev_spend"))))


def flagged_condition(k: float = 3.0, nonblank_flags_only: bool = False):
    notes = F.col("notes")
    noted = notes.isNotNull()
    if nonblank_flags_only:
        noted = noted & (F.trim(notes) != "")
    return noted | ((F.col("transaction_type") == DEBIT) & (F.col("_sigma") > F.lit(k)))


def vw_flagged_transactions(fact: DataFrame, k: float = 3.0, min_history: int = 10,
                            nonblank_flags_only: bool = False) -> DataFrame:
    """V6 (on ``clean_fact``): rows with any note, or debit rows more than
    ``k`` sigma above the customer's average. As written, an empty note
    counts as a note; ``nonblank_flags_only=True`` keeps real notes only."""
    return (with_sigma(fact, min_history).filter(flagged_condition(k, nonblank_flags_only))
            .select("transaction_id", "customer_id", "customer_name", "transaction_date", "amount",
                    "merchant_name", "category", "status", F.col("notes").alias("flag_reason"),
                    F.round("_sigma", 2).alias("sigma_score")))


# -- V7 smoke reads ------------------------------------------------------------------

def view_row_count(view: DataFrame, name: str) -> DataFrame:
    return view.agg(F.count(F.lit(1)).alias(name))


def top_categories(category_summary: DataFrame, n: int = 5) -> DataFrame:
    return category_summary.orderBy(F.col("total_spent_ngn").desc_nulls_first(),
                                    F.col("category").asc_nulls_last()).limit(n)


def latest_months(monthly_summary: DataFrame, n: int = 3) -> DataFrame:
    return monthly_summary.orderBy(F.col("month_start").desc_nulls_first()).limit(n)


# -- dashboard feeds -----------------------------------------------------------------

def kpi_summary(fact: DataFrame, k: float = 3.0, min_history: int = 10) -> DataFrame:
    """K1: the KPI tile row in one pass over the reportable rows: rows,
    debit spend, average transaction value and the V6 flagged count."""
    rows = with_sigma(fact, min_history)
    return rows.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.round(F.sum(F.when(F.col("transaction_type") == DEBIT, F.col("amount"))), 2).alias("total_spend_ngn"),
        avg2("amount").alias("avg_transaction_ngn"),
        F.count_if(flagged_condition(k)).alias("flagged_transactions"),
    )


def monthly_debit_line(monthly_summary: DataFrame) -> DataFrame:
    """K2 feed: the monthly debit line (from V3), oldest month first."""
    return monthly_summary.select("year_month", "month_start", "total_debit_ngn").orderBy("month_start")


def merchant_volume(merchant_summary: DataFrame) -> DataFrame:
    """K2 feed: merchant dominance by debit volume (V5 rolled up over
    categories; one row per merchant)."""
    return (merchant_summary.groupBy("merchant_name")
            .agg(F.sum("transaction_count").alias("transaction_count"),
                 F.sum("total_spent_ngn").alias("total_spent_ngn"))
            .orderBy(F.col("transaction_count").desc_nulls_first(), F.col("merchant_name").asc_nulls_last()))


def completion_rate(clean: DataFrame) -> DataFrame:
    """K3: share of completed rows and its complement (rows counted as in
    the status breakdown: parsed date, an amount, no zero flag)."""
    rows = clean.filter(spend_filter(debit_only=False))
    total = F.count(F.lit(1))
    completed = F.count_if(F.col("status") == "completed")
    rate = F.round(completed * F.lit(100.0).cast("decimal(4,1)") / F.nullif(total, F.lit(0)), 2)
    return rows.agg(total.alias("total_transactions"), completed.alias("completed_transactions"),
                    rate.alias("completion_rate_pct"),
                    (F.lit(100).cast("decimal(5,2)") - rate).alias("problem_rate_pct"))
