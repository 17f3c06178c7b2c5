"""Analysis queries Q1–Q8 on the cleaned fact.

Plan shapes chosen for scale:

* Grouped reports aggregate with partial (map-side) aggregation, so a key
  holding a large share of the rows costs one row per map task in the
  shuffle.
* Customer attributes are attached *after* aggregation (``customer_id`` is the
  dimension's key, so one row per customer is enough; for top-k reports only
  the k result rows cross the join). The join has no hint: Spark broadcasts
  the dimension only under its size threshold and otherwise plans a
  sort-merge join.
* Shares of a total (``SUM(x) OVER ()``) run over the grouped rows only.
* Top-k uses ``orderBy().limit()`` (TakeOrderedAndProject: every task keeps
  k rows), with a full tie-break so the k rows are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flags
from ..functions.dates import text_period
from ..functions.money import avg2, exact_avg, exact_stddev_samp, ratio2, share_of_total, sum2
from ..operators import prefix
from ..sources.schema import DEBIT

AMT = "amount_clean"
DT = "transaction_date_clean"


# -- shared predicates -------------------------------------------------------

def is_debit() -> Column:
    return F.col("transaction_type") == DEBIT


def has_amount() -> Column:
    return F.col(AMT).isNotNull()


def has_date() -> Column:
    return F.col(DT).isNotNull()


def spend_filter(require_date: bool = True, exclude_future_note: bool = False,
                 debit_only: bool = True, exclude_zero_note: bool = True) -> Column:
    """The recurring row filter of the analysis queries."""
    cond = has_amount()
    if debit_only:
        cond = cond & is_debit()
    if require_date:
        cond = cond & has_date()
    if exclude_zero_note:
        cond = cond & flags.not_zero_flagged()
    if exclude_future_note:
        cond = cond & flags.not_future_flagged()
    return cond


def attach_customers(small: DataFrame, customers: DataFrame, columns) -> DataFrame:
    """Left-join customer attributes to ``small`` (keyed by customer_id;
    one row per customer, or a top-k result).

    The input is referenced once, so the plan behind it runs once. Spark
    broadcasts the dimension when it is under the size threshold; otherwise a
    sort-merge join shuffles the dimension once (``small`` is already
    aggregated, so its side is cheap), which at scale is a small cost next to
    the fact.
    """
    return small.join(customers.select("customer_id", *columns), "customer_id", "left")


def _top(df: DataFrame, n: int | None, *order: Column) -> DataFrame:
    out = df.orderBy(*order)
    return out.limit(n) if n is not None else out


# -- Q1 / Q2 -------------------------------------------------------------------

def spend_by_category(clean: DataFrame) -> DataFrame:
    """Q1: debit spend per category with its share of the total (the date
    does not have to parse, only the future flag excludes)."""
    g = (clean.filter(spend_filter(require_date=False, exclude_future_note=True))
         .groupBy("category")
         .agg(F.count(F.lit(1)).alias("transaction_count"), sum2(AMT).alias("total_spent_ngn"),
              avg2(AMT).alias("avg_transaction_ngn"), F.sum(AMT).alias("_sum")))
    return (g.withColumn("percentage_of_total", share_of_total("_sum")).drop("_sum")
            .orderBy(F.col("total_spent_ngn").desc_nulls_first(), F.col("category").asc_nulls_last()))


def spend_by_text_period(clean: DataFrame) -> DataFrame:
    """A rough monthly/yearly split read from the raw date text."""
    return (clean.filter(spend_filter(require_date=False, exclude_future_note=True))
            .groupBy(text_period("transaction_date").alias("year_month"))
            .agg(F.count(F.lit(1)).alias("transaction_count"), sum2(AMT).alias("total_spent_ngn"),
                 avg2(AMT).alias("avg_transaction_ngn"))
            .orderBy(F.col("year_month").asc_nulls_last()))


def monthly_spend(clean: DataFrame) -> DataFrame:
    """Debit spend per calendar month of the clean date."""
    return (clean.filter(spend_filter())
            .groupBy(F.trunc(DT, "month").alias("_month"))
            .agg(F.count(F.lit(1)).alias("transaction_count"), sum2(AMT).alias("total_spent_ngn"),
                 avg2(AMT).alias("avg_transaction_ngn"))
            .orderBy("_month")
            .select(F.date_format("_month", "yyyy-MM").alias("year_month"), "transaction_count",
                    "total_spent_ngn", "avg_transaction_ngn"))


# -- Q3 / Q4 / Q5 / Q6 ---------------------------------------------------------

def top_customers(clean: DataFrame, customers: DataFrame, n: int = 10) -> DataFrame:
    """Q3: the ``n`` biggest debit spenders with their profile."""
    per_customer = (clean.filter(spend_filter()).groupBy("customer_id")
                    .agg(F.count(F.lit(1)).alias("transaction_count"), sum2(AMT).alias("total_spent_ngn"),
                         avg2(AMT).alias("avg_transaction_ngn"), F.min(DT).alias("first_transaction"),
                         F.max(DT).alias("last_transaction")))
    top = _top(per_customer, n, F.col("total_spent_ngn").desc_nulls_first(), F.col("customer_id").asc_nulls_last())
    out = attach_customers(top, customers, ["full_name", "city", "account_type", "credit_score"])
    return (out.orderBy(F.col("total_spent_ngn").desc_nulls_first(), F.col("customer_id").asc_nulls_last())
            .select("customer_id", "full_name", "city", "account_type", "credit_score", "transaction_count",
                    "total_spent_ngn", "avg_transaction_ngn", "first_transaction", "last_transaction"))


def status_breakdown(clean: DataFrame) -> DataFrame:
    """Q4: rows, share of rows, value and average per status (all types)."""
    g = (clean.filter(spend_filter(debit_only=False)).groupBy("status")
         .agg(F.count(F.lit(1)).alias("transaction_count"), sum2(AMT).alias("total_value_ngn"),
              avg2(AMT).alias("avg_value_ngn")))
    return (g.withColumn("percentage", share_of_total("transaction_count"))
            .select("status", "transaction_count", "percentage", "total_value_ngn", "avg_value_ngn")
            .orderBy(F.col("transaction_count").desc_nulls_first(), F.col("status").asc_nulls_last()))


def top_merchants(clean: DataFrame, n: int | None = 15) -> DataFrame:
    """Q5: merchant x category by debit spend, with distinct customers."""
    g = (clean.filter(spend_filter()).groupBy("merchant_name", "category")
         .agg(F.count(F.lit(1)).alias("transaction_count"), sum2(AMT).alias("total_spent_ngn"),
              avg2(AMT).alias("avg_transaction_ngn"), F.count_distinct("customer_id").alias("unique_customers")))
    return _top(g, n, F.col("total_spent_ngn").desc_nulls_first(), F.col("merchant_name").asc_nulls_last(),
                F.col("category").asc_nulls_last())


def spend_by_account_type(clean: DataFrame, customers: DataFrame) -> DataFrame:
    """Q6: debit spend per account type.

    Aggregated per customer first (one row per customer crosses the join),
    then rolled up per account type: distinct customers = customer rows with
    a non-NULL id. Groups on the raw account type, shows NULL as 'Unknown'.
    """
    per_customer = (clean.filter(spend_filter()).groupBy("customer_id")
                    .agg(F.count(F.lit(1)).alias("_n"), F.sum(AMT).alias("_s")))
    joined = per_customer.join(customers.select("customer_id", "account_type"), "customer_id", "left")
    g = (joined.groupBy("account_type")
         .agg(F.count("customer_id").alias("customer_count"), F.sum("_n").alias("transaction_count"),
              F.sum("_s").alias("_sum")))
    return (g.select(F.coalesce(F.col("account_type"), F.lit("Unknown")).alias("account_type"),
                     "customer_count", "transaction_count",
                     F.round("_sum", 2).alias("total_spent_ngn"),
                     ratio2("_sum", "transaction_count").alias("avg_transaction_ngn"),
                     ratio2("_sum", "customer_count").alias("avg_spend_per_customer"))
            .orderBy(F.col("total_spent_ngn").desc_nulls_first(), F.col("account_type").asc_nulls_last()))


# -- Q7 ---------------------------------------------------------------------------

def top_spender_ids(clean: DataFrame, top: int = 5) -> DataFrame:
    """Q7 CTE: the ``top`` customers by debit spend (rows with an amount and
    a date; the zero flag is not excluded here, zero rows add nothing)."""
    cond = is_debit() & has_amount() & has_date()
    return (clean.filter(cond).groupBy("customer_id").agg(F.sum(AMT).alias("_s"))
            .orderBy(F.col("_s").desc_nulls_first(), F.col("customer_id").asc_nulls_last())
            .limit(top).select("customer_id"))


def running_totals(clean: DataFrame, customers: DataFrame, top: int = 5, n: int | None = 50) -> DataFrame:
    """Q7: running debit total and sequence number per top spender, first
    ``n`` rows by (customer, date).

    The running total of a row only needs the rows before it in
    (customer, date, id) order, and those come before it in the output
    order too; so with a row limit the ``n`` first rows are taken with a
    distributed top-k first and the window runs on those ``n`` rows. Without
    a limit see ``running_totals_all``.
    """
    ids = top_spender_ids(clean, top)
    rows = (clean.filter(spend_filter()).join(ids, "customer_id", "left_semi")
            .select("customer_id", "transaction_id", DT, "merchant_name", AMT))
    order = [F.col("customer_id").asc_nulls_last(), F.col(DT).asc_nulls_last(), F.col("transaction_id").asc_nulls_last()]
    if n is None:
        out = running_totals_all(rows)
    else:
        rows = rows.orderBy(*order).limit(n)
        w = Window.partitionBy("customer_id").orderBy(F.col(DT).asc_nulls_last(), F.col("transaction_id").asc_nulls_last())
        out = rows.select("*", F.round(F.sum(AMT).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), 2)
                          .alias("running_total_ngn"),
                          F.row_number().over(w).cast("bigint").alias("transaction_number"))
    out = attach_customers(out, customers, ["full_name"])
    return (out.orderBy(*order)
            .select("customer_id", "full_name", DT, "merchant_name", AMT, "running_total_ngn", "transaction_number"))


def running_totals_all(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Running total and sequence number over every row, in (customer, date, id) order,
    without sending a customer's whole history, or one day of it, to one task: a
    two-pass prefix sum over range partitions (``operators.prefix``). Rows of no
    customer are one group."""
    order = [F.col(DT).asc_nulls_last(), F.col("transaction_id").asc_nulls_last()]
    columns = ["customer_id", "transaction_id", DT, "merchant_name", AMT]
    out = prefix.running_totals(rows.select(*columns), "customer_id", order, AMT, "running_total_ngn", "transaction_number", partitions)
    return out.withColumn("running_total_ngn", F.round("running_total_ngn", 2))


# -- Q8 ---------------------------------------------------------------------------

def customer_baseline(clean: DataFrame, min_history: int = 10, rounded: bool = True) -> DataFrame:
    """Per-customer debit average and sample standard deviation, for
    customers with at least ``min_history`` rows. One row per customer;
    partial aggregation map-side."""
    g = (clean.filter(spend_filter()).groupBy("customer_id")
         .agg(exact_avg(AMT).alias("avg_spend"), exact_stddev_samp(AMT).alias("stddev_spend"),
              F.count(F.lit(1)).alias("total_transactions"))
         .filter(F.col("total_transactions") >= min_history))
    if rounded:
        g = g.withColumns({"avg_spend": F.round("avg_spend", 2), "stddev_spend": F.round("stddev_spend", 2)})
    return g


def sigma(amount: Column, avg: Column, sd: Column) -> Column:
    """(amount - avg) / NULLIF(sd, 0)."""
    return (amount - avg) / F.nullif(sd, F.lit(0))


def sigma_outliers(clean: DataFrame, customers: DataFrame, k: float = 3.0, min_history: int = 10,
                   n: int | None = 20, round_baseline: bool = True) -> DataFrame:
    """Q8: debit rows more than ``k`` sample standard deviations above the
    customer's own average, highest score first.

    The baseline has one row per customer: under the broadcast threshold it
    is broadcast and the fact is never shuffled; above it, a sort-merge join
    with AQE skew splitting. Customer attributes are attached to the ``n``
    result rows only.
    """
    base = customer_baseline(clean, min_history, round_baseline)
    rows = clean.filter(spend_filter()).join(base, "customer_id", "inner")
    score = sigma(F.col(AMT), F.col("avg_spend"), F.col("stddev_spend"))
    flagged = (rows.filter(score > F.lit(k))
               .select("transaction_id", "customer_id", DT, "merchant_name", "category", AMT,
                       "avg_spend", "stddev_spend", F.round(score, 2).alias("sigma_score"), "status"))
    order = [F.col("sigma_score").desc_nulls_first(), F.col("transaction_id").asc_nulls_last()]
    top = _top(flagged, n, *order)
    out = attach_customers(top, customers, ["full_name", "city"])
    return (out.orderBy(*order)
            .select("transaction_id", "customer_id", "full_name", "city", DT, "merchant_name", "category",
                    AMT, "avg_spend", "stddev_spend", "sigma_score", "status"))
