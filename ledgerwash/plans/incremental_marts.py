"""Marts kept up by deltas (V2-V6, K1).

The marts are functions of small aggregates that merge: counts, exact sums, minima
and maxima add up over batches of cleaned rows, and exact moments (``money``) make
standard deviations do so too. Distinct counts merge because the counted column is in
the key of the state, one row a distinct value:

* ``by_customer``: (customer, category, merchant), for V2, V4, V5 and the baselines of
  V6 and K1;
* ``by_month``: (month, customer), for V3;
* ``flags``: flagged rows of each customer, for K1. A batch changes the baselines of
  the customers that it holds, so their rows alone are judged again;
* ``fact``: the reportable rows themselves, for V1 and V6, which are lists of rows.

Each batch appends a segment of deltas to each table and commits all of them at one
instant (``sources.publish``), with the batch's number: a batch that is replayed after
a failure is skipped, one that failed midway left nothing. Readers merge segments by
one aggregation over state rows; ``compact`` rewrites them as one from time to time.
A batch costs its own rows, the state of the customers in it and their rows: never a
pass over all facts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import cents, ratio2, share_of_total, stddev_from
from ..sources.publish import Publication, Version
from ..sources.schema import CREDIT, DEBIT
from ..sources.scratch import shuffles_released
from . import views as V
from .analysis import attach_customers

CUSTOMER_KEY = ("customer_id", "category", "merchant_name")
MONTH_KEY = ("month_start", "customer_id")
SUM, SQUARES = "decimal(25,2)", "decimal(38,0)"
#: How the columns of a state merge.
CUSTOMER_STATE = {"n": ("sum", "bigint"), "debit": ("sum", SUM), "credit": ("sum", SUM), "debit_n": ("sum", "bigint"),
                  "debit_squares": ("sum", SQUARES), "first": ("min", "date"), "last": ("max", "date"),
                  "debit_first": ("min", "date"), "debit_last": ("max", "date")}
MONTH_STATE = {"n": ("sum", "bigint"), "amount": ("sum", SUM), "debit": ("sum", SUM), "credit": ("sum", SUM)}
TABLES = ("fact", "by_customer", "by_month", "flags")
#: The folder column of the tables that are looked up by customer.
BUCKET = "customer_bucket"
BUCKETED = {"fact": BUCKET, "by_customer": BUCKET}


def _merged(rows: DataFrame, key: tuple[str, ...], state: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows of a state with equal keys as one. Sums of no rows stay 0."""
    return rows.groupBy(*key).agg(*(getattr(F, how)(c).cast(kind).alias(c) for c, (how, kind) in state.items()))


def _of(kind: str, value: Column) -> Column:
    return F.when(F.col("transaction_type") == kind, value)


def customer_delta(fact: DataFrame) -> DataFrame:
    amount, day, zero = F.col("amount"), F.col("transaction_date"), F.lit(0)
    return _merged(fact.select(
        *CUSTOMER_KEY, F.lit(1).alias("n"), F.coalesce(_of(DEBIT, amount), zero).alias("debit"),
        F.coalesce(_of(CREDIT, amount), zero).alias("credit"), F.coalesce(_of(DEBIT, F.lit(1)), zero).alias("debit_n"),
        F.coalesce(_of(DEBIT, (cents(amount) * cents(amount)).cast("decimal(34,0)")), zero).alias("debit_squares"),
        day.alias("first"), day.alias("last"), _of(DEBIT, day).alias("debit_first"), _of(DEBIT, day).alias("debit_last")),
        CUSTOMER_KEY, CUSTOMER_STATE)


def month_delta(fact: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return _merged(fact.select(
        F.date_trunc("month", "transaction_date").alias("month_start"), "customer_id", F.lit(1).alias("n"), "amount",
        F.coalesce(_of(DEBIT, F.col("amount")), zero).alias("debit"),
        F.coalesce(_of(CREDIT, F.col("amount")), zero).alias("credit")), MONTH_KEY, MONTH_STATE)


# -- the marts, from states ------------------------------------------------------------

def category_summary(state: DataFrame) -> DataFrame:
    """V2. Sums need no merged state: rows of equal keys add up here."""
    g = state.where("debit_n > 0").groupBy("category").agg(
        F.sum("debit_n").alias("transaction_count"), F.sum("debit").cast(SUM).alias("_sum"))
    return g.select("category", "transaction_count", F.round("_sum", 2).alias("total_spent_ngn"),
                    ratio2("_sum", "transaction_count").alias("avg_transaction_ngn"), share_of_total("_sum").alias("pct_of_total"))


def monthly_summary(state: DataFrame) -> DataFrame:
    """V3: a month's customers are its state rows."""
    g = state.groupBy("month_start").agg(
        F.sum("n").alias("transaction_count"), F.sum("amount").cast(SUM).alias("_sum"), F.sum("debit").cast(SUM).alias("_debit"),
        F.sum("credit").cast(SUM).alias("_credit"), F.count("customer_id").alias("active_customers"))
    return g.select(F.date_format("month_start", "yyyy-MM").alias("year_month"), "month_start", "transaction_count",
                    F.round("_debit", 2).alias("total_debit_ngn"), F.round("_credit", 2).alias("total_credit_ngn"),
                    ratio2("_sum", "transaction_count").alias("avg_transaction_ngn"), "active_customers")


def customer_summary(state: DataFrame, customers: DataFrame) -> DataFrame:
    """V4."""
    g = state.groupBy("customer_id").agg(
        F.sum("n").alias("total_transactions"), F.sum("debit").cast(SUM).alias("_debit"), F.sum("credit").cast(SUM).alias("_credit"),
        F.sum("debit_n").alias("_debit_n"), F.min("first").alias("first_transaction"), F.max("last").alias("last_transaction"),
        F.count_distinct("category").alias("categories_used"), F.count_distinct("merchant_name").alias("merchants_used"))
    g = g.withColumns({"total_debit_ngn": F.round("_debit", 2), "total_credit_ngn": F.round("_credit", 2),
                       "avg_debit_ngn": ratio2("_debit", "_debit_n")})
    attributes = ["full_name", "city", "account_type", "credit_score", "join_date"]
    return attach_customers(g, customers, attributes).select(
        "customer_id", *attributes, "total_transactions", "total_debit_ngn", "total_credit_ngn", "avg_debit_ngn",
        "first_transaction", "last_transaction", "categories_used", "merchants_used")


def merchant_summary(state: DataFrame) -> DataFrame:
    """V5: a (merchant, category)'s customers are its state rows."""
    g = state.where("debit_n > 0").groupBy("merchant_name", "category").agg(
        F.sum("debit_n").alias("transaction_count"), F.sum("debit").cast(SUM).alias("_sum"),
        F.count("customer_id").alias("unique_customers"), F.min("debit_first").alias("first_seen"), F.max("debit_last").alias("last_seen"))
    return g.select("merchant_name", "category", "transaction_count", F.round("_sum", 2).alias("total_spent_ngn"),
                    ratio2("_sum", "transaction_count").alias("avg_transaction_ngn"), "unique_customers", "first_seen", "last_seen")


def baseline(state: DataFrame, min_history: int = 10) -> DataFrame:
    """V6's sub-query, as ``views.view_baseline`` has it from rows; of a state merged or not."""
    g = state.where("debit_n > 0").groupBy("customer_id").agg(
        F.sum("debit_n").alias("_n"), F.sum("debit").cast(SUM).alias("_sum"), F.sum("debit_squares").cast(SQUARES).alias("_squares"))
    return g.where(F.col("_n") >= min_history).select(
        "customer_id", (F.col("_sum") / F.col("_n")).alias("avg_spend"),
        stddev_from("_n", (F.col("_sum") * 100).cast("decimal(27,0)"), "_squares").alias("stddev_spend"))


class IncrementalMarts:
    """The marts of a publication, brought up to date batch by batch. ``buckets`` is fixed
    when the marts are begun (their notes hold it): about the number of customers over
    those of a usual batch, or more."""

    def __init__(self, publication: Publication, k: float = 3.0, min_history: int = 10, buckets: int = 64):
        self.publication, self.k, self.min_history = publication, k, min_history
        self.buckets = publication.version().notes.get("buckets", buckets)

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Rows with their bucket, a null customer's too. A bucket that a customer makes
        large is split over tasks."""
        bucket = F.pmod(F.xxhash64("customer_id"), F.lit(self.buckets)).cast("int")
        return rows.withColumn(BUCKET, bucket).hint("rebalance", F.col(BUCKET)).sortWithinPartitions(BUCKET, "customer_id")

    def _parts(self, name: str, version: Version, more: DataFrame | None = None, buckets: list[int] | None = None) -> list[DataFrame]:
        """A table's published rows and ``more``; with ``buckets``, those folders only."""
        parts = [self.publication.read(name, version.number)] if name in version.tables else []
        parts += [more] if more is not None else []
        return parts if buckets is None else [part.where(F.col(BUCKET).isin(buckets)) for part in parts]

    def _deltas(self, name: str, version: Version, more: DataFrame | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table's rows of all batches, unmerged: what only adds up is taken from them
        without the shuffle that merging costs."""
        return reduce(DataFrame.unionByName, self._parts(name, version, more, buckets))

    def _state(self, name: str, version: Version) -> DataFrame:
        key, state = {"by_customer": (CUSTOMER_KEY, CUSTOMER_STATE), "by_month": (MONTH_KEY, MONTH_STATE)}[name]
        return _merged(self._deltas(name, version), key, state)

    def apply(self, cleaned: DataFrame, run: str = "", batch: int = 0) -> Version:
        """Merge one batch of cleaned rows, whose ids no other batch has, and publish.
        Batches of a run are numbered upwards; one that is in already changes nothing."""
        publication = self.publication
        version = publication.version()
        done = version.notes.get("batches", {})
        if done.get(run, -1) >= batch:
            return version
        new = publication.write({"fact": self._placed(V.clean_fact(cleaned))}, by=BUCKETED)
        fresh = publication.spark.read.parquet(f"{publication.root}/{new['fact'][0]}")
        new |= publication.write({"by_customer": self._placed(customer_delta(fresh)), "by_month": month_delta(fresh)}, by=BUCKETED)
        delta = publication.spark.read.parquet(f"{publication.root}/{new['by_customer'][0]}")
        touched = delta.select(F.col("customer_id").alias("_touched")).distinct()
        with shuffles_released(publication.spark):  # as many numbers as there are buckets, at most
            buckets = sorted(r[0] for r in delta.select(BUCKET).distinct().collect())
        # The customers of the batch with their baselines, if they have one: one join finds both for the facts.
        base = baseline(self._deltas("by_customer", version, delta, buckets), self.min_history)
        mine = touched.join(base, F.col("_touched") == base["customer_id"], "left").drop("customer_id")
        whole = self._deltas("fact", version, fresh, buckets)
        judged = self._scored(whole.join(mine, F.col("customer_id").eqNullSafe(F.col("_touched"))))
        flags = judged.groupBy("customer_id").agg(
            F.count_if(V.flagged_condition(self.k)).alias("flagged")).withColumn("version", F.lit(version.number + 1).cast("bigint"))
        new |= publication.write({"flags": flags})
        return publication.commit(version, appended=new, notes={"buckets": self.buckets, "batches": done | {run: batch}})

    @staticmethod
    def _scored(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_sigma", V.sigma(F.col("amount"), F.col("avg_spend"), F.col("stddev_spend")))

    def compact(self, most: int = 24) -> Version:
        """Rewrite tables of more than ``most`` segments as one."""
        version = self.publication.version()
        long = [name for name in TABLES if len(version.tables.get(name, [])) > most]
        if not long:
            return version
        tables = {name: self.publication.read(name, version.number) if name == "fact" else self._flags(version)
                  if name == "flags" else self._state(name, version) for name in long}
        tables |= {name: self._placed(tables[name]) for name in long if name in BUCKETED}
        return self.publication.commit(version, replaced=self.publication.write(tables, by=BUCKETED))

    def _flags(self, version: Version) -> DataFrame:
        """The newest count of each customer."""
        return self.publication.read("flags", version.number).groupBy("customer_id").agg(
            F.max(F.struct("version", "flagged")).alias("x")).select("customer_id", "x.flagged", "x.version")

    def marts(self, customers: DataFrame, number: int | None = None) -> dict[str, DataFrame]:
        """V2-V6 and K1 of a version, all from the same one."""
        version = self.publication.version(number)
        state, deltas = self._state("by_customer", version), self._deltas("by_customer", version)
        fact = self.publication.read("fact", version.number)
        flagged = self._scored(fact.join(baseline(deltas, self.min_history), "customer_id", "left")).where(V.flagged_condition(self.k))
        totals = deltas.agg(
            F.sum("n").alias("total_transactions"), F.sum("debit").cast(SUM).alias("_debit"), F.sum("debit_n").alias("_debit_n"))
        amounts = self._deltas("by_month", version).agg(F.sum("amount").cast(SUM).alias("_sum"))
        flags = self._flags(version).agg(F.sum("flagged").alias("flagged_transactions"))
        row = totals.unionByName(amounts, allowMissingColumns=True).unionByName(flags, allowMissingColumns=True)
        row = row.agg(*(F.max(c).alias(c) for c in row.columns))  # three rows of one value each
        kpi = row.select(
            F.coalesce("total_transactions", F.lit(0)).alias("total_transactions"),
            F.when(F.col("_debit_n") > 0, F.round("_debit", 2)).alias("total_spend_ngn"),
            ratio2("_sum", "total_transactions").alias("avg_transaction_ngn"),
            F.coalesce("flagged_transactions", F.lit(0)).alias("flagged_transactions"))
        return {
            "vw_category_summary": category_summary(deltas),
            "vw_monthly_summary": monthly_summary(self._state("by_month", version)),
            "vw_customer_summary": customer_summary(state, customers),
            "vw_merchant_summary": merchant_summary(state),
            "vw_flagged_transactions": flagged.select(
                "transaction_id", "customer_id", "customer_name", "transaction_date", "amount", "merchant_name", "category",
                "status", F.col("notes").alias("flag_reason"), F.round("_sigma", 2).alias("sigma_score")),
            "kpi_summary": kpi,
        }
