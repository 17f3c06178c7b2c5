"""Every operator as a named query over the TESTDATA tables.

Each entry is ``(spark, sf_dir) -> DataFrame``: it derives the raw
``transactions``/``customers`` tables from the TESTDATA parquet files, runs
the operator on the whole tables and returns the result. Library operators
return exact decimals; ``comparable`` only normalises output types (decimal
to double after the exact rounding, int to bigint) so results compare
one-to-one with the SQL oracle.
"""

from __future__ import annotations

import datetime
import uuid
from contextlib import AbstractContextManager
from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import bitmaps, variants
from ..operators import quality as D
from ..operators.cleaning import clean_customers, clean_transactions, cleaned_rows
from ..operators.profile import write_profiled
from ..sources import fixtures
from ..session import ensure_checkpoint_dir
from ..sources.catalog import list_views, register_views, views_over
from ..sources.clustered import between, read_clustered, write_clustered
from ..sources.publish import Publication
from ..sources.quarantine import accepted, load_checked, rejects, sort_out
from ..sources.raw import load_raw
from ..sources.scratch import shuffles_released
from ..sources.schema import CUSTOMER_LENGTH_LIMITS, RAW_TEXT_COLUMNS, TRANSACTION_LENGTH_LIMITS
from ..sources.sinks import read_clean_fact, write_clean_fact
from ..streaming.incremental import read_cleaned, start_cleaning_stream
from . import analysis as Q
from .incremental_marts import IncrementalMarts
from . import views as V


def comparable(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


class Tables:
    """Raw and cleaned tables of one TESTDATA scale factor (lazy plans)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.raw = fixtures.raw_transactions(spark, sf_dir)
        self.customers_raw = fixtures.raw_customers(spark, sf_dir)

    def clean_columns(self, *columns: str) -> DataFrame:
        """The cleaned fact for a plan that reads it twice: these columns only,
        behind one shared shuffle."""
        return clean_transactions(self.raw, columns=columns)

    def upto(self, step: str, **kw) -> DataFrame:
        return clean_transactions(self.raw, upto=step, **kw)

    @property
    def dedup(self) -> DataFrame:
        return self.upto("C1")

    @property
    def clean(self) -> DataFrame:
        return clean_transactions(self.raw)

    @property
    def clean_rows(self) -> AbstractContextManager[DataFrame]:
        """The cleaned fact for a job that writes it."""
        return cleaned_rows(self.raw, f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/rows-{uuid.uuid4().hex}")

    @property
    def customers(self) -> DataFrame:
        return clean_customers(self.customers_raw)

    @property
    def fact(self) -> DataFrame:
        return V.clean_fact(self.clean)


    @property
    def shared_fact(self) -> DataFrame:
        return V.clean_fact(self.clean_columns(*FACT_COLUMNS))


#: What ``clean_fact`` reads.
FACT_COLUMNS = ("customer_id", "customer_name", "transaction_date_clean", "amount_clean", "currency", "transaction_type",
                "merchant_name", "category", "status", "location", "notes")

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return comparable(fn(Tables(spark, sf_dir)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return fn
    return register


def _ids(df: DataFrame, *cols: str) -> DataFrame:
    return df.select("transaction_id", "ingest_seq", *cols)


# -- sources / schema checks ------------------------------------------------------

@query("a5_customer_key_unique")
def _a5(t: Tables):
    """A5: customer ids occurring more than once (expected: none)."""
    return D.duplicate_keys(t.customers_raw, "customer_id", n=None)


@query("a6_transaction_length_violations")
def _a6t(t: Tables):
    return D.length_violations(t.raw, TRANSACTION_LENGTH_LIMITS)


@query("a6_customer_length_violations")
def _a6c(t: Tables):
    return D.length_violations(t.customers_raw, CUSTOMER_LENGTH_LIMITS)


# -- cleaning steps ----------------------------------------------------------------

@query("c01_dedup_first")
def _c01(t: Tables):
    return t.dedup


@query("c02_c05_fill_nulls")
def _c02(t: Tables):
    return _ids(t.upto("C5"), "customer_name", "category", "status", "location")


@query("c06_c07_currency")
def _c06(t: Tables):
    return _ids(t.upto("C7"), "currency")


@query("c08_c09_lower_trim")
def _c08(t: Tables):
    return _ids(t.upto("C9"), "transaction_type", "status")


@query("c10_whitespace_and_blanks")
def _c10(t: Tables):
    return _ids(t.upto("C10d"), "customer_name", "status", "category")


@query("c10b_clean_customers")
def _c10b(t: Tables):
    return t.customers


@query("c11_merchant_canonical")
def _c11(t: Tables):
    return _ids(t.upto("C11"), "merchant_name")


@query("c12_flags")
def _c12(t: Tables):
    return _ids(t.upto("C12b"), "amount", "transaction_date", "notes")


@query("c13_c14_amounts")
def _c13(t: Tables):
    return _ids(t.upto("C14"), "amount", "status", "notes", "amount_clean")


@query("c13_amounts_null_notes_as_empty")
def _c13e(t: Tables):
    return _ids(t.upto("C14", null_notes="as_empty"), "amount", "notes", "amount_clean")


@query("c15_dates")
def _c15(t: Tables):
    return _ids(t.upto("C15"), "transaction_date", "notes", "transaction_date_clean")


@query("clean_transactions")
def _clean(t: Tables):
    return t.clean


@query("clean_transactions_on_error_null")
def _clean_null(t: Tables):
    """Junk amounts and impossible dates become NULL instead of raising."""
    return clean_transactions(fixtures.raw_transactions(t.spark, t.sf_dir, junk=True), on_error="null")


def _shared(t: Tables, name: str) -> str:
    return f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("a3_load_raw_csv")
def _a3(t: Tables):
    """A3: the raw rows land as CSV files of the 13 columns in four arrivals (the first
    row without an id, few originals, the other originals, every re-sent copy), are
    loaded as text and cleaned; without ``ingest_seq`` the files' own order decides
    which copy came first."""
    path = _shared(t, "csv")
    few = F.expr("ingest_seq = 1 AND k % 10 = 0")
    order = [F.col(c).asc_nulls_last() for c in ("ingest_seq", "amount", "transaction_date", "k")]
    # All rows without an id are one group; its first row lands alone, once more among the others.
    nameless = t.raw.where("transaction_id IS NULL").orderBy(*order).limit(1)
    for arrival in (nameless, t.raw.where(few), t.raw.where(~few & (F.col("ingest_seq") == 1)), t.raw.where("ingest_seq = 2")):
        # Rows of one id are in one partition; a few ids come twice in one arrival, the smaller amount text first.
        with shuffles_released(t.spark):
            (arrival.sortWithinPartitions("amount", "transaction_date", "k").select(*RAW_TEXT_COLUMNS)
             .write.mode("append").option("header", "true").option("nullValue", "\\N").option("compression", "gzip")
             .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path))
    return clean_transactions(load_raw(t.spark, path, fmt="csv", nullValue="\\N")).drop("ingest_seq", "k")


@query("a3_quarantine")
def _a3q(t: Tables):
    """Raw rows with amounts and dates that no cast takes land as CSV,
    some lines cut off; each line is kept or rejected with its reasons."""
    path, out = _shared(t, "csv"), _shared(t, "checked")
    options = {"nullValue": "\\N", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    raw = fixtures.raw_transactions(t.spark, t.sf_dir, junk=True)
    line = F.to_csv(F.struct(*RAW_TEXT_COLUMNS), options)
    raw.select(F.when(F.col("k") % 701 == 0, F.substring_index(line, ",", 4)).otherwise(line)).write.text(path)
    sort_out(load_checked(t.spark, path, "csv", header="false", nullValue="\\N"), out)
    kept, rejected = accepted(t.spark, out), rejects(t.spark, out)
    columns = ["transaction_id", "customer_id", "amount", "transaction_date"]
    return kept.select(*columns, F.lit("kept").alias("outcome")).unionByName(
        rejected.select(*columns, F.array_join("reasons", "; ").alias("outcome")))


@query("a8_views_by_name")
def _a8(t: Tables):
    """The view stack over a saved cleaned fact registered, listed, and
    each view read by name."""
    path = _shared(t, "clean-fact")
    with t.clean_rows as clean:
        write_clean_fact(clean, path)
    names = register_views(views_over(read_clean_fact(t.spark, path), t.customers))
    rows = reduce(DataFrame.unionByName, (
        t.spark.sql(f"SELECT '{name}' AS view_name, count(*) AS view_rows FROM {name}") for name in names))
    return list_views(t.spark).join(rows, "view_name")


@query("a10_write_and_read_clean_fact")
def _a10(t: Tables):
    """A10: the cleaned fact through its sink and back."""
    path = _shared(t, "clean-fact")
    with t.clean_rows as clean:
        write_clean_fact(clean, path)
    return read_clean_fact(t.spark, path)


@query("a10_publish")
def _a10p(t: Tables):
    """The category and monthly marts published twice (of 2022, then of all
    rows) and both versions read back: each is whole, and the newest holds all."""
    publication = Publication(t.spark, _shared(t, "published"))
    fact = Publication(t.spark, _shared(t, "fact"))
    fact.publish({"fact": t.fact})
    rows = fact.read("fact")
    for part in (rows.where("transaction_date < DATE'2023-01-01'"), rows):
        publication.publish({"categories": V.vw_category_summary(part), "months": V.vw_monthly_summary(part)})
    found = [df.select(F.lit(n).cast("bigint").alias("version"), F.lit(name).alias("mart"), F.col(key).alias("group_key"),
                       "transaction_count", F.col(total).alias("total_ngn"), "avg_transaction_ngn")
             for n in publication.versions() for name, key, total in (
                 ("categories", "category", "total_spent_ngn"), ("months", "year_month", "total_debit_ngn"))
             for df in (publication.read(name, n),)]
    return reduce(DataFrame.unionByName, found)


@query("v3_active_customers_from_bitmaps")
def _v3_bitmaps(t: Tables):
    """V3's distinct customers by month, quarter and year and over all, each from the
    stored sets of the months."""
    path = _shared(t, "month-sets")
    fact = Publication(t.spark, path)
    fact.publish({"fact": t.fact})
    rows = fact.read("fact")
    fact.publish({"sets": V.monthly_customer_sets(rows, bitmaps.extended(rows.select("customer_id")))})
    sets = fact.read("sets")
    year = F.substring("year_month", 1, 4)
    periods = {"month": F.col("year_month"), "year": year, "all": F.lit("all"),
               "quarter": F.concat(year, F.lit("-Q"), F.ceil(F.substring("year_month", 6, 2).cast("int") / 3).cast("string"))}
    return reduce(DataFrame.unionByName, (
        bitmaps.distinct_counts(sets.withColumn("period", p), ["period"], "active_customers").select(
            F.lit(name).alias("span"), "period", "active_customers") for name, p in periods.items()))


@query("v_incremental_marts")
def _v_inc(t: Tables):
    """V2-V6, K1 after three batches of cleaned rows, from merged states; one row a
    group, with the columns that the marts have in common."""
    path = _shared(t, "clean-fact")
    with t.clean_rows as clean:
        write_clean_fact(clean, path)
    clean = read_clean_fact(t.spark, path)
    keeper = IncrementalMarts(Publication(t.spark, _shared(t, "marts")))
    for batch in range(3):
        keeper.apply(clean.where(F.pmod(F.col("k"), F.lit(3)) == batch), "query", batch)
    marts = keeper.marts(t.customers)
    none = F.lit(None).cast("bigint")
    shape = {
        "vw_category_summary": ("category", "transaction_count", "total_spent_ngn", "avg_transaction_ngn", none),
        "vw_monthly_summary": ("year_month", "transaction_count", "total_debit_ngn", "avg_transaction_ngn", "active_customers"),
        "vw_customer_summary": ("customer_id", "total_transactions", "total_debit_ngn", "avg_debit_ngn", "merchants_used"),
        "vw_merchant_summary": (F.concat_ws("|", "merchant_name", "category"), "transaction_count", "total_spent_ngn",
                                "avg_transaction_ngn", "unique_customers"),
        "vw_flagged_transactions": ("transaction_id", none, "amount", "sigma_score", none),
        "kpi_summary": (F.lit("all"), "total_transactions", "total_spend_ngn", "avg_transaction_ngn", "flagged_transactions"),
    }

    def common(name: str) -> DataFrame:
        key, rows, total, average, distinct = (F.col(c) if isinstance(c, str) else c for c in shape[name])
        return marts[name].select(
            F.lit(name).alias("mart"), key.alias("group_key"), rows.cast("bigint").alias("group_rows"),
            total.cast("double").alias("total_ngn"), average.cast("double").alias("average_ngn"), distinct.cast("bigint").alias("distinct_values"))
    return reduce(DataFrame.unionByName, map(common, shape))


@query("s01_incremental_clean")
def _s01(t: Tables):
    """The streaming form of the pipeline: the raw rows land as two file
    arrivals (half of the originals and all without an id, then the rest with every re-sent copy)
    in the shared checkpoint folder, the stream cleans both, and the result
    must equal the batch pipeline (first arrival wins across batches)."""
    spark = t.spark
    base = _shared(t, "incremental")
    raw_dir, out_dir, ckpt = f"{base}/raw", f"{base}/cleaned", f"{base}/_checkpoint"
    first = F.expr("ingest_seq = 1 AND (k % 2 = 0 OR transaction_id IS NULL)")
    for arrival in (t.raw.filter(first), t.raw.filter(~first)):
        with shuffles_released(spark):
            arrival.write.mode("append").parquet(raw_dir)
        start_cleaning_stream(spark, raw_dir, out_dir, ckpt, available_now=True).awaitTermination()
    return read_cleaned(spark, out_dir)


# -- data-quality inspection -------------------------------------------------------

@query("d01_duplicate_keys")
def _d01(t: Tables):
    return D.duplicate_keys(t.raw, "transaction_id", n=20)


@query("d01_duplicate_keys_top10")
def _d01b(t: Tables):
    """D1, second form: the ten most repeated ids."""
    return D.duplicate_keys(t.raw, "transaction_id", n=10)


@query("d02_duplicate_row_count")
def _d02(t: Tables):
    return D.duplicate_row_count(t.raw)


@query("d03_duplicate_rows")
def _d03(t: Tables):
    return D.duplicate_rows(t.raw, n=20)


@query("d04_row_count_after_dedup")
def _d04(t: Tables):
    return D.row_count(t.dedup)


@query("d05_no_duplicates_left")
def _d05(t: Tables):
    return D.duplicate_keys(t.dedup, "transaction_id", n=None)


@query("d_profile_one_pass")
def _d_profile(t: Tables):
    """D2, D4, D6, D12, D15-D18, A6 as one job counts them while it writes the cleaned
    fact: (check_id, metric, value)."""
    found = write_profiled(t.raw, _shared(t, "clean-fact"))
    return t.spark.createDataFrame([(*name.split(".", 1), None if v is None else float(v)) for name, v in found.items()],
                                   "check_id string, metric string, value double")


@query("d06_null_counts")
def _d06(t: Tables):
    return D.null_counts(t.clean, {"remaining_null_names": "customer_name",
                                   "remaining_null_categories": "category",
                                   "remaining_null_status": "status"})


# D7/D8 run where the source runs them: after the case and whitespace
# fixes, before the blank fix (so a blank status or category still shows).

@query("d07_distinct_currency")
def _d07a(t: Tables):
    return D.distinct_values(t.upto("C10a"), "currency")


@query("d07_distinct_transaction_type")
def _d07b(t: Tables):
    return D.distinct_values(t.upto("C10a"), "transaction_type")


@query("d07_distinct_status")
def _d07c(t: Tables):
    return D.distinct_values(t.upto("C10a"), "status")


@query("d08_distinct_category_sorted")
def _d08(t: Tables):
    return D.distinct_values(t.upto("C10a"), "category", sort=True)


@query("d09_status_lengths_before_blank_fix")
def _d09a(t: Tables):
    return D.distinct_with_length(t.upto("C9"), "status")


@query("d09_category_lengths_before_blank_fix")
def _d09b(t: Tables):
    return D.distinct_with_length(t.upto("C9"), "category")


@query("d09_status_lengths_after_blank_fix")
def _d09c(t: Tables):
    return D.distinct_with_length(t.clean, "status")


@query("d09_category_lengths_after_blank_fix")
def _d09d(t: Tables):
    return D.distinct_with_length(t.clean, "category")


@query("d10_merchant_frequency_before")
def _d10a(t: Tables):
    return D.value_frequency(t.dedup, "merchant_name")


@query("d10_merchant_frequency_after")
def _d10b(t: Tables):
    return D.value_frequency(t.clean, "merchant_name")


@query("d11_rare_merchants_first")
def _d11(t: Tables):
    return D.value_frequency(t.clean, "merchant_name", count_name="times_appeared", order="count")


@query("d11_variant_candidates")
def _d11_variants(t: Tables):
    """Merchant spellings before C11, grouped as likely variants."""
    return variants.variant_candidates(t.upto("C10d"))


@query("d12_zero_amount_count")
def _d12(t: Tables):
    return D.zero_amount_count(t.dedup)


@query("d13_flag_sample_first_attempt")
def _d13a(t: Tables):
    """After the bracket-pattern attempt only: no row is flagged."""
    return D.flag_sample(t.upto("C12a"))


@query("d13_flag_sample")
def _d13b(t: Tables):
    return D.flag_sample(t.upto("C12b"))


@query("d14_future_date_preview")
def _d14(t: Tables):
    return D.future_date_preview(t.dedup)


@query("d15_future_flag_count")
def _d15(t: Tables):
    return D.flag_count(t.upto("C12b"))


@query("d16_amount_profile")
def _d16(t: Tables):
    return D.amount_profile(t.upto("C13"))


@query("d17_reversal_profile")
def _d17(t: Tables):
    return D.reversal_profile(t.upto("C14"))


@query("d18_date_coverage")
def _d18(t: Tables):
    return D.date_coverage(t.clean)


# -- analysis ------------------------------------------------------------------------

@query("q1_spend_by_category")
def _q1(t: Tables):
    return Q.spend_by_category(t.clean)


@query("q2a_spend_by_text_period")
def _q2a(t: Tables):
    return Q.spend_by_text_period(t.clean)


@query("q2b_monthly_spend")
def _q2b(t: Tables):
    return Q.monthly_spend(t.clean)


@query("q3_top_customers")
def _q3(t: Tables):
    return Q.top_customers(t.clean, t.customers, n=10)


@query("q4_status_breakdown")
def _q4(t: Tables):
    return Q.status_breakdown(t.clean)


@query("q5_top_merchants")
def _q5(t: Tables):
    return Q.top_merchants(t.clean, n=15)


@query("q6_spend_by_account_type")
def _q6(t: Tables):
    return Q.spend_by_account_type(t.clean, t.customers)


@query("q7_running_totals")
def _q7(t: Tables):
    clean = t.clean_columns("customer_id", "transaction_type", "transaction_date_clean", "merchant_name", "amount_clean", "notes")
    return Q.running_totals(clean, t.customers, top=5, n=50)


@query("q7_running_totals_all")
def _q7_all(t: Tables):
    """Q7 for every customer and row, without a limit."""
    return Q.running_totals_all(t.clean.filter(Q.spend_filter()))


@query("q8a_customer_baseline")
def _q8a(t: Tables):
    return Q.customer_baseline(t.clean, min_history=10, rounded=True)


@query("q8_sigma_outliers")
def _q8(t: Tables):
    clean = t.clean_columns("customer_id", "transaction_type", "transaction_date_clean", "merchant_name", "category", "status",
                            "amount_clean", "notes")
    return Q.sigma_outliers(clean, t.customers, k=3.0, min_history=10, n=20, round_baseline=True)


# -- views and dashboard feeds ---------------------------------------------------------

@query("v1_clean_transactions")
def _v1(t: Tables):
    return V.vw_clean_transactions(t.clean, t.customers)


@query("v1_quarter_from_clustered_fact")
def _v1_clustered(t: Tables):
    """V1 of one quarter, from the fact laid out by month and customer: other months'
    folders are not read."""
    path = _shared(t, "clustered")
    with t.clean_rows as clean:
        write_clustered(clean, path)
    quarter = between(read_clustered(t.spark, path), datetime.date(2023, 4, 1), datetime.date(2023, 6, 30))
    return V.vw_clean_transactions(quarter, t.customers)


@query("v2_category_summary")
def _v2(t: Tables):
    return V.vw_category_summary(t.fact)


@query("v3_monthly_summary")
def _v3(t: Tables):
    return V.vw_monthly_summary(t.fact)


@query("v4_customer_summary")
def _v4(t: Tables):
    return V.vw_customer_summary(t.fact, t.customers)


@query("v5_merchant_summary")
def _v5(t: Tables):
    return V.vw_merchant_summary(t.fact)


@query("v6_flagged_transactions")
def _v6(t: Tables):
    return V.vw_flagged_transactions(t.shared_fact)


@query("v6_flagged_nonblank_notes")
def _v6b(t: Tables):
    return V.vw_flagged_transactions(t.shared_fact, nonblank_flags_only=True)


@query("v7_clean_transactions_count")
def _v7a(t: Tables):
    return V.view_row_count(t.fact, "clean_transactions")


@query("v7_top_categories")
def _v7b(t: Tables):
    return V.top_categories(V.vw_category_summary(t.fact), 5)


@query("v7_latest_months")
def _v7c(t: Tables):
    return V.latest_months(V.vw_monthly_summary(t.fact), 3)


@query("v7_flagged_count")
def _v7d(t: Tables):
    return V.view_row_count(V.vw_flagged_transactions(t.shared_fact), "flagged_transactions")


@query("k1_kpi_summary")
def _k1(t: Tables):
    return V.kpi_summary(t.shared_fact)


@query("k2_monthly_debit_line")
def _k2a(t: Tables):
    return V.monthly_debit_line(V.vw_monthly_summary(t.fact))


@query("k2_merchant_volume")
def _k2b(t: Tables):
    return V.merchant_volume(V.vw_merchant_summary(t.fact))


@query("k3_completion_rate")
def _k3(t: Tables):
    return V.completion_rate(t.clean)
