"""The whole workflow in its production shape: clean once, report many times.

``run_workflow`` cleans the raw tables, writes the cleaned fact (partitioned
by month) to a shared folder, reads it back (so every report starts from
files, not from the cleaning lineage) and writes each report as a mart
under ``<out>/marts/<name>``. Each write is its own job; a lost executor only
re-runs its tasks, and a failed run can be repeated (every write overwrites).

``publish_workflow`` is the form for marts that are read while they are renewed:
the same run into a new snapshot, published with one commit at its end.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.cleaning import clean_customers, clean_transactions
from ..operators.quality import assert_unique
from ..sources.publish import Publication, Version
from ..sources.sinks import read_clean_fact, write_clean_fact, write_marts
from . import analysis as Q
from . import views as V


ROW_LEVEL = {"vw_clean_transactions": "transaction_date", "vw_flagged_transactions": "transaction_date"}
ROLLUPS = {"monthly_debit_line": ("vw_monthly_summary", V.monthly_debit_line),
           "merchant_volume": ("vw_merchant_summary", V.merchant_volume)}


def reports(clean: DataFrame, customers: DataFrame) -> dict[str, DataFrame]:
    """Every analysis query, view and dashboard feed over a cleaned fact."""
    fact = V.clean_fact(clean)
    category = V.vw_category_summary(fact)
    monthly = V.vw_monthly_summary(fact)
    merchants = V.vw_merchant_summary(fact)
    return {
        "spend_by_category": Q.spend_by_category(clean),
        "spend_by_text_period": Q.spend_by_text_period(clean),
        "monthly_spend": Q.monthly_spend(clean),
        "top_customers": Q.top_customers(clean, customers),
        "status_breakdown": Q.status_breakdown(clean),
        "top_merchants": Q.top_merchants(clean),
        "spend_by_account_type": Q.spend_by_account_type(clean, customers),
        "running_totals": Q.running_totals(clean, customers),
        "sigma_outliers": Q.sigma_outliers(clean, customers),
        "vw_clean_transactions": V.vw_clean_transactions(clean, customers),
        "vw_category_summary": category,
        "vw_monthly_summary": monthly,
        "vw_customer_summary": V.vw_customer_summary(fact, customers),
        "vw_merchant_summary": merchants,
        "vw_flagged_transactions": V.vw_flagged_transactions(fact),
        "kpi_summary": V.kpi_summary(fact),
        "completion_rate": V.completion_rate(clean),
        "monthly_debit_line": V.monthly_debit_line(monthly),
        "merchant_volume": V.merchant_volume(merchants),
    }


def run_workflow(spark: SparkSession, transactions_raw: DataFrame, customers_raw: DataFrame, out: str, *,
                 null_notes: str = "sql", on_error: str = "fail", only: list[str] | None = None) -> list[str]:
    """Clean, persist the cleaned fact under ``out/clean_fact`` and write the
    reports (all, or the names in ``only``) under ``out/marts``."""
    fact_path = f"{out.rstrip('/')}/clean_fact"
    write_clean_fact(clean_transactions(transactions_raw, null_notes=null_notes, on_error=on_error), fact_path)
    clean = read_clean_fact(spark, fact_path)
    # Reports join attributes to aggregates: a key that occurs twice would repeat rows and inflate totals.
    customers = clean_customers(customers_raw)
    assert_unique(customers, "customer_id")
    root = f"{out.rstrip('/')}/marts"
    marts = reports(clean, customers)
    names = list(marts) if only is None else only
    written = []
    for name in names:
        if name in ROLLUPS:  # a roll-up of another mart reads that mart
            source, build = ROLLUPS[name]
            if source in written:
                marts[name] = build(spark.read.parquet(f"{root}/{source}"))
        written += write_marts({name: marts[name]}, root, by_month=ROW_LEVEL)
    return written


def publish_workflow(spark: SparkSession, transactions_raw: DataFrame, customers_raw: DataFrame, root: str, **options) -> Version:
    """``run_workflow`` into a new snapshot of the publication at ``root``; the cleaned
    fact and all marts become the newest version together, or, if any job fails, not
    at all."""
    publication = Publication(spark, root)
    base = publication.version()
    snapshot = f"snapshots/{int(time.time() * 1000):015}-{uuid.uuid4().hex}"
    names = run_workflow(spark, transactions_raw, customers_raw, f"{publication.root}/{snapshot}", **options)
    marts = {name: [f"{snapshot}/marts/{name}"] for name in names}
    return publication.commit(base, replaced={"clean_fact": [f"{snapshot}/clean_fact"], **marts})
