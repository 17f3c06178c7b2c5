"""ledgerwash: cleaning, data-quality checks and reporting marts for bank
transaction tables, expressed with the Spark DataFrame API.

    sources    schemas, land-raw readers, the TESTDATA fixture, catalog, sinks
    functions  Column -> Column rules (text, flags, amounts, dates, money)
    operators  the cleaning pipeline and the data-quality checks
    plans      analysis queries, views, dashboard feeds, the clean-once workflow
    streaming  incremental cleaning with Structured Streaming
"""

from .operators.cleaning import clean_customers, clean_transactions, dedup_first
from .plans.analysis import (monthly_spend, running_totals, sigma_outliers, spend_by_account_type,
                             spend_by_category, spend_by_text_period, status_breakdown, top_customers,
                             top_merchants)
from .plans.marts import reports, run_workflow
from .plans.views import (clean_fact, completion_rate, kpi_summary, vw_category_summary, vw_clean_transactions,
                          vw_customer_summary, vw_flagged_transactions, vw_merchant_summary, vw_monthly_summary)
from .sources.raw import load_customers, load_raw

__version__ = "0.1.0"

__all__ = [
    "clean_customers", "clean_transactions", "dedup_first", "monthly_spend", "running_totals", "sigma_outliers",
    "spend_by_account_type", "spend_by_category", "spend_by_text_period", "status_breakdown", "top_customers",
    "top_merchants", "reports", "run_workflow", "clean_fact", "completion_rate", "kpi_summary",
    "vw_category_summary", "vw_clean_transactions", "vw_customer_summary", "vw_flagged_transactions",
    "vw_merchant_summary", "vw_monthly_summary", "load_customers", "load_raw",
]
