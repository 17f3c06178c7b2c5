"""Named views (A8) and the catalog listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import clean_customers, clean_transactions


def build_views(transactions_raw: DataFrame, customers_raw: DataFrame, *, null_notes: str = "sql",
                on_error: str = "fail") -> dict[str, DataFrame]:
    """The six reporting views as DataFrames, keyed by view name."""
    clean = clean_transactions(transactions_raw, null_notes=null_notes, on_error=on_error)
    return views_over(clean, clean_customers(customers_raw))


def views_over(clean: DataFrame, customers: DataFrame) -> dict[str, DataFrame]:
    """The six views over a cleaned fact (a saved one, if several will be read:
    each view is a plan of its own) and cleaned customers."""
    from ..plans import views as V
    fact = V.clean_fact(clean)
    return {
        "vw_clean_transactions": V.vw_clean_transactions(clean, customers),
        "vw_category_summary": V.vw_category_summary(fact),
        "vw_monthly_summary": V.vw_monthly_summary(fact),
        "vw_customer_summary": V.vw_customer_summary(fact, customers),
        "vw_merchant_summary": V.vw_merchant_summary(fact),
        "vw_flagged_transactions": V.vw_flagged_transactions(fact),
    }


def register_views(views: dict[str, DataFrame]) -> list[str]:
    """Create or replace one temporary view per DataFrame. A temp view is
    a stored plan: reading it recomputes it (persist the cleaned fact or
    write marts to pre-aggregate)."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return sorted(views)


def store_views(spark: SparkSession, root: str, names) -> list[str]:
    """A8, stored: create or replace a view of the catalog over each mart that
    ``run_workflow`` has written under ``root/marts``, so that other sessions
    see it too. (A stored view needs a saved table below it; the views of
    ``register_views`` end with their session.)"""
    for name in names:
        path = f"{root.rstrip('/')}/marts/{name}".replace("`", "``")
        spark.sql(f"CREATE OR REPLACE VIEW `{name}` AS SELECT * FROM parquet.`{path}`")
    return sorted(names)


def list_views(spark: SparkSession, prefix: str = "vw_") -> DataFrame:
    """The registered views, sorted by name."""
    return (spark.sql("SHOW VIEWS")
            .filter(F.col("viewName").startswith(prefix))
            .select(F.col("viewName").alias("view_name"),
                    F.when(F.col("isTemporary"), F.lit("TEMPORARY VIEW")).otherwise(F.lit("VIEW")).alias("table_type"))
            .orderBy("view_name"))
