"""Analysis queries, reporting views and KPI feeds built on the cleaned fact."""
