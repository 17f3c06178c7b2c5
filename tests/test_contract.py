"""Driver contract: entry, queries, oracle_sql."""

import __spark_entry__ as E
from ledgerwash.plans.registry import REGISTRY


def test_entry_returns_rows_with_stable_schema(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["category", "transaction_count", "total_spent_ngn", "avg_transaction_ngn",
                          "percentage_of_total"]
    assert E.entry(spark).schema == df.schema


def test_every_query_has_an_oracle_and_unique_columns(spark):
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert set(REGISTRY) <= set(o), sorted(set(REGISTRY) - set(o))
    for name, fn in REGISTRY.items():
        cols = fn(spark, "/root/testdata/sf0.001").columns
        assert len(cols) == len(set(cols)), name


def test_views_register_and_list(spark, tables):
    from ledgerwash.sources.catalog import build_views, list_views, register_views
    from ledgerwash.plans.views import VIEW_NAMES
    names = register_views(build_views(tables.raw, tables.customers_raw))
    assert names == sorted(VIEW_NAMES)
    listed = [r.view_name for r in list_views(spark).collect()]
    assert listed == sorted(VIEW_NAMES)
    assert spark.sql("SELECT count(*) FROM vw_clean_transactions").collect()[0][0] > 0


def test_write_and_read_clean_fact_and_marts(spark, tables, tmp_path_factory):
    from ledgerwash.sources.sinks import read_clean_fact, write_clean_fact, write_marts
    from ledgerwash.plans import views as V
    from ledgerwash.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark)
    path = f"{base}/test-clean-fact"
    write_clean_fact(tables.clean, path)
    back = read_clean_fact(spark, path)
    assert back.count() == tables.clean.count()
    assert sorted(back.columns) == sorted(tables.clean.columns)
    one_month = read_clean_fact(spark, path, months=["2023-05"])
    assert one_month.count() == back.filter("date_format(transaction_date_clean, 'yyyy-MM') = '2023-05'").count() > 0
    scan = one_month._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year_month" in scan and "2023-05" in scan
    written = write_marts({"vw_category_summary": V.vw_category_summary(tables.fact)}, f"{base}/test-marts")
    assert written == ["vw_category_summary"]
    assert spark.read.parquet(f"{base}/test-marts/vw_category_summary").count() > 0


def test_run_workflow_writes_every_mart_equal_to_direct_queries(spark, tables):
    import uuid
    from ledgerwash.plans.marts import reports, run_workflow
    from ledgerwash.session import ensure_checkpoint_dir
    out = f"{ensure_checkpoint_dir(spark)}/workflow-{uuid.uuid4().hex[:8]}"
    written = run_workflow(spark, tables.raw, tables.customers_raw, out)
    direct = reports(tables.clean, tables.customers)
    assert sorted(written) == sorted(direct)
    flagged = spark.read.parquet(f"{out}/marts/vw_flagged_transactions")
    assert "year_month" in flagged.columns
    assert flagged.count() == direct["vw_flagged_transactions"].count()
    for name in ("spend_by_category", "sigma_outliers", "vw_customer_summary", "kpi_summary"):
        got = spark.read.parquet(f"{out}/marts/{name}")
        want = direct[name]
        assert got.count() == want.count(), name
        assert got.select(want.columns).exceptAll(want).count() == 0, name
