"""Land-raw loading: explicit text schema, empty fields, arrival order."""

import os
import uuid

from ledgerwash.operators.cleaning import clean_transactions
from ledgerwash.session import ensure_checkpoint_dir
from ledgerwash.sources.raw import load_customers, load_raw
from ledgerwash.sources.schema import RAW_TEXT_COLUMNS


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_load_raw_csv_keeps_text_and_decides_empty_notes(spark):
    base = os.path.join(ensure_checkpoint_dir(spark), f"csv-{uuid.uuid4().hex[:8]}")
    header = ",".join(RAW_TEXT_COLUMNS)
    _write(f"{base}/tx/part-0.csv", "\n".join([
        header,
        'T1,C1,Ann,AC1,2024-01-02,N/A,ngn,DEBIT,GT Bank,,PENDING,Lagos,',
        'T1,C1,Ann,AC1,2024-01-02,7.50,ngn,DEBIT,GT Bank,Food,PENDING,Lagos,"SUSPECTED DUPLICATE"',
        'T2,C2,"  Bola  Ade ",AC2,"05 January, 2024",0.00,₦,credit,shoprite ng,Food,,Abuja,""',
    ]) + "\n")
    raw = load_raw(spark, f"{base}/tx", fmt="csv")
    assert [f.dataType.simpleString() for f in raw.schema.fields][:13] == ["string"] * 13
    rows = {(r.transaction_id, r.amount): r for r in raw.collect()}
    # How the loader reads empty text decides NULL vs '' notes (trap T2):
    # by default every empty field is NULL; with another NULL marker a quoted
    # "" stays '' while an unquoted empty field is still NULL.
    assert rows[("T1", "N/A")].notes is None and rows[("T2", "0.00")].notes is None
    kept = {(r.transaction_id, r.amount): r.notes
            for r in load_raw(spark, f"{base}/tx", fmt="csv", nullValue="\\N").collect()}
    assert kept[("T1", "N/A")] is None and kept[("T2", "0.00")] == ""
    assert rows[("T2", "0.00")].transaction_date == "05 January, 2024"
    assert rows[("T2", "0.00")].status is None
    assert raw.filter("arrival IS NULL OR k IS NULL").count() == 0
    assert raw.select("arrival").distinct().count() == 3
    cleaned = {r.transaction_id: r for r in clean_transactions(raw).collect()}
    assert len(cleaned) == 2 and cleaned["T1"].amount == "N/A"
    assert str(cleaned["T2"].transaction_date_clean) == "2024-01-05"
    assert cleaned["T2"].customer_name == "Bola Ade" and cleaned["T2"].merchant_name == "Shoprite"


def test_the_first_arrival_is_kept_across_files(spark):
    """A small early file, a large later one that sorts first by size and whose
    amount text sorts first, and two copies within one file."""
    base = os.path.join(ensure_checkpoint_dir(spark), f"csv-{uuid.uuid4().hex[:8]}")
    line = "{},C1,Ann,AC1,2024-01-02,{},NGN,debit,KFC,Food,completed,Lagos,{}"
    head = ",".join(RAW_TEXT_COLUMNS)
    _write(f"{base}/tx/z-early.csv", "\n".join([head, line.format("T1", "900.00", "first"), line.format("T2", "7.00", "up"),
                                                line.format("T2", "1.00", "down")]) + "\n")
    late = [head, line.format("T1", "10.00", "resent copy")]
    _write(f"{base}/tx/a-late.csv", "\n".join(late + [line.format(f"X{i}", "1.00", "x" * 200) for i in range(3000)]) + "\n")
    now = os.stat(f"{base}/tx/z-early.csv").st_mtime
    os.utime(f"{base}/tx/a-late.csv", (now + 5, now + 5))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        kept = {r.transaction_id: r.notes for r in clean_transactions(load_raw(spark, f"{base}/tx", fmt="csv")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert (kept["T1"], kept["T2"], len(kept)) == ("first", "up", 3002)


def test_files_per_month_follow_the_data_and_not_the_tasks(spark, tables):
    from ledgerwash.sources.sinks import read_clean_fact, write_clean_fact
    path = os.path.join(ensure_checkpoint_dir(spark), f"fact-{uuid.uuid4().hex[:8]}")
    write_clean_fact(tables.clean.repartition(16), path)
    files = [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    months = len([d for d in os.listdir(path) if d.startswith("year_month=")])
    assert len(files) <= 2 * months
    assert read_clean_fact(spark, path).count() == tables.clean.count()


def test_load_customers_schema(spark):
    base = os.path.join(ensure_checkpoint_dir(spark), f"csv-{uuid.uuid4().hex[:8]}")
    _write(f"{base}/c/part-0.csv", "customer_id,full_name,email,phone,city,account_type,account_number,join_date,credit_score\n"
           "C1,Ann,,0,Lagos,Savings,AC1,2020-01-01,700\nC2,,,,Abuja,,,,\n")
    c = load_customers(spark, f"{base}/c", fmt="csv")
    assert c.schema["credit_score"].dataType.simpleString() == "int"
    assert sorted((r.customer_id, r.credit_score) for r in c.collect()) == [("C1", 700), ("C2", None)]


def test_command_line_workflow(spark, tables):
    from ledgerwash.__main__ import main
    base = os.path.join(ensure_checkpoint_dir(spark), f"cli-{uuid.uuid4().hex[:8]}")
    tables.raw.write.parquet(f"{base}/raw_tx")
    tables.customers_raw.write.parquet(f"{base}/raw_cust")
    written = main(["--transactions", f"{base}/raw_tx", "--customers", f"{base}/raw_cust", "--out", f"{base}/out",
                    "--format", "parquet", "--only", "spend_by_category", "kpi_summary"])
    assert written == ["spend_by_category", "kpi_summary"]
    assert spark.read.parquet(f"{base}/out/marts/spend_by_category").count() > 0
    assert spark.read.parquet(f"{base}/out/clean_fact").count() == tables.clean.count()


def test_command_line_gives_amounts_to_csv_rows_without_a_note(spark):
    from ledgerwash.__main__ import main
    base = os.path.join(ensure_checkpoint_dir(spark), f"cli-{uuid.uuid4().hex[:8]}")
    _write(f"{base}/tx/a.csv", ",".join(RAW_TEXT_COLUMNS) + "\nT1,C1,Ann,AC1,2024-01-02,7.50,NGN,debit,KFC,Food,completed,Lagos,\n")
    customer = "C1,Ann,,0,Lagos,Savings,AC1,2020-01-01,700\n"
    _write(f"{base}/c/a.csv", "customer_id,full_name,email,phone,city,account_type,account_number,join_date,credit_score\n" + customer)
    args = ["--transactions", f"{base}/tx", "--customers", f"{base}/c", "--out", f"{base}/out", "--only", "kpi_summary"]
    main(args)
    assert str(spark.read.parquet(f"{base}/out/marts/kpi_summary").first().total_spend_ngn) == "7.50"
    with open(f"{base}/c/a.csv", "a") as f:
        f.write(customer)
    import pytest
    with pytest.raises(AssertionError, match="not unique"):
        main(args)


def test_stored_views_read_the_marts(spark, tables):
    from ledgerwash.plans.marts import run_workflow
    from ledgerwash.sources.catalog import store_views
    out = os.path.join(ensure_checkpoint_dir(spark), f"stored-{uuid.uuid4().hex[:8]}")
    names = ["vw_monthly_summary", "monthly_debit_line"]
    run_workflow(spark, tables.raw, tables.customers_raw, out, only=names)
    spark.sql("CREATE DATABASE IF NOT EXISTS stored_here")
    spark.sql("USE stored_here")
    try:
        store_views(spark, out, names)
        other = spark.newSession()
        assert other.sql("SELECT count(*) FROM stored_here.vw_monthly_summary").first()[0] == \
            other.sql("SELECT count(*) FROM stored_here.monthly_debit_line").first()[0] > 0
    finally:
        spark.sql("DROP DATABASE stored_here CASCADE")
        spark.sql("USE default")
