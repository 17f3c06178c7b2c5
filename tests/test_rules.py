"""Per-rule unit tests on hand-written rows (FIXTURES.md §3)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException

from helpers import one_col, tx
from ledgerwash.functions import amounts, dates, flags, text
from ledgerwash.operators.cleaning import clean_transactions, dedup_first
from ledgerwash.sources.schema import FUTURE_FLAG, MERCHANT_VARIANTS, ZERO_FLAG


def _vals(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_c1_dedup_keeps_first_arrival_and_one_null_group(spark):
    raw = tx(spark, dict(transaction_id="A", ingest_seq=2, notes="late"),
             dict(transaction_id="A", ingest_seq=1, notes="first"),
             dict(transaction_id="B", ingest_seq=1),
             dict(transaction_id=None, ingest_seq=1, notes="n1"),
             dict(transaction_id=None, ingest_seq=2, notes="n2"))
    out = sorted((r.transaction_id or "", r.ingest_seq, r.notes)
                 for r in dedup_first(raw).collect())
    assert out == [("", 1, "n1"), ("A", 1, "first"), ("B", 1, "")]


def test_c1_dedup_is_idempotent(spark, tables):
    once = dedup_first(tables.raw)
    assert once.count() == dedup_first(once).count() == tables.raw.select("transaction_id").distinct().count()


def test_c6_c7_currency(spark):
    df = one_col(spark, ["ngn", "NGN ", "₦", "usd", None])
    assert _vals(df, text.currency_code("v")) == ["NGN", "NGN", "NGN", "USD", None]


def test_c10a_squeeze_whitespace(spark):
    df = one_col(spark, ["  Fatima  Aliyu ", "a\tb", None])
    assert _vals(df, text.squeeze_whitespace("v")) == ["Fatima Aliyu", "a b", None]


def test_c10c_fill_blank(spark):
    df = one_col(spark, [None, "", "  ", "failed"])
    assert _vals(df, text.fill_blank("v", "unknown")) == ["unknown", "unknown", "unknown", "failed"]


def test_c2_fill_null_keeps_blank(spark):
    df = one_col(spark, [None, "", "x"])
    assert _vals(df, text.fill_null("v", "Unknown")) == ["Unknown", "", "x"]


def test_c11_every_spelling_maps_and_others_keep_text(spark):
    cases = []
    for canonical, spellings in MERCHANT_VARIANTS.items():
        cases += [(f"  {s.upper()} ", canonical) for s in spellings]
    assert len(cases) == 35
    df = one_col(spark, [c[0] for c in cases] + [" Air Peace ", None])
    got = _vals(df, text.canonical_merchant("v"))
    assert got == [c[1] for c in cases] + [" Air Peace ", None]


def test_c12_zero_flag_overwrites_only_exact_zero_texts(spark):
    amts = ["0.00", " 0 ", "0.0", "-0.00", "0.01"]
    df = spark.createDataFrame([(a, "earlier note") for a in amts], "amount string, notes string")
    got = _vals(df, flags.flag_zero_amount("notes", "amount"))
    assert got == [ZERO_FLAG, ZERO_FLAG, "earlier note", "earlier note", "earlier note"]


def test_c12a_bracket_pattern_matches_only_literal_brackets(spark):
    df = spark.createDataFrame([("2026-01-01", None), ("202[6-9]x", None)], "d string, notes string")
    assert _vals(df, flags.flag_future_prefix("notes", "d")) == [None, FUTURE_FLAG]


def test_c12b_future_flag_appends(spark):
    df = spark.createDataFrame([("2026-01-01", None), ("01/02/2025", ""), ("Jan 05 2027", "x"),
                                ("2028-01-01", "y")], "d string, notes string")
    assert _vals(df, flags.flag_future_dates("notes", "d")) == [
        FUTURE_FLAG, " | " + FUTURE_FLAG, "x | " + FUTURE_FLAG, "y"]


def test_c13_amount_cast_rounding_and_null_notes_modes(spark):
    df = spark.createDataFrame([("12.345", ""), ("-0.005", ""), ("N/A", ""), ("5.00", None),
                                ("0.00", ZERO_FLAG)], "amount string, notes string")
    sql = _vals(df, amounts.clean_amount("amount", "notes"))
    assert sql == [Decimal("12.35"), Decimal("-0.01"), None, None, Decimal("0.00")]
    empty = _vals(df, amounts.clean_amount("amount", "notes", null_notes="as_empty"))
    assert empty[3] == Decimal("5.00")


def _dated(spark, *texts, on_error="null", notes=""):
    """transaction_date_clean of the pipeline for raw date texts."""
    raw = tx(spark, *(dict(transaction_id=f"{i:03d}", transaction_date=t, notes=notes) for i, t in enumerate(texts)))
    rows = clean_transactions(raw, on_error=on_error).select("transaction_id", "transaction_date_clean").collect()
    return [r.transaction_date_clean for r in sorted(rows)]


def test_c13_junk_fails_or_nulls(spark):
    raw = tx(spark, dict(amount="abc"))
    with pytest.raises(PySparkException):
        clean_transactions(raw, on_error="fail").select("amount_clean").collect()
    assert clean_transactions(raw, on_error="null").first().amount_clean is None


def test_c14_reversal_sign(spark):
    df = spark.createDataFrame([(Decimal(5), "reversed"), (Decimal(-5), "reversed"), (Decimal(0), "reversed"),
                                (Decimal(5), "completed"), (None, "reversed")], "a decimal(15,2), s string")
    assert _vals(df, amounts.fix_reversal_sign("a", "s")) == [Decimal(-5), Decimal(-5), Decimal(0), Decimal(5), None]


DATE_CASES = [
    ("2024-01-02", dt.date(2024, 1, 2)), ("2024/01/02", dt.date(2024, 1, 2)),
    ("13-02-2024", dt.date(2024, 2, 13)), ("02-13-2024", dt.date(2024, 2, 13)),
    ("03-04-2024", dt.date(2024, 4, 3)), ("02/13/2024", dt.date(2024, 2, 13)),
    ("13/02/2024", dt.date(2024, 2, 13)), ("03/04/2024", dt.date(2024, 4, 3)),
    ("Jan 05 2024", dt.date(2024, 1, 5)), ("jan 05 2024", dt.date(2024, 1, 5)),
    ("05 January, 2024", dt.date(2024, 1, 5)), ("Jan 5 2024", None), ("2024-1-5", None),
    ("2024-01-02\n", None), (None, None),
]


def test_c15_branches(spark):
    assert _dated(spark, *(t for t, _ in DATE_CASES), on_error="fail") == [d for _, d in DATE_CASES]


def test_c15_impossible_dates_fail_or_null(spark):
    bad = ["05 Jan, 2024", "31/02/2024", "13-13-2024"]
    for text_value in bad:
        with pytest.raises(PySparkException):
            _dated(spark, text_value, on_error="fail")
    assert _dated(spark, *bad) == [None] * 3


def test_c15_future_flagged_rows_stay_null(spark):
    assert _dated(spark, "2024-01-02", notes="x | " + FUTURE_FLAG) == [None]


def test_q2a_text_period(spark):
    df = one_col(spark, ["2024-05-01", "2024/05/01", "01/05/2024", "x"])
    assert _vals(df, dates.text_period("v")) == ["2024-05", "2024/05", "2024", "unknown"]


def test_pipeline_order_status_blank_and_reversal(spark):
    raw = tx(spark, dict(transaction_id="1", status=" Reversed ", amount="5.00"),
             dict(transaction_id="2", status="  ", amount="5.00"),
             dict(transaction_id="3", status=None, category="", amount="N/A"))
    got = {r.transaction_id: r for r in clean_transactions(raw).collect()}
    assert got["1"].status == "reversed" and got["1"].amount_clean == Decimal("-5.00")
    assert got["2"].status == "unknown"
    assert got["3"].status == "unknown" and got["3"].category == "Uncategorised"
    assert got["3"].amount_clean is None


def test_notes_null_keeps_amount_null_in_sql_mode(spark):
    raw = tx(spark, dict(transaction_id="1", notes=None, amount="7.00"),
             dict(transaction_id="2", notes=None, amount="7.00", transaction_date="2026-01-01"))
    got = {r.transaction_id: r for r in clean_transactions(raw).collect()}
    assert got["1"].amount_clean is None            # NULL NOT LIKE ... is NULL: not cast
    assert got["2"].notes == FUTURE_FLAG            # flagged first, so the cast sees a note
    assert got["2"].amount_clean == Decimal("7.00")
    assert got["2"].transaction_date_clean is None
    as_empty = {r.transaction_id: r for r in clean_transactions(raw, null_notes="as_empty").collect()}
    assert as_empty["1"].amount_clean == Decimal("7.00")


def test_no_python_udfs_in_cleaning_plan(tables):
    plan = tables.clean._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_dedup_plan_has_one_exchange_and_map_side_step(tables):
    plan = tables.dedup._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert plan.count("Exchange hashpartitioning(transaction_id") == 1


def test_dedup_exchange_is_pruned(tables):
    from ledgerwash.plans import views as V
    plan = V.completion_rate(tables.clean)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    at = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning(transaction_id" in line)
    below = " ".join(lines[at:at + 6])
    assert not any(c in below for c in ("customer_name", "merchant_name", "location", "currency", "account_number"))
    assert "SortAggregate" not in plan


def test_two_branch_report_computes_the_dedup_once(spark):
    from ledgerwash.plans.registry import REGISTRY
    for name in ("v6_flagged_transactions", "q7_running_totals", "q8_sigma_outliers", "k1_kpi_summary"):
        df = REGISTRY[name](spark, "/root/testdata/sf0.001")
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        computed = [line for line in plan.split("\n") if "Exchange hashpartitioning(transaction_id" in line and "Reused" not in line]
        assert len(computed) == 1, name
        assert "ReusedExchange" in plan, name


def test_columns_give_the_same_rows_as_the_window(tables):
    wide = tables.clean
    narrow = tables.clean_columns("customer_id", "amount_clean", "notes")
    assert narrow.columns == ["transaction_id", "customer_id", "amount_clean", "notes"]
    want = wide.select(narrow.columns)
    assert narrow.exceptAll(want).count() == want.exceptAll(narrow).count() == 0


def test_rows_without_arrival_order_raise(spark):
    raw = tx(spark, dict(ingest_seq=None, amount="900.00"), dict(ingest_seq=None, amount="10.00"))
    with pytest.raises(PySparkException, match="no arrival order"):
        clean_transactions(raw).collect()
    with pytest.raises(ValueError, match="no arrival order"):
        clean_transactions(raw.drop("ingest_seq"))


def test_v4_does_not_expand_fact_rows(tables):
    from ledgerwash.plans import views as V
    plan = V.vw_customer_summary(tables.fact, tables.customers)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    expand = next(i for i, line in enumerate(plan) if "Expand" in line)
    assert any("Aggregate [customer_id" in line and "merchant_name" in line for line in plan[expand + 1:])


def test_money_helpers_are_exact(spark):
    from ledgerwash.functions.money import avg2
    df = spark.createDataFrame([(Decimal("0.01"),), (Decimal("0.02"),), (Decimal("0.02"),)], "a decimal(15,2)")
    # 0.05 / 3 = 0.01666.. -> 0.02
    assert df.agg(avg2("a")).collect()[0][0] == Decimal("0.02")
    df2 = spark.createDataFrame([(Decimal("0.01"),), (Decimal("0.02"),)], "a decimal(15,2)")
    # 0.015 exactly -> half away from zero -> 0.02
    assert df2.agg(avg2("a")).collect()[0][0] == Decimal("0.02")
    assert spark.createDataFrame([(Decimal("-0.01"),), (Decimal("-0.02"),)], "a decimal(15,2)") \
        .agg(avg2("a")).collect()[0][0] == Decimal("-0.02")


def test_strict_cast_fails_only_for_kept_rows(spark):
    # The junk copy arrives second, so dedup drops it: no error.
    raw = tx(spark, dict(transaction_id="A", ingest_seq=1, amount="5.00", transaction_date="2024-01-02"),
             dict(transaction_id="A", ingest_seq=2, amount="1,000", transaction_date="31/02/2024"))
    rows = clean_transactions(raw).collect()
    assert [(r.amount_clean, str(r.transaction_date_clean)) for r in rows] == [(Decimal("5.00"), "2024-01-02")]
    # A kept junk amount raises where the typed column is used.
    bad = tx(spark, dict(transaction_id="B", amount="1,000"))
    with pytest.raises(PySparkException):
        clean_transactions(bad).select("amount_clean").collect()
    assert clean_transactions(bad, on_error="null").select("amount_clean").collect()[0][0] is None
    bad_date = tx(spark, dict(transaction_id="C", transaction_date="31/02/2024"))
    with pytest.raises(PySparkException):
        clean_transactions(bad_date).select("transaction_date_clean").collect()


def test_analysis_filters_stay_above_the_dedup(tables):
    from ledgerwash.plans import analysis as Q
    plan = Q.spend_by_category(tables.clean)._jdf.queryExecution().optimizedPlan().toString()
    # The filter on derived columns must not be pushed into the cleaning
    # expressions below the dedup (it would recompute them).
    lines = plan.split("\n")
    filt = next(i for i, l in enumerate(lines) if "Filter" in l and "amount_clean" in l)
    window = next(i for i, l in enumerate(lines) if "Window [row_number" in l)
    assert filt < window
    assert "ZERO AMOUNT — EXCLUDE" not in lines[filt]
