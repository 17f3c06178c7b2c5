"""Quarantine: every line is accepted or rejected with file, position and reasons."""

import os
import uuid

import pytest

from ledgerwash.operators.cleaning import clean_transactions
from ledgerwash.session import ensure_checkpoint_dir
from ledgerwash.sources.quarantine import accepted, load_checked, reject_counts, rejects, sort_out
from ledgerwash.sources.schema import RAW_TEXT_COLUMNS

HEADER = ",".join(RAW_TEXT_COLUMNS)
GOOD = "T{0},C1,Ann,AC1,2024-01-02,7.50,NGN,debit,KFC,Food,completed,Lagos,note"


@pytest.fixture
def base(spark):
    path = os.path.join(ensure_checkpoint_dir(spark), f"bad-{uuid.uuid4().hex[:8]}")
    os.makedirs(f"{path}/tx")
    return path


def land(base, name, lines, header=HEADER):
    with open(f"{base}/tx/{name}", "w", encoding="utf-8") as f:
        f.write("\n".join([header, *lines]) + "\n")


def test_reasons_files_and_positions(spark, base):
    land(base, "a.csv", [GOOD.format(1), "T2,C1,Ann", GOOD.format(3).replace("7.50", "7;50"), GOOD.format(4) + ",one,more",
                         GOOD.format(5).replace("2024-01-02", "31/02/2024"), GOOD.format(6).replace("7.50", "x").replace("2024-01-02", "2024-13-40")])
    land(base, "b.csv", [",C9,No id,AC9,2024-01-02,bad,NGN,debit,KFC,Food,completed,Lagos,note", GOOD.format(8).replace("7.50", "N/A"),
                         GOOD.format(9).replace("7.50", "0.00").replace("2024-01-02", "someday"), ",C9,No id,AC9,2024-01-02,1.00,NGN,debit,KFC,Food,completed,Lagos,"])
    sort_out(load_checked(spark, f"{base}/tx"), f"{base}/out")
    got = {(r.file_path.split("/")[-1], r.position): r for r in rejects(spark, f"{base}/out").collect()}
    amount, day = "amount is not a decimal(15,2)", "transaction_date does not exist"
    assert {k: r.reasons for k, r in got.items()} == {
        ("a.csv", 1): ["malformed line"], ("a.csv", 2): [amount], ("a.csv", 3): ["malformed line"], ("a.csv", 4): [day],
        ("a.csv", 5): [amount, day], ("b.csv", 0): [amount]}
    assert got["a.csv", 1]["_line"] == "T2,C1,Ann" and got["a.csv", 1].transaction_id == "T2"
    assert got["a.csv", 2].amount == "7;50" and got["b.csv", 0].transaction_id is None
    kept = accepted(spark, f"{base}/out")
    # N/A, an unknown date layout and a row without an id are sound, as the rules say.
    assert sorted(r.transaction_id or "" for r in kept.collect()) == ["", "T1", "T8", "T9"]
    assert clean_transactions(kept).count() == 4
    assert [(r.file_path.split("/")[-1], r.reason, r["count"]) for r in reject_counts(spark, f"{base}/out").collect()][0][2] == 2


def test_a_broken_first_copy_does_not_hide_a_sound_one(spark, base):
    land(base, "a.csv", [GOOD.format(1).replace("7.50", "broken")])
    os.utime(f"{base}/tx/a.csv", (1, 1))
    land(base, "b.csv", [GOOD.format(1).replace("7.50", "9.00")])
    sort_out(load_checked(spark, f"{base}/tx"), f"{base}/out")
    assert [str(r.amount_clean) for r in clean_transactions(accepted(spark, f"{base}/out")).collect()] == ["9.00"]


def test_null_notes_decide_which_amounts_are_cast(spark, base):
    land(base, "a.csv", [GOOD.format(1).replace("7.50", "bad").removesuffix("note")])
    for null_notes, n in (("sql", 0), ("as_empty", 1)):
        sort_out(load_checked(spark, f"{base}/tx"), f"{base}/{null_notes}", null_notes)
        assert rejects(spark, f"{base}/{null_notes}").count() == n


def test_json_lines_and_no_rows(spark, base):
    with open(f"{base}/tx/a.json", "w") as f:
        f.write('{"transaction_id": "T1", "amount": "1.00", "notes": "n"}\n{"transaction_id": "T2", "amount"\n')
    sort_out(load_checked(spark, f"{base}/tx", "json"), f"{base}/out")
    (bad,) = rejects(spark, f"{base}/out").collect()
    assert bad["_line"] == '{"transaction_id": "T2", "amount"' and bad.position == 1
    assert [r.transaction_id for r in accepted(spark, f"{base}/out").collect()] == ["T1"]
    assert load_checked(spark, f"{base}/tx", "json").where("transaction_id = 'T0'").count() == 0


def test_accepted_and_rejected_are_the_input(spark, base, tables):
    from ledgerwash.plans.registry import REGISTRY
    got = REGISTRY["a3_quarantine"](spark, tables.sf_dir)
    assert got.count() == tables.raw.count()
    reasons = {r.outcome for r in got.select("outcome").distinct().collect()}
    assert {"kept", "malformed line", "amount is not a decimal(15,2)", "transaction_date does not exist"} <= reasons
    assert got.where("transaction_id IS NULL").count() > 0
