"""Data-quality metrics in the write's own pass.

Each check of ``operators.quality`` is a query of its own: run one by one they clean
the raw table a dozen times. Here they ride on the job that cleans and writes it:

* what needs every arrived row (its copies, its over-long texts) is summed per id in
  the deduplication's own aggregation (``clean_transactions(tally=...)``);
* all metrics are then aggregates over kept rows, which a Spark ``Observation``
  collects in the tasks that write the files.

The observation stands in the last stage on purpose: Spark counts each of that stage's
tasks once, while a stage before a shuffle may run again when an executor is lost, and
would be counted twice. Checks that list values (D1's keys, D3, D7-D11, D13, D14) are
rows, not numbers, and stay queries.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import amounts, flags
from ..functions.money import avg2
from ..sources.schema import REVERSED, TRANSACTION_LENGTH_LIMITS
from ..sources.scratch import beside
from ..sources.sinks import write_clean_fact
from .cleaning import clean_transactions, cleaned_rows

COPIES = "_copies"
_LONG = "_long_"


def tally(limits: dict[str, int] = TRANSACTION_LENGTH_LIMITS) -> dict[str, Column]:
    """What is summed over the copies of an id."""
    longer = {_LONG + c: F.coalesce(F.length(c) > n, F.lit(False)).cast("long") for c, n in limits.items()}
    return {COPIES: F.lit(1).cast("long")} | longer


def metrics(null_notes: str = "sql", limits: dict[str, int] = TRANSACTION_LENGTH_LIMITS) -> dict[str, Column]:
    """``check.metric`` -> aggregate over cleaned rows with their tallies."""
    copies, amount, day = F.col(COPIES), F.col("amount_clean"), F.col("transaction_date_clean")
    # D16 comes before the reversal rule, which is undone by reading the text again.
    read = amounts.clean_amount("amount", "notes", null_notes)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    reverse = F.col("status") == REVERSED
    return {
        "D1.arrived_rows": total(copies),
        "D1.most_copies": F.max(copies),
        "D2.total_duplicate_rows": total(F.when(F.col("transaction_id").isNotNull() & (copies > 1), copies)),
        "D4.total_transactions_remaining": F.count(F.lit(1)),
        "D6.remaining_null_names": F.count_if(F.col("customer_name").isNull()),
        "D6.remaining_null_categories": F.count_if(F.col("category").isNull()),
        "D6.remaining_null_status": F.count_if(F.col("status").isNull()),
        "D12.zero_amount_count": F.count_if(flags.is_zero_amount("amount")),
        "D15.future_dated_rows": F.count_if(F.col("notes").like("%FUTURE DATE%")),
        "D16.rows_with_clean_amount": F.count(read),
        "D16.rows_with_null_amount": F.count(F.lit(1)) - F.count(read),
        "D16.average_transaction": avg2(read),
        "D16.minimum_amount": F.min(read),
        "D16.maximum_amount": F.max(read),
        "D17.count": F.count_if(reverse),
        "D17.total_amount": F.round(F.sum(F.when(reverse, amount)), 2),
        "D18.rows_with_clean_date": F.count(day),
        "D18.rows_still_null": F.count(F.lit(1)) - F.count(day),
    } | {f"A6.{c}": total(_LONG + c) for c in limits}


def tallied(raw: DataFrame, null_notes: str = "sql", on_error: str = "fail") -> DataFrame:
    """The cleaned rows with the tallies of their ids."""
    return clean_transactions(raw, null_notes=null_notes, on_error=on_error, tally=tally())


def watched(rows: DataFrame, observation: Observation, null_notes: str = "sql") -> DataFrame:
    """Tallied rows under observation, without the tallies."""
    return rows.observe(observation, *(c.alias(name) for name, c in metrics(null_notes).items())).drop(*tally())


def write_profiled(raw: DataFrame, path: str, *, null_notes: str = "sql", on_error: str = "fail", mode: str = "overwrite") -> dict[str, Any]:
    """Clean ``raw``, write the fact (``sinks.write_clean_fact``) and return its metrics:
    one scan of ``raw``."""
    seen = Observation("profile")
    with cleaned_rows(raw, beside(path), null_notes=null_notes, on_error=on_error, tally=tally()) as rows:
        write_clean_fact(rows, path, mode, watch=lambda df: watched(df, seen, null_notes))
    return seen.get


class QualityError(AssertionError):
    """A metric is outside its bounds."""


def require(found: dict[str, Any], bounds: dict[str, tuple[float | None, float | None]]) -> None:
    """Raise ``QualityError`` naming every metric outside its (least, most), as a gate
    between the write and the publication of a fact. NULL is outside any bounds."""
    bad = [f"{name} = {found[name]} (allowed: {low} to {high})" for name, (low, high) in bounds.items()
           if found[name] is None or (low is not None and found[name] < low) or (high is not None and found[name] > high)]
    if bad:
        raise QualityError("; ".join(bad))
