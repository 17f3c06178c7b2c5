"""The cleaning pipeline (§2.B) as one ordered list of ``DataFrame ->
DataFrame`` steps.

The order of C2–C15 is part of the semantics: currency is trimmed before the
naira sign is mapped, status is lower-cased before blanks are filled and
before the reversal rule reads it.

C1 (keep the first arrival of every id) is the only shuffle, and reads only
the columns that the report above it needs. The row-wise
steps C2–C15 depend on nothing but the row, and the arrival order reads only
columns they leave untouched, so cleaning every row and then keeping the
first arrival gives the rows of the source order (dedup first, then clean).
Running them map-side, below the dedup, matters for every query:
Catalyst pushes a filter on a derived column (``amount_clean``, ``notes``)
down through projections by inlining their expressions, so a filter placed
above a chain of cleaning projections would recompute the whole chain, many
times over. Above the window the filter reads plain columns.

Strict casts (``on_error="fail"``) keep the source semantics exactly: the
map-side cast is a ``try_`` cast plus an error flag, and only a row that
survives deduplication with its flag set raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import amounts, dates, flags, text
from ..sources.schema import UNCATEGORISED, UNKNOWN_LOCATION, UNKNOWN_NAME, UNKNOWN_STATUS
from ..sources.scratch import deleted, written
from .repeated import repeated, split

# Arrival order first (``ingest_seq`` if the source has one, else ``arrival``,
# the place in the files that ``load_raw`` adds); the rest only breaks ties
# between rows that arrived at the same place, ``k`` being a hash of the row.
DEFAULT_DEDUP_ORDER = ("ingest_seq", "arrival", "amount", "transaction_date", "k")
ARRIVAL = "arrival"


def _order_columns(df: DataFrame, key: str, order) -> list[str]:
    return [c for c in order if c in df.columns and c != key]


def dedup_first(df: DataFrame, key: str = "transaction_id", order=DEFAULT_DEDUP_ORDER) -> DataFrame:
    """Keep the first row of every key value in ``order`` (NULLS LAST; NULL
    keys form one group, like GROUP BY).

    A ``row_number() = 1`` window: Spark puts a group limit before the
    exchange, so a key holding a large share of the rows sends one row per map
    task, and prunes the columns nobody reads above, so a narrow report
    shuffles narrow rows.
    """
    by = Window.partitionBy(key).orderBy(*(F.col(c).asc_nulls_last() for c in _order_columns(df, key, order)))
    return df.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def dedup_first_packed(df: DataFrame, keep, key: str = "transaction_id", order=DEFAULT_DEDUP_ORDER, sums=()) -> DataFrame:
    """C1 for plans that read the kept rows more than once: the columns
    ``keep`` packed into one struct behind the order columns, and its ``min``.
    Pruning cannot tell the branches of the plan apart, so they share one
    exchange of these columns, where the window form would be computed once
    for each set of columns. Columns ``sums`` are added up over all rows of a
    key, the dropped ones too."""
    parts = []
    for i, c in enumerate(_order_columns(df, key, order)):
        parts += [F.col(c).isNull().alias(f"_null_{i}"), F.col(c).alias(f"_ord_{i}")]
    keep = [c for c in keep if c != key]
    first = df.groupBy(key).agg(F.min(F.struct(*parts, *[F.col(c) for c in keep])).alias("_first"),
                                *(F.sum(c).alias(c) for c in sums))
    return first.select(key, *[F.col(f"_first.`{c}`").alias(c) for c in keep], *sums)


def _require_arrival(df: DataFrame) -> DataFrame:
    """Raise for rows without any arrival order: the first arrival could not be
    told, and another column must not decide."""
    known = [F.col(c).isNotNull() for c in ("ingest_seq", ARRIVAL) if c in df.columns]
    if not known:
        raise ValueError("no arrival order: read the rows with load_raw, or add ingest_seq")
    seq = F.col("ingest_seq") if "ingest_seq" in df.columns else F.lit(None).cast("bigint")
    none = F.raise_error(F.lit("a row has no arrival order: read it with load_raw, or fill ingest_seq"))
    return df.withColumn("ingest_seq", F.when(~F.greatest(*known, F.lit(False)), none).otherwise(seq))


@dataclass(frozen=True)
class Step:
    id: str
    name: str
    build: Callable[..., dict] | None  # column -> expression, for row-wise steps


def _row_steps(null_notes: str, on_error: str) -> list[Step]:
    strict = on_error == "fail"
    if on_error not in ("fail", "null"):
        raise ValueError(f"on_error must be 'fail' or 'null', not {on_error!r}")

    def c13():
        out = {"amount_clean": amounts.clean_amount("amount", "notes", null_notes)}
        if strict:
            out[AMOUNT_CAST] = amounts.takes_amount_cast("amount", "notes", null_notes)
        return out

    def c15():
        branch = F.when(flags.not_future_flagged("notes"), dates.date_branch("transaction_date")).otherwise(F.lit(0))
        return {DATE_BRANCH: branch}

    return [
        Step("C2", "fill_null_customer_name", lambda: {"customer_name": text.fill_null("customer_name", UNKNOWN_NAME)}),
        Step("C3", "fill_null_category", lambda: {"category": text.fill_null("category", UNCATEGORISED)}),
        Step("C4", "fill_null_status", lambda: {"status": text.fill_null("status", UNKNOWN_STATUS)}),
        Step("C5", "fill_null_location", lambda: {"location": text.fill_null("location", UNKNOWN_LOCATION)}),
        Step("C6", "currency_upper_trim", lambda: {"currency": text.upper_trim("currency")}),
        Step("C7", "currency_naira_sign", lambda: {"currency": text.currency_code("currency")}),
        Step("C8", "type_lower_trim", lambda: {"transaction_type": text.lower_trim("transaction_type")}),
        Step("C9", "status_lower_trim", lambda: {"status": text.lower_trim("status")}),
        Step("C10a", "squeeze_customer_name", lambda: {"customer_name": text.squeeze_whitespace("customer_name")}),
        Step("C10c", "fill_blank_status", lambda: {"status": text.fill_blank("status", UNKNOWN_STATUS)}),
        Step("C10d", "fill_blank_category", lambda: {"category": text.fill_blank("category", UNCATEGORISED)}),
        Step("C11", "canonical_merchant", lambda: {"merchant_name": text.canonical_merchant("merchant_name")}),
        Step("C12", "flag_zero_amount", lambda: {"notes": flags.flag_zero_amount("notes", "amount")}),
        Step("C12a", "flag_future_prefix", lambda: {"notes": flags.flag_future_prefix("notes", "transaction_date")}),
        Step("C12b", "flag_future_dates", lambda: {"notes": flags.flag_future_dates("notes", "transaction_date")}),
        Step("C13", "clean_amount", c13),
        Step("C14", "fix_reversal_sign", lambda: {"amount_clean": amounts.fix_reversal_sign("amount_clean", "status")}),
        Step("C15", "clean_date", c15),
    ]


AMOUNT_CAST = "_amount_cast"
DATE_BRANCH = "_date_branch"
AMOUNT_ERROR = "_amount_cast_error"
DATE_ERROR = "_date_parse_error"


def _finish_row_steps(df: DataFrame, strict: bool) -> DataFrame:
    """Parse the date with the branch found in C15 and, for strict casts,
    turn the helper columns into error flags (each input is read once)."""
    if DATE_BRANCH in df.columns:
        df = df.withColumn("transaction_date_clean", dates.date_from_branch("transaction_date", DATE_BRANCH))
        if strict:
            df = df.withColumn(DATE_ERROR, (F.col(DATE_BRANCH) > 0) & F.col("transaction_date_clean").isNull())
        df = df.drop(DATE_BRANCH)
    if AMOUNT_CAST in df.columns:
        df = df.withColumn(AMOUNT_ERROR, F.col(AMOUNT_CAST) & F.col("amount_clean").isNull()).drop(AMOUNT_CAST)
    return df


STEP_IDS = ("C1",) + tuple(s.id for s in _row_steps("sql", "fail"))


def _raise_on_errors(df: DataFrame) -> DataFrame:
    """Raise for a kept row whose strict cast would have failed (evaluated
    wherever the typed column is used)."""
    updates = {}
    if AMOUNT_ERROR in df.columns:
        msg = F.concat(F.lit("amount is not a decimal(15,2): "), F.coalesce(F.col("amount"), F.lit("NULL")))
        updates["amount_clean"] = F.when(F.col(AMOUNT_ERROR), F.raise_error(msg)).otherwise(F.col("amount_clean"))
    if DATE_ERROR in df.columns:
        msg = F.concat(F.lit("transaction_date does not exist: "), F.coalesce(F.col("transaction_date"), F.lit("NULL")))
        updates["transaction_date_clean"] = (F.when(F.col(DATE_ERROR), F.raise_error(msg))
                                             .otherwise(F.col("transaction_date_clean")))
    if not updates:
        return df
    return df.withColumns(updates).drop(AMOUNT_ERROR, DATE_ERROR)


def clean_transactions(raw: DataFrame, *, null_notes: str = "sql", on_error: str = "fail",
                       upto: str | None = None, dedup: bool = True, dedup_order=DEFAULT_DEDUP_ORDER,
                       columns=None, tally: dict | None = None) -> DataFrame:
    """Run the pipeline on the raw fact, through step ``upto`` (inclusive;
    default: all). The result keeps every raw column (repaired in place) and
    adds ``amount_clean decimal(15,2)`` and ``transaction_date_clean date``
    once their steps have run; one row per ``transaction_id`` (the first
    arrival) unless ``dedup=False``. Rows without an arrival order raise.

    ``columns``: the columns to return beside the id, for a plan that reads
    the result more than once (Q7, Q8, V6, K1 from raw): they are projected
    between the row rules and the deduplication, and all readers share that
    one shuffle.

    ``tally``: numbers of a raw row by name, which come back summed over all
    copies of an id, the dropped ones too (for ``operators.profile``).

    ``null_notes``: ``"sql"`` (exact three-valued behaviour of the source
    rules) or ``"as_empty"``. ``on_error``: ``"fail"`` (a kept row whose
    amount or date cannot be cast raises) or ``"null"``.
    """
    if upto is not None and upto not in STEP_IDS:
        raise ValueError(f"unknown step {upto!r}; expected one of {STEP_IDS}")
    df = _row_wise(raw, null_notes, on_error, upto, dedup, tally)
    if columns is not None:
        # A typed column needs its error flag, and the raw text to name in the error.
        needs = {"amount_clean": (AMOUNT_ERROR, "amount"), "transaction_date_clean": (DATE_ERROR, "transaction_date")}
        extra = [c for typed, more in needs.items() if typed in columns and more[0] in df.columns for c in more]
        keep = list(dict.fromkeys([*columns, *extra]))
        df = (dedup_first_packed(df, keep, "transaction_id", dedup_order) if dedup
              else df.select("transaction_id", *(c for c in keep if c != "transaction_id")))
        return _raise_on_errors(df).select("transaction_id", *(c for c in columns if c != "transaction_id"))
    if dedup:
        df = _first_arrivals(df, dedup_order, tally)
    return _raise_on_errors(df).drop(ARRIVAL)


@contextmanager
def cleaned_rows(raw: DataFrame, folder: str, *, null_notes: str = "sql", on_error: str = "fail",
                 dedup_order=DEFAULT_DEDUP_ORDER, tally: dict | None = None) -> Iterator[DataFrame]:
    """``clean_transactions`` for a job that writes the rows, all columns of them, and so
    sends them through a shuffle of its own. The rows, cleaned one by one, are written to
    the shared scratch ``folder`` once; of their ids alone is found which come again, and
    only rows of those cross the deduplication's shuffle. The folder is deleted when the
    block ends: write the result inside it."""
    spark = raw.sparkSession
    try:
        rows = written(_row_wise(raw, null_notes, on_error, None, True, tally), f"{folder}/rows")
        once, again = split(rows, repeated(rows, "transaction_id", f"{folder}/again"), "transaction_id")
        yield _raise_on_errors(once.unionByName(_first_arrivals(again, dedup_order, tally))).drop(ARRIVAL)
    finally:
        deleted(spark, folder)


def _row_wise(raw: DataFrame, null_notes: str, on_error: str, upto: str | None, dedup: bool, tally: dict | None) -> DataFrame:
    """What depends on nothing but the row: all arrived rows through step ``upto``."""
    df = _require_arrival(raw) if dedup else raw
    if tally:
        df = df.withColumns(tally)
    if upto == "C1":
        return df
    for step in _row_steps(null_notes, on_error):
        df = df.withColumns(step.build())
        if step.id == upto:
            break
    return _finish_row_steps(df, on_error == "fail")


def _first_arrivals(df: DataFrame, dedup_order, tally: dict | None) -> DataFrame:
    if not tally:
        return dedup_first(df, "transaction_id", dedup_order)
    return dedup_first_packed(df, [c for c in df.columns if c not in tally], "transaction_id", dedup_order, sums=tuple(tally))


def cast_errors(raw: DataFrame, null_notes: str = "sql") -> DataFrame:
    """The raw rows as they are, with two booleans: whether the strict casts of C13
    (``AMOUNT_ERROR``) and C15 (``DATE_ERROR``) would raise for the row."""
    # Beside the repaired columns, not in a struct, which would be built and taken apart for every row.
    df = raw.select("*", *(F.col(f"`{c}`").alias(f"_raw_{c}") for c in raw.columns))
    for step in _row_steps(null_notes, "fail"):
        df = df.withColumns(step.build())
    df = _finish_row_steps(df, strict=True)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return df.select(*(F.col(f"`_raw_{c}`").alias(c) for c in raw.columns), flag(AMOUNT_ERROR), flag(DATE_ERROR))


def clean_customers(raw: DataFrame) -> DataFrame:
    """Squeeze whitespace in ``full_name``; NULL stays NULL."""
    return raw.withColumn("full_name", text.squeeze_whitespace("full_name"))
