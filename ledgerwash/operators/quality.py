"""Data-quality inspection operators.

Each is one or two aggregations; grouped results are small (one row per
distinct value), so sorting them is cheap. Nothing here collects rows to
the driver: the checks return DataFrames, and the assertions run a
``limit(1)`` probe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import flags
from ..functions.money import avg2
from ..sources.schema import FUTURE_YEARS, REVERSED


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- duplicates (D1–D5, A5) -------------------------------------------------

def key_counts(df: DataFrame, key: str, count_name: str = "occurrences") -> DataFrame:
    """Rows per key value (partial aggregation map-side, so a hot key costs
    one row per map task in the shuffle)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(count_name))


def duplicate_keys(df: DataFrame, key: str = "transaction_id", n: int | None = 20,
                   count_name: str = "occurrences") -> DataFrame:
    """D1 (and D5 with ``n=None`` on deduplicated data): keys seen more
    than once, most frequent first; ties by key so the top ``n`` is stable."""
    out = key_counts(df, key, count_name).filter(F.col(count_name) > 1)
    out = out.orderBy(F.col(count_name).desc_nulls_first(), F.col(key).asc_nulls_last())
    return out.limit(n) if n is not None else out


def duplicate_row_count(df: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Rows whose key occurs more than once. A NULL key never matches
    ``IN (...)``, so NULL keys are not counted."""
    counts = key_counts(df.filter(F.col(key).isNotNull()), key, "_n")
    return counts.filter(F.col("_n") > 1).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("total_duplicate_rows"))


DUPLICATE_ROW_COLUMNS = ("transaction_id", "customer_id", "amount", "transaction_date",
                         "merchant_name", "notes")


def duplicate_rows(df: DataFrame, key: str = "transaction_id", n: int = 20,
                   columns=DUPLICATE_ROW_COLUMNS, tie_break=("ingest_seq", "k")) -> DataFrame:
    """D3: the first ``n`` rows (by key) of keys that occur more than once.

    Only the ``n`` smallest duplicated keys can contribute, so only those go
    to the semi join; the full duplicate key set is never joined back.
    """
    dup = key_counts(df.filter(F.col(key).isNotNull()), key, "_n").filter(F.col("_n") > 1)
    first_keys = dup.select(key).orderBy(F.col(key).asc()).limit(n)
    rows = df.join(first_keys, key, "left_semi")
    order = [F.col(key).asc_nulls_last()] + [F.col(c).asc_nulls_last() for c in tie_break if c in df.columns]
    return rows.orderBy(*order).limit(n).select(*columns)


def row_count(df: DataFrame, name: str = "total_transactions_remaining") -> DataFrame:
    """D4."""
    return df.agg(F.count(F.lit(1)).alias(name))


def assert_unique(df: DataFrame, key: str) -> None:
    """Raise if any key value occurs twice (probes one row only)."""
    bad = duplicate_keys(df, key, n=1).collect()
    if bad:
        raise AssertionError(f"{key} is not unique, e.g. {bad[0][key]!r} occurs {bad[0]['occurrences']} times")


def length_violations(df: DataFrame, limits: dict) -> DataFrame:
    """For each column with a declared length, how many values are
    longer than it. One pass; the per-column counts are unpivoted to
    ``(column_name, max_length, violations)``."""
    aggs = [F.count_if(F.length(F.col(c)) > F.lit(n)).alias(c) for c, n in limits.items()]
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{c}', {n}, `{c}`" for c, n in limits.items())
    return wide.selectExpr(f"stack({len(limits)}, {pairs}) AS (column_name, max_length, violations)")


# -- NULLs, distinct values, frequencies (D6–D11) ----------------------------

def null_counts(df: DataFrame, columns: dict) -> DataFrame:
    """One row, ``alias -> number of NULLs in column`` for all columns in
    one pass."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(alias) for alias, c in columns.items()])


def distinct_values(df: DataFrame, column: str, sort: bool = False) -> DataFrame:
    """D7/D8."""
    out = df.select(column).distinct()
    return out.orderBy(F.col(column).asc_nulls_last()) if sort else out


def distinct_with_length(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with their character length (shows blanks)."""
    return (df.select(F.col(column), F.length(F.col(column)).alias("char_length")).distinct()
            .orderBy(F.col(column).asc_nulls_last()))


def value_frequency(df: DataFrame, column: str, count_name: str = "transaction_count",
                    order: str = "value") -> DataFrame:
    """D10 (``order="value"``) and D11 (``order="count"``: rare first)."""
    out = df.groupBy(column).agg(F.count(F.lit(1)).alias(count_name))
    if order == "value":
        return out.orderBy(F.col(column).asc_nulls_last())
    if order == "count":
        return out.orderBy(F.col(count_name).asc(), F.col(column).asc_nulls_last())
    raise ValueError(order)


# -- flags (D12–D15) ----------------------------------------------------------

def zero_amount_count(df: DataFrame) -> DataFrame:
    """D12."""
    return df.agg(F.count_if(flags.is_zero_amount("amount")).alias("zero_amount_count"))


def flag_sample(df: DataFrame, mark: str = "%FUTURE DATE%", n: int = 10) -> DataFrame:
    """A few flagged rows. The source takes any ``n``; ordering by id
    makes the sample repeatable."""
    return (df.filter(F.col("notes").like(mark))
            .select("transaction_id", "transaction_date", "notes")
            .orderBy("transaction_id").limit(n))


def future_date_preview(df: DataFrame, years=FUTURE_YEARS) -> DataFrame:
    """Raw date texts holding a future year, with counts."""
    return (df.filter(flags.has_future_year("transaction_date", years))
            .groupBy("transaction_date").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("transaction_date").asc_nulls_last()))


def flag_count(df: DataFrame, mark: str = "%FUTURE DATE%", name: str = "future_dated_rows") -> DataFrame:
    """D15."""
    return df.agg(F.count_if(F.col("notes").like(mark)).alias(name))


# -- typed-column profiles (D16–D18) -----------------------------------------

def amount_profile(df: DataFrame) -> DataFrame:
    """D16."""
    a = F.col("amount_clean")
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count(a).alias("rows_with_clean_amount"),
        (F.count(F.lit(1)) - F.count(a)).alias("rows_with_null_amount"),
        avg2(a).alias("average_transaction"),
        F.min(a).alias("minimum_amount"),
        F.max(a).alias("maximum_amount"),
    )


def reversal_profile(df: DataFrame) -> DataFrame:
    """D17."""
    return (df.filter(F.col("status") == REVERSED).groupBy("status")
            .agg(F.count(F.lit(1)).alias("count"), F.round(F.sum("amount_clean"), 2).alias("total_amount")))


def date_coverage(df: DataFrame) -> DataFrame:
    """D18."""
    d = F.col("transaction_date_clean")
    return df.agg(F.count(F.lit(1)).alias("total_rows"), F.count(d).alias("rows_with_clean_date"),
                  (F.count(F.lit(1)) - F.count(d)).alias("rows_still_null"))

