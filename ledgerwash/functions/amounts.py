"""Amount rules: text to ``decimal(15,2)`` (C13) and the reversal sign (C14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.schema import AMOUNT_TYPE, NA_AMOUNT, REVERSED, ZERO_MARK


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_amount(amount) -> Column:
    """Trimmed text, ``N/A`` as NULL, to decimal(15,2) rounding half away from
    zero; any other junk is NULL (a strict pipeline raises on it later, see
    ``takes_amount_cast``)."""
    return F.nullif(F.trim(_col(amount)), F.lit(NA_AMOUNT)).try_cast(AMOUNT_TYPE)


def clean_amount(amount, notes, null_notes: str = "sql") -> Column:
    """C13a/C13b. Zero-flagged rows get 0.00; rows whose note does not carry
    the zero flag get the parsed amount.

    ``null_notes="sql"`` keeps SQL three-valued logic: a NULL note makes
    ``notes NOT LIKE ...`` NULL, so such rows are left without an amount.
    ``"as_empty"`` treats a NULL note like ''.
    """
    n = _col(notes)
    if null_notes == "as_empty":
        n = F.coalesce(n, F.lit(""))
    elif null_notes != "sql":
        raise ValueError(f"null_notes must be 'sql' or 'as_empty', not {null_notes!r}")
    zero = n.like(ZERO_MARK)
    return (F.when(zero, F.lit(0).cast(AMOUNT_TYPE))
            .when(~zero, parse_amount(amount))
            .otherwise(F.lit(None).cast(AMOUNT_TYPE)))


def takes_amount_cast(amount, notes, null_notes: str = "sql") -> Column:
    """True where C13 casts the text (the row is not zero-flagged and its
    text is neither NULL nor ``N/A``): a NULL ``amount_clean`` there means
    the strict cast would have raised."""
    n = _col(notes)
    if null_notes == "as_empty":
        n = F.coalesce(n, F.lit(""))
    text = F.nullif(F.trim(_col(amount)), F.lit(NA_AMOUNT))
    return F.coalesce(~n.like(ZERO_MARK), F.lit(False)) & text.isNotNull()


def fix_reversal_sign(amount_clean, status) -> Column:
    """C14: a reversed row with a positive amount becomes negative."""
    a = _col(amount_clean)
    return F.when((_col(status) == REVERSED) & (a > 0), -F.abs(a)).otherwise(a)
