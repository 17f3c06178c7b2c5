"""Text repair rules as pure ``Column -> Column`` functions.

All are built-in expressions, so they stay inside whole-stage codegen and
collapse into one projection with the rest of the pipeline.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.schema import MERCHANT_VARIANTS, NAIRA_CODE, NAIRA_SIGN


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fill_null(c, value: str) -> Column:
    """NULL becomes ``value``; blanks are kept."""
    return F.coalesce(_col(c), F.lit(value))


def fill_blank(c, value: str) -> Column:
    """C10c/C10d: NULL, '' and space-only text become ``value``."""
    c = _col(c)
    return F.when(c.isNull() | (F.trim(c) == ""), F.lit(value)).otherwise(c)


def upper_trim(c) -> Column:
    """Trim spaces (only spaces, like SQL TRIM) and upper-case."""
    return F.trim(F.upper(_col(c)))


def lower_trim(c) -> Column:
    """Trim spaces and lower-case."""
    return F.lower(F.trim(_col(c)))


def currency_code(c) -> Column:
    """C6 then C7: ``ngn``, ``'NGN '`` and the naira sign all become ``NGN``."""
    cleaned = upper_trim(c)
    return F.when(cleaned == NAIRA_SIGN, F.lit(NAIRA_CODE)).otherwise(cleaned)


def squeeze_whitespace(c) -> Column:
    """Every whitespace run becomes one space, then trim.
    NULL stays NULL."""
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def canonical_merchant(c, variants: dict = MERCHANT_VARIANTS) -> Column:
    """C11: map known spellings (compared on lower(trim())) to the canonical
    name; anything else keeps its original, untrimmed text."""
    c = _col(c)
    # One look-up in a constant map: a CASE of comparisons is more code than the JVM compiles.
    known = {}
    for canonical, spellings in variants.items():
        for spelling in spellings:
            known.setdefault(spelling, canonical)
    pairs = F.create_map(*(F.lit(text) for pair in known.items() for text in pair))
    return F.coalesce(F.try_element_at(pairs, F.lower(F.trim(c))), c)
