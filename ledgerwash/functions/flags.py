"""Flag rules on ``notes`` (C12, C12a, C12b) and the exclusion predicates
every analysis query applies (three-valued, like SQL)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.schema import (FLAG_SEPARATOR, FUTURE_FLAG, FUTURE_MARK, FUTURE_PREFIX_PATTERNS,
                              FUTURE_YEARS, ZERO_AMOUNTS, ZERO_FLAG, ZERO_MARK)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_zero_amount(amount) -> Column:
    return F.trim(_col(amount)).isin(*ZERO_AMOUNTS)


def flag_zero_amount(notes, amount) -> Column:
    """A zero amount overwrites the note with the zero flag."""
    return F.when(is_zero_amount(amount), F.lit(ZERO_FLAG)).otherwise(_col(notes))


def append_flag(notes, flag: str) -> Column:
    """``COALESCE(notes || ' | ', '') || flag``: a NULL note becomes the flag
    alone, an empty note gets a leading separator."""
    return F.concat(F.coalesce(F.concat(_col(notes), F.lit(FLAG_SEPARATOR)), F.lit("")), F.lit(flag))


def flag_future_prefix(notes, date_text) -> Column:
    """The first future-date attempt. LIKE has no character classes, so
    the brackets match only themselves and real dates are never flagged."""
    d = _col(date_text)
    cond = reduce(lambda a, b: a | b, [d.like(p) for p in FUTURE_PREFIX_PATTERNS])
    return F.when(cond, append_flag(notes, FUTURE_FLAG)).otherwise(_col(notes))


def has_future_year(date_text, years=FUTURE_YEARS) -> Column:
    d = _col(date_text)
    return reduce(lambda a, b: a | b, [d.contains(y) for y in years])


def flag_future_dates(notes, date_text, years=FUTURE_YEARS) -> Column:
    """Append the future flag when the raw date text holds one of the
    listed years anywhere."""
    return F.when(has_future_year(date_text, years), append_flag(notes, FUTURE_FLAG)).otherwise(_col(notes))


def not_marked(notes, mark: str) -> Column:
    """``notes NOT LIKE mark OR notes IS NULL``."""
    n = _col(notes)
    return ~n.like(mark) | n.isNull()


def not_zero_flagged(notes="notes") -> Column:
    return not_marked(notes, ZERO_MARK)


def not_future_flagged(notes="notes") -> Column:
    return not_marked(notes, FUTURE_MARK)
