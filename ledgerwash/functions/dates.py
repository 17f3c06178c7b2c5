"""Date standardisation (C15): ten ordered, guarded branches; the first
branch whose pattern (and day/month guard) matches parses the text."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.schema import DATE_BRANCHES


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def date_branch(date_text, branches=DATE_BRANCHES) -> Column:
    """1-based number of the first branch whose pattern (and guard) matches
    the text, 0 for none. The layouts are mutually exclusive and a later
    branch never parses a text an earlier matching branch rejects, so
    parsing with this one branch equals the ordered ``coalesce``.

    Neighbouring branches of one pattern match it once. The regex guarantees
    digits where a guard casts a split part, so the cast cannot fail."""
    d = _col(date_text)
    expr = F
    for regex, group in groupby(enumerate(branches, start=1), key=lambda branch: branch[1][1]):
        number = F
        for i, (_name, _regex, sep, part, _pattern, _drop_commas) in group:
            guard = F.lit(True) if sep is None else F.substring_index(F.substring_index(d, sep, part), sep, -1).try_cast("int") > 12
            number = number.when(guard, F.lit(i))
        # A text that passes none of the guards is left to the patterns that follow.
        expr = expr.when(d.rlike(regex), number) if sep is None else expr.when(d.rlike(regex) & number.isNotNull(), number)
    return expr.otherwise(F.lit(0))


#: Layouts of digits only, and the places of their year, month and day (from 1).
_DIGITS = {"yyyy-MM-dd": (1, 6, 9), "yyyy/MM/dd": (1, 6, 9), "dd-MM-yyyy": (7, 4, 1), "MM-dd-yyyy": (7, 1, 4),
           "MM/dd/yyyy": (7, 1, 4), "dd/MM/yyyy": (7, 4, 1)}


def date_from_branch(date_text, branch, branches=DATE_BRANCHES) -> Column:
    """Parse the text with the layout of branch number ``branch`` (a column
    from ``date_branch``); NULL for 0 or when that date does not exist.

    Layouts of digits are put in ISO order and cast, once for all of them; month
    names need a formatter each."""
    d, b = _col(date_text), _col(branch)
    places, formats = {}, {}
    for i, (_name, _regex, _sep, _part, pattern, drop_commas) in enumerate(branches, start=1):
        if pattern in _DIGITS and not drop_commas:
            places.setdefault(_DIGITS[pattern], []).append(i)
        else:
            formats.setdefault((pattern, drop_commas), []).append(i)
    expr = F
    for (pattern, drop_commas), numbers in formats.items():
        expr = expr.when(b.isin(numbers), F.try_to_date(F.replace(d, F.lit(","), F.lit("")) if drop_commas else d, pattern))
    if places:
        iso = F
        for (year, month, day), numbers in places.items():
            iso = iso.when(b.isin(numbers), F.concat_ws("-", d.substr(year, 4), d.substr(month, 2), d.substr(day, 2)))
        expr = expr.otherwise(iso.try_cast("date"))
    return expr


def text_period(date_text) -> Column:
    """A rough period from the raw text: ``YYYY-MM``/``YYYY/MM`` when
    the text starts with a year, else a trailing four-digit year, else
    ``unknown``."""
    d = _col(date_text)
    return (F.when(d.rlike(r"^\d{4}[-/]"), F.substring(d, 1, 7))
            .when(d.rlike(r"\d{4}\z"), d.substr(F.length(d) - 3, F.lit(4)))
            .otherwise(F.lit("unknown")))
