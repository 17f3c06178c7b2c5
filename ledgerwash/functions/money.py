"""Exact money aggregates and shares.

``avg`` of ``decimal(15,2)`` in Spark is ``decimal(19,6)``; rounding that to
two places rounds twice. These helpers divide the exact decimal sum by the
count instead (quotient scale 15) and round once, half away from zero, like
``ROUND(AVG(numeric), 2)`` in SQL.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sum2(c) -> Column:
    return F.round(F.sum(_col(c)), 2)


def exact_avg(c) -> Column:
    """Unrounded average as an exact decimal quotient; NULL for no rows."""
    c = _col(c)
    return F.sum(c) / F.nullif(F.count(c), F.lit(0))


def avg2(c) -> Column:
    return F.round(exact_avg(c), 2)


def ratio2(numerator, denominator) -> Column:
    """round(numerator / denominator, 2); NULL when the denominator is 0."""
    return F.round(_col(numerator) / F.nullif(_col(denominator), F.lit(0)), 2)


def share_of_total(c) -> Column:
    """``ROUND(c * 100.0 / SUM(c) OVER (), 2)`` on an already grouped
    result: the window runs over the group rows only. A zero grand total
    gives NULL shares (not a division error)."""
    c = _col(c)
    total = F.sum(c).over(Window.partitionBy())
    return F.round(c * F.lit(Decimal("100.0")) / F.nullif(total, F.lit(0)), 2)


def cents(c) -> Column:
    """A decimal(15,2) amount as a whole number of hundredths."""
    return (_col(c) * 100).cast("decimal(17,0)")


def moment_sums(c) -> tuple[Column, Column, Column]:
    """Count, sum and sum of squares of the cents of ``c``, exact: they add up in any
    order and over any parts. The last is NULL beyond 38 digits."""
    x = cents(c)
    return F.count(_col(c)), F.sum(x), F.try_sum((x * x).cast("decimal(34,0)"))


def stddev_from(n, s1, s2) -> Column:
    """Sample standard deviation from ``moment_sums`` (NULL for fewer than two rows):
    the numerator n * s2 - s1 * s1 is exact, so rows cancel without error, and is
    rounded once for one division and one square root. Beyond 38 digits it is taken
    from the exact sums in double precision."""
    n, s1, s2 = _col(n), _col(s1), _col(s2)
    wide = "decimal(38,0)"
    exact = F.try_subtract(F.try_multiply(n.cast(wide), s2.cast(wide)), F.try_multiply(s1.cast(wide), s1.cast(wide))).cast("double")
    count, total = n.cast("double"), s1.cast("double")
    about = F.greatest(count * s2.cast("double") - total * total, F.lit(0.0))
    return F.when(n > 1, F.sqrt(F.coalesce(exact, about) / (count * (count - 1))) / 100)


def exact_stddev_samp(c) -> Column:
    """``stddev_samp`` of a decimal(15,2) that does not depend on the order in which
    rows or parts of them are added up."""
    return F.coalesce(stddev_from(*moment_sums(c)), F.when(F.count(_col(c)) > 1, F.stddev_samp(_col(c))))
