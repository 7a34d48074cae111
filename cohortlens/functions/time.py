"""Time expressions.

Dates are counted in whole calendar days (midnights crossed); years are days / 365.25
as DOUBLE, since an untyped 365.25 literal is a DECIMAL and would truncate the quotient.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def days_between(end: str | Column, start: str | Column) -> Column:
    return F.datediff(col(end).cast("date"), col(start).cast("date"))


def day_number(t: str | Column) -> Column:
    """Days since 1970-01-01 as INT."""
    return F.unix_date(col(t).cast("date"))


def years(days: str | Column) -> Column:
    return col(days).cast("double") / F.lit(DAYS_PER_YEAR)
