"""US federal business calendar as row-local expressions.

Every question (is this a holiday, the next business day, a contract expiry) is
answered from the date itself, so no calendar table is built or joined.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# (month, day, first year) of fixed-date holidays and (month, n-th, weekday, first year) of the floating
# ones; weekday counts from Sunday = 1 and n = -1 is the last one. Fixed values.
FIXED = ((1, 1, 1), (6, 19, 2021), (7, 4, 1), (11, 11, 1), (12, 25, 1))
FLOATING = ((1, 3, 2, 1986), (2, 3, 2, 1), (5, -1, 2, 1), (9, 1, 2, 1), (10, 2, 2, 1), (11, 4, 5, 1))


def _either(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def is_holiday(d: Column) -> Column:
    """Observed federal holiday: Saturday dates move to Friday, Sunday dates to Monday."""
    dow = F.dayofweek(d)
    # the calendar date whose observance would fall on d
    actual = [(d, dow.between(2, 6)), (F.date_add(d, 1), dow == 6), (F.date_sub(d, 1), dow == 2)]
    parts = []
    for m, day, since in FIXED:
        for a, when in actual:
            parts.append(when & (F.month(a) == m) & (F.dayofmonth(a) == day) & (F.year(a) >= since))
    for m, nth, weekday, since in FLOATING:
        week = F.dayofmonth(d) > 24 if nth < 0 else F.ceil(F.dayofmonth(d) / 7.0) == nth
        parts.append((F.month(d) == m) & (dow == weekday) & week & (F.year(d) >= since))
    return _either(parts)


def is_business_day(d: Column) -> Column:
    return F.dayofweek(d).between(2, 6) & ~is_holiday(d)


def _days(a: Column, b: Column) -> Column:
    return F.sequence(a, b)


def next_business_day(d: Column) -> Column:
    """d itself when open, else the first open day after it."""
    return F.get(F.filter(_days(d, F.date_add(d, 9)), is_business_day), F.lit(0))


def business_day_back(d: Column, n: int) -> Column:
    """n business days before d, counting from d or, when closed, from the open day before it."""
    return F.element_at(F.filter(_days(F.date_sub(d, 9 + 2 * n), d), is_business_day), -(n + 1))


def report_release(d: Column, lag_days: int = 3) -> Column:
    """Release date of a weekly report dated d (Tuesday).

    Friday of that week, a day later when a holiday lies between Monday and
    Friday, then rolled to the next open day.
    """
    friday = F.date_add(d, lag_days)
    late = F.exists(_days(F.date_sub(d, 1), friday), is_holiday)
    return next_business_day(F.date_add(friday, late.cast("int")))


def contract_expiry(month: Column) -> Column:
    """Three business days before the 25th of the month."""
    return business_day_back(F.date_add(F.trunc(month, "MM"), 24), 3)


def rolls_between(prev: Column, d: Column) -> Column:
    """Does a contract expire on or after `prev` and before `d` (so that d is the first day after it)?"""
    months = F.sequence(F.trunc(prev, "MM"), F.trunc(d, "MM"), F.expr("interval 1 month"))
    return F.exists(months, lambda m: contract_expiry(m).between(prev, F.date_sub(d, 1)))
