"""Closure calendar of a weekday site, and date spines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public holidays as month-day, and the summer shutdown range.
HOLIDAYS = ["01-01", "05-01", "05-08", "07-14", "08-15", "11-01", "11-11", "12-25"]
SHUTDOWN_FIRST, SHUTDOWN_LAST = "08-01", "08-15"


def closure_reason(date: Column) -> Column:
    """Why the site is closed on a date; null when it is open."""
    day = F.date_format(date, "MM-dd")
    return (
        F.when(F.weekday(date) >= 5, "weekend")
        .when(day.isin(*HOLIDAYS), "public holiday")
        .when(day.between(SHUTDOWN_FIRST, SHUTDOWN_LAST), "summer shutdown")
    )


def is_closed(date: Column) -> Column:
    return closure_reason(date).isNotNull()


def next_days(last: Column, days: int) -> Column:
    """Array of the ``days`` dates after ``last``."""
    return F.sequence(F.date_add(last, 1), F.date_add(last, days))
