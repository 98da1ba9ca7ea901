"""Column helpers with the rounding, null and binning rules of the library."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scorecard scaling (points at base odds, odds, points per doubling).
BASE_SCORE = 600
BASE_ODDS = 50.0
POINTS_TO_DOUBLE = 20.0


def half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def ratio(top: Column, bottom: Column, empty: float | None = None) -> Column:
    """``top / bottom``; a zero denominator gives ``empty``."""
    return F.when(bottom != 0, F.try_divide(top, bottom)).otherwise(F.lit(empty))


def percent(part: Column, whole: Column, digits: int) -> Column:
    return half_even(F.try_divide(part, whole) * 100, digits)


def sentinel_to_null(value: Column, sentinel: float | int = -1) -> Column:
    return F.nullif(value, F.lit(sentinel))


def not_blank(value: Column) -> Column:
    return F.coalesce(F.trim(value) != "", F.lit(False))


def differs(value: Column, other: str) -> Column:
    """``!=`` where a null counts as different."""
    return ~F.coalesce(value == other, F.lit(False))


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def in_month(ts: Column, month: str) -> Column:
    """Range predicate for a YYYY-MM month, so that it reaches the scan."""
    first = F.to_timestamp_ntz(F.lit(f"{month}-01 00:00:00"))
    return (ts >= first) & (ts < first + F.expr("INTERVAL 1 MONTH"))


def whole_cases(quantity: Column, per_case: Column, minimum: Column) -> Column:
    per = F.greatest(F.coalesce(F.nullif(per_case, F.lit(0)), F.lit(1)), F.lit(1))
    least = F.coalesce(F.nullif(minimum, F.lit(0)), F.lit(1))
    return F.greatest(F.ceil(quantity / per), least).cast("bigint")


def label_upto(value: Column, bands: Sequence[tuple[float, str]], above: str) -> Column:
    """Right-closed bins: the first label whose bound is >= value."""
    chain = None
    for bound, label in bands:
        chain = (F if chain is None else chain).when(value <= bound, label)
    return chain.otherwise(above)


def label_below(value: Column, bands: Sequence[tuple[float, str]], above: str) -> Column:
    """The first label whose threshold is strictly greater than value."""
    chain = None
    for bound, label in bands:
        chain = (F if chain is None else chain).when(value < bound, label)
    return chain.otherwise(above)


def mapped(value: Column, table: Mapping[str, object], default: object) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), value), F.lit(default))


def score_points(probability: Column) -> Column:
    """Default probability to scorecard points; higher is safer."""
    factor = POINTS_TO_DOUBLE / math.log(2)
    offset = BASE_SCORE - factor * math.log(BASE_ODDS)
    p = clip(probability, 1e-6, 1 - 1e-6)
    return F.rint(F.lit(offset) + F.lit(factor) * F.log((1 - p) / p)).cast("bigint")


def hours_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("SECOND", earlier, later) / 3600.0


def contains_fold(haystack: Column, needle: Column | str) -> Column:
    """Case-insensitive substring test; null haystacks do not match."""
    text = F.lit(needle) if isinstance(needle, str) else needle
    return F.coalesce(F.contains(F.lower(haystack), F.lower(text)), F.lit(False))
