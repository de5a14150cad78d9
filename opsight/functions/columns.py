"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def trunc_ts(unit: str, ts: Column) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def hour_of(ts: Column) -> Column:
    return trunc_ts("hour", ts)


def settled(col: Column | str, digits: int) -> Column:
    """Round half up, as a decimal with nine places.

    A sum of doubles differs in its last bits with the order of its terms; those lie far
    below the ninth place. What is left is one rounding, of the value itself.
    """
    value = F.col(col) if isinstance(col, str) else col
    return F.round(value.cast("decimal(38, 9)"), digits).cast("double")


def pct(part: Column, whole: Column, digits: int) -> Column:
    """``100 * part / whole`` in double, null when the whole is zero or null."""
    ratio = F.try_divide(F.lit(100.0) * part.cast("double"), whole.cast("double"))
    return settled(ratio, digits)


def count_when(cond: Column) -> Column:
    """Rows where ``cond`` holds; 0 (not null) on an empty group."""
    return F.count_if(cond)


def text_or(col: Column, default: str) -> Column:
    return F.coalesce(col.cast("string"), F.lit(default))


def days_between(later: Column, earlier: Column) -> Column:
    """Elapsed days as a fraction."""
    return (micros(later) - micros(earlier)).cast("double") / F.lit(86400e6)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
