"""Look-back windows with an explicit ``as_of`` in place of the wall clock."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts_lit(value: datetime) -> Column:
    """A foldable zone-free literal, so comparisons still push down to the scan."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


@dataclass(frozen=True)
class Lookback:
    """``days`` before ``as_of``; exact instants or whole days, as the caller picks."""

    as_of: datetime
    days: int

    @property
    def start(self) -> datetime:
        return self.as_of - timedelta(days=self.days)

    @property
    def midnight(self) -> datetime:
        day = self.as_of.replace(hour=0, minute=0, second=0, microsecond=0)
        return day - timedelta(days=self.days)

    def since(self, ts: Column) -> Column:
        """At or after the start instant, no upper bound."""
        return ts >= ts_lit(self.start)

    def within(self, ts: Column) -> Column:
        """Half-open ``[start, as_of)``."""
        return (ts >= ts_lit(self.start)) & (ts < ts_lit(self.as_of))

    def since_midnight(self, ts: Column) -> Column:
        """At or after the first midnight of the window."""
        return ts >= ts_lit(self.midnight)

    def since_date(self, day: Column) -> Column:
        return day >= F.lit(self.midnight.date())
