"""Time alignment: floors, windows, guards, leg panels and common-window alignment.

Lags and windows here and elsewhere count rows of a key, in time order; a missing hour is skipped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
DAY_MS = 86_400_000


def floor_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def floor_day(ts: Column) -> Column:
    return F.date_trunc("day", ts)


def bucket(ms: Column | str, width: int) -> Column:
    """Start of the ``width`` ms bucket that holds ``ms``."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    return F.floor(ms / width) * width


def day_of(ms: Column | str) -> Column:
    """UTC day of an epoch-ms column, whatever the session's time zone."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    return F.date_from_unix_date(F.floor(ms / DAY_MS).cast("int"))


class LookAhead(ValueError):
    """Rows later than the cutoff."""


def guard_max_ts(df: DataFrame, cutoff, ts_col: str = "ts") -> DataFrame:
    """``df``, or LookAhead if any row is later than ``cutoff``; one count over the pushed-down filter."""
    late = df.filter(F.col(ts_col) > F.lit(cutoff)).count()
    if late:
        raise LookAhead(f"{late} rows after {cutoff}")
    return df


def ms_window(df: DataFrame, ms_col: str, start: int = 0, end: int = 1 << 62) -> DataFrame:
    """Rows of ``[start, end)``; both bounds reach the scan."""
    return df.filter((F.col(ms_col) >= start) & (F.col(ms_col) < end))


def day_window(df: DataFrame, day_col: str, first, last) -> DataFrame:
    """Rows from ``first`` to ``last``, both days included."""
    return df.filter(F.col(day_col).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def safe_ratio(x: Column, y: Column) -> Column:
    """Null where ``y`` is 0."""
    return F.try_divide(x, y)


def by_time(keys: list[str], time_col: str):
    return Window.partitionBy(*keys).orderBy(time_col)


def leg_panel(spot: DataFrame, perp: DataFrame, funding: DataFrame, keys=("coin",)) -> DataFrame:
    """``(keys, hour, spot, perp, funding_rate)``: spot and perp inner, funding left, absent funding 0."""
    on = [*keys, "hour"]
    legs = perp.select(*on, "perp").join(spot.select(*on, "spot"), on)
    return legs.join(funding.select(*on, "funding_rate"), on, "left").withColumn("funding_rate", F.coalesce("funding_rate", F.lit(0.0)))


def common_days(daily: DataFrame, series: str = "series", day: str = "day", value: str = "ret") -> DataFrame:
    """Rows of the days on which every series has a value; one shuffle, however many series."""
    filled = daily.filter(F.col(value).isNotNull())
    k = filled.agg(F.count_distinct(series).alias("k"))
    full = filled.groupBy(day).agg(F.count_distinct(series).alias("held")).join(F.broadcast(k), F.col("held") == F.col("k")).select(day)
    return filled.join(full, day, "left_semi")


def reindex_to(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` whose keys are in ``other``."""
    return df.join(other.select(*on).distinct(), on, "left_semi")


def outer_fusion(frames: list[DataFrame], on: list[str]) -> DataFrame:
    """Full outer join of several hourly frames."""
    return reduce(lambda a, b: a.join(b, on, "full_outer"), frames)
