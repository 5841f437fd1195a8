"""Column expressions shared by the operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNITS = {"s": 1, "min": 60, "h": 3600, "D": 86400}


def freq_seconds(freq: str) -> int:
    """'15min' -> 900."""
    m = re.fullmatch(r"(\d*)(s|min|h|D)", freq)
    if not m:
        raise ValueError(f"unsupported frequency: {freq!r}")
    return int(m.group(1) or 1) * _UNITS[m.group(2)]


def per_day(freq: str) -> int:
    return max(1, round(86400 / freq_seconds(freq)))


def tie_shift(places: int) -> float:
    return 2.5 * 10.0 ** (-places - 3)


def r6(c, places: int = 6) -> Column:
    """Round for reporting; NaN and infinities become NULL, and there is no negative zero.

    Values within a few billionths of a tie go up, so that the order in which a sum was taken does not show.
    """
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(~bad, F.round(c + F.lit(tie_shift(places)), places) + F.lit(0.0))


def share(part, total) -> Column:
    """part/total rounded to 6 places, 0.0 when total is 0."""
    part = F.col(part) if isinstance(part, str) else part
    total = F.col(total) if isinstance(total, str) else total
    return F.when(total > 0, F.round(part / total + F.lit(tie_shift(6)), 6)).otherwise(F.lit(0.0))


def no_nan(c) -> Column:
    """NaN -> NULL (missing values are NULL everywhere in this package)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def to_local(ts, tz: str) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts if tz == "UTC" else F.from_utc_timestamp(ts, tz)


def to_utc(ts, tz: str) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts if tz == "UTC" else F.to_utc_timestamp(ts, tz)


def floor_ts(ts, step: int, tz: str = "UTC") -> Column:
    """Start of the wall-clock interval of `step` seconds that holds `ts`."""
    local = F.unix_seconds(to_local(ts, tz))
    return to_utc(F.timestamp_seconds(F.floor(local / step) * step), tz)


def ceil_ts(ts, step: int, tz: str = "UTC") -> Column:
    """First interval start that is not before `ts`."""
    local = F.unix_micros(to_local(ts, tz))
    return to_utc(F.timestamp_seconds(F.ceil(local / (step * 1_000_000)) * step), tz)


def shift_ts(ts, seconds) -> Column:
    """`ts` moved by a number (or column) of seconds; keeps microseconds."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    seconds = seconds if isinstance(seconds, Column) else F.lit(int(seconds))
    return F.timestamp_micros(F.unix_micros(ts) + seconds.cast("long") * 1_000_000)


def hours_between(later, earlier) -> Column:
    later = F.col(later) if isinstance(later, str) else later
    earlier = F.col(earlier) if isinstance(earlier, str) else earlier
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3_600_000_000.0)


def plain_times(df: DataFrame) -> DataFrame:
    """Instants as zone-free timestamps, for results that leave the engine."""
    return df.select(*[
        F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name)
        if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def bool_or(c: Column) -> Column:
    return F.coalesce(F.bool_or(c), F.lit(False))
