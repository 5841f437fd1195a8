"""Business-clock source tables: slicing as of a cutoff, normalization, versions, refresh and expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_if, freq_seconds, shift_ts
from ..operators.align import KEYS
from ..operators.common import latest


def business_ts(day, hour, minute) -> Column:
    """Settlement time of a business clock: hour 24 rolls over, an impossible clock is NULL."""
    day, hour, minute = (F.col(c) if isinstance(c, str) else c for c in (day, hour, minute))
    ok = hour.between(0, 24) & minute.between(0, 59) & ~((hour == 24) & (minute != 0))
    return F.when(ok, shift_ts(day.cast("timestamp"), (hour * 60 + minute) * 60))


def text_ts(day, clock) -> Column:
    """Settlement time of a day and an 'HH:MM' text; '24:00' is the next midnight."""
    clock = F.col(clock) if isinstance(clock, str) else clock
    parts = F.split(F.trim(clock), ":")
    part = lambda j: F.get(parts, F.lit(j)).try_cast("int")
    return F.when(F.size(parts) == 2, business_ts(day, part(0), part(1)))


def with_business_time(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", business_ts("ts_day", "hour", "min"))


def source_slice(df: DataFrame, province: str, types: list[str], start: str, end: str, cutoff: str, future: bool = False) -> DataFrame:
    """Rows one market could read at `cutoff`. The bare-column predicates reach the scan; business time is checked after it."""
    s = df.where((F.col("province") == province) & F.col("type").isin(*types) & (F.col("ts_day") >= F.lit(start).cast("date"))
                 & (F.col("ts_day") <= F.lit(end).cast("date")) & (F.col("create_time") <= F.lit(cutoff).cast("timestamp")))
    s = with_business_time(s)
    return s if future else s.where(F.col("ts") <= F.lit(cutoff).cast("timestamp"))


def multi_series_scan(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Name every row by the catalog (type -> name, series_id): one scan however many series share the table."""
    return df.join(catalog, "type")


def normalize_series(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Complete rows only, newest version per timestamp (largest available_at, then `tie`)."""
    keys = KEYS if keys is None else keys
    good = df.where(F.col("ts").isNotNull() & F.col("value").isNotNull() & F.col("available_at").isNotNull())
    return latest(good, [*keys, "ts"], ["available_at", "tie"])


def series_detail(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Source rows, usable rows and times, range, duplicate and invalid rows per series."""
    keys = KEYS if keys is None else keys
    bad = F.col("ts").isNull() | F.col("value").isNull() | F.col("available_at").isNull()
    per_ts = df.groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("_all"), count_if(~bad).alias("_good"))
    return per_ts.groupBy(*keys).agg(
        F.sum("_all").alias("source_rows"), F.sum("_good").alias("usable_rows"), count_if(F.col("_good") > 0).alias("usable_times"),
        F.min(F.when(F.col("_good") > 0, F.col("ts"))).alias("start_at"), F.max(F.when(F.col("_good") > 0, F.col("ts"))).alias("end_at"),
        F.sum(F.when(F.col("_good") > 1, F.col("_good")).otherwise(0)).alias("duplicate_rows"), F.sum(F.col("_all") - F.col("_good")).alias("invalid_rows"))


def combine_series(long: DataFrame, names: list[str]) -> DataFrame:
    """One row per time with a column per series; the row is available when its last part is."""
    return long.groupBy("series_id", "ts").agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names], F.max("available_at").alias("available_at"))


def combine_first(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Field by field: the first frame's value, the second's where it has none. `filled` marks times only the second has."""
    l = a.select(*keys, F.lit(True).alias("_l"), *[F.col(c).alias(f"_l_{c}") for c in [*fields, "available_at"]])
    r = b.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in [*fields, "available_at"]])
    return l.join(r, keys, "full").select(
        *keys, *[F.coalesce(f"_l_{c}", f"_r_{c}").alias(c) for c in fields], F.coalesce("_l_available_at", "_r_available_at").alias("available_at"),
        F.col("_l").isNull().alias("filled"))


def merge_incremental(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Refresh: a new value wins per cell, the old one stays where the new is NULL; availability is the later one."""
    o = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in [*fields, "available_at"]])
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in [*fields, "available_at"]])
    return o.join(n, keys, "full").select(*keys, *[F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in fields],
                                          F.greatest("_o_available_at", "_n_available_at").alias("available_at"))


def normalize_weather(df: DataFrame, fields: list[str], keys: list[str] | None = None) -> DataFrame:
    """Newest version per weather hour; fields may be NULL, times may not."""
    keys = ["series_id"] if keys is None else keys
    good = df.where(F.col("ts").isNotNull() & F.col("available_at").isNotNull())
    return latest(good.select(*keys, "ts", "available_at", "tie", *fields), [*keys, "ts"], ["available_at", "tie"]).drop("tie")


def _spread(df: DataFrame, freq: str, first: int, last: int) -> DataFrame:
    step = freq_seconds(freq)
    t = F.unix_seconds("ts")
    slots = F.sequence(t + F.lit(first), t + F.lit(last), F.lit(step).cast("long"))
    return df.withColumn("ts", F.explode(F.transform(slots, F.timestamp_seconds)))


def expand_hour_starting(df: DataFrame, freq: str) -> DataFrame:
    """Repeat an hourly row over the slots of its own hour only."""
    return _spread(df, freq, 0, 3600 - freq_seconds(freq))


def expand_hour_ending(df: DataFrame, freq: str) -> DataFrame:
    """Spread an hour-ending row over the slots that end with it."""
    return _spread(df, freq, freq_seconds(freq) - 3600, 0)


def profile_table(df: DataFrame, keys: list[str], cutoff: str | None = None) -> DataFrame:
    """Row, time, clock and creation-range counts of a business-clock table, optionally as of a cutoff."""
    df = with_business_time(df)
    if cutoff is not None:
        at = F.lit(cutoff).cast("timestamp")
        df = df.where((F.col("create_time") <= at) & (F.col("ts") <= at))
    h, m = F.col("hour"), F.col("min")
    invalid = (h < 0) | (h > 24) | (m < 0) | (m >= 60) | ((h == 24) & (m != 0))
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows_total"), F.min("ts").alias("min_time"), F.max("ts").alias("max_time"),
        count_if(F.col("ts_day").isNull()).alias("null_time"), count_if(h == 24).alias("hour_24_rows"), count_if(invalid).alias("invalid_clock_rows"),
        F.min("create_time").alias("min_created_at"), F.max("create_time").alias("max_created_at"))
    times = df.where(F.col("ts").isNotNull()).groupBy(*keys, "ts").agg(F.lit(1).alias("_")).groupBy(*keys).agg(F.count(F.lit(1)).alias("distinct_times"))
    return counts.join(times, keys, "left").na.fill({"distinct_times": 0})


def load_frames(df: DataFrame, wanted: dict[str, tuple[str, str]], cutoff: str) -> DataFrame:
    """Named analysis frames (name -> province, type) as of a cutoff, as one long frame from one scan."""
    at = F.lit(cutoff).cast("timestamp")
    name = F.coalesce(*[F.when((F.col("province") == p) & (F.col("type") == k), F.lit(n)) for n, (p, k) in wanted.items()])
    s = with_business_time(df.withColumn("name", name).where(F.col("name").isNotNull() & (F.col("create_time") <= at)))
    return s.where(F.col("ts") <= at).select("name", "ts", F.col("quantity").alias("value"), F.col("create_time").alias("available_at"))
