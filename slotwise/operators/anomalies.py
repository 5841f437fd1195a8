"""Anomaly days, change anomalies, candidate search windows and their execution evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_if, r6
from .align import KEYS
from .common import latest, overlap_join, quantiles, top_k
from .quality import previous_row, series_profile


def daily_anomalies(df: DataFrame, per_day: int, kinds: tuple[str, ...] = ("high", "low", "negative"), limit: int = 5, keys: list[str] | None = None, keep=lambda df: df) -> DataFrame:
    """Most unusual days: robust z of the daily mean (median and MAD over days with 80 % of their points)."""
    keys = KEYS if keys is None else keys
    x = df.where(F.col("ts").isNotNull() & F.col("value").isNotNull())
    x = latest(x.select(*keys, "ts", "value", "tie"), [*keys, "ts"], ["tie"])
    d = x.groupBy(*keys, F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("points"), r6(F.min("value")).alias("min"), r6(F.max("value")).alias("max"), F.avg("value").alias("_mean"), count_if(F.col("value") < 0).alias("negative_intervals"))
    d = keep(d.where(F.col("points") >= max(1, int(per_day * 0.8))))
    c = d.join(quantiles(d, keys, "_mean", {"med": .5}).drop("n"), keys).withColumn("_dev", F.abs(F.col("_mean") - F.col("med")))
    c = keep(c)
    z = c.join(quantiles(c, keys, "_dev", {"mad": .5}).drop("n"), keys)
    z = z.withColumn("robust_z", F.when(F.col("mad") == 0, F.lit(0.0)).otherwise(r6((F.col("_mean") - F.col("med")) / (1.4826 * F.col("mad"))))).withColumn("mean", r6("_mean"))
    z = keep(z)
    order = {"high": F.desc("robust_z"), "low": F.asc("robust_z"), "negative": F.desc("negative_intervals")}
    out = None
    for k in kinds:
        src = z.where(F.col("negative_intervals") > 0) if k == "negative" else z
        p = top_k(src, keys, [order[k], F.asc("day")], limit).select(*keys, F.lit(k).alias("kind"), "rank", "day", "points", "min", "max", "mean", "negative_intervals", "robust_z")
        out = p if out is None else out.unionByName(p)
    return out


def change_anomalies(df: DataFrame, market: list[str], sub: list[str], limit: int = 10) -> DataFrame:
    """Largest absolute changes between consecutive values of each sub-series, ranked per market."""
    keys = [*market, *sub]
    x = latest(df.where(F.col("ts").isNotNull() & F.col("value").isNotNull()).select(*keys, "ts", "value", "tie"), [*keys, "ts"], ["tie"])
    p = previous_row(x, keys, ["value"]).where(F.col("prev_value").isNotNull()).withColumn("change", F.col("value") - F.col("prev_value"))
    return top_k(p, market, [F.desc(F.abs("change")), *[F.asc(c) for c in sub], F.asc("ts")], limit).select(
        *market, "rank", *sub, "ts", r6("prev_value").alias("previous_value"), r6("value").alias("value"), r6("change").alias("change"))


def interval_summary(df: DataFrame, keys: list[str], begin: str, end: str, asset: str) -> DataFrame:
    """Counts over an interval table: assets, range, missing ends, ends before starts."""
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min(begin).alias("start_at"), F.max(end).alias("end_at"), count_if(F.col(begin).isNull()).alias("missing_start_rows"),
        count_if(F.col(end).isNull()).alias("missing_end_rows"), count_if(F.col(end) < F.col(begin)).alias("invalid_interval_rows"))
    assets = df.where(F.col(asset).isNotNull()).groupBy(*keys, asset).agg(F.lit(1).alias("_")).groupBy(*keys).agg(F.count(F.lit(1)).alias("distinct_assets"))
    return base.join(assets, keys, "left").na.fill({"distinct_assets": 0})


def start_clusters(df: DataFrame, keys: list[str], begin: str, limit: int = 10) -> DataFrame:
    """Days on which most intervals start."""
    d = df.where(F.col(begin).isNotNull()).groupBy(*keys, F.to_date(begin).alias("day")).agg(F.count(F.lit(1)).alias("plan_count"))
    return top_k(d, keys, [F.desc("plan_count"), F.asc("day")], limit)


def study_summary(df: DataFrame, per_day: int, keep=lambda df: df) -> DataFrame:
    """Profile of every frame of a study with its worst anomaly days alongside."""
    a = daily_anomalies(df, per_day, limit=1, keep=keep).groupBy(*KEYS).agg(
        F.max(F.when(F.col("kind") == "high", F.col("day"))).alias("top_high_day"), F.max(F.when(F.col("kind") == "low", F.col("day"))).alias("top_low_day"),
        F.max(F.when(F.col("kind") == "negative", F.col("day"))).alias("top_negative_day"))
    return series_profile(df, per_day).join(a, KEYS, "left")


def candidate_windows(anomalies: DataFrame, start: str, end: str, event_types: dict[str, str], days: int = 3) -> DataFrame:
    """First anomaly per series and kind inside the study, three days either side, one per day and event type, with a hashed id."""
    etype = F.coalesce(*[F.when(F.col("name") == n, F.lit(e)) for n, e in event_types.items()])
    a = anomalies.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).withColumn("event_type", etype).where(F.col("event_type").isNotNull())
    first = a.groupBy(*KEYS, "kind", "event_type").agg(F.min_by("day", "rank").alias("day"))
    one = first.groupBy("series_id", "day", "event_type").agg(F.min(F.struct("name", "kind")).alias("_o"))
    trigger = F.concat_ws(":", F.col("_o.name"), F.col("day").cast("string"))
    body = F.concat_ws("|", "series_id", "event_type", trigger)
    return one.select("series_id", "day", "event_type", F.col("_o.name").alias("name"), F.col("_o.kind").alias("kind"), F.date_sub("day", days).alias("start_date"), F.date_add("day", days).alias("end_date"),
                      trigger.alias("trigger"), F.substring(F.sha2(body, 256), 1, 16).alias("query_id"))


def attach_execution(windows: DataFrame, log: DataFrame, imported: DataFrame) -> DataFrame:
    """Status of each window from the execution log (query_id, service, returned) and imported counts (query_id, imported)."""
    j = windows.join(log, "query_id", "left").join(imported, "query_id", "left").na.fill({"imported": 0})
    status = (F.when(F.col("service").isNotNull(), "executed").when(F.col("imported") > 0, "results_imported_without_execution_log").otherwise("not_run"))
    return j.withColumn("status", status)


def rejected_log_rows(windows: DataFrame, log: DataFrame) -> DataFrame:
    """Log rows that name an unknown window, repeat one, or carry a bad count or service."""
    dup = log.groupBy("query_id").agg(F.count(F.lit(1)).alias("_k"))
    j = log.join(dup, "query_id").join(windows.select("query_id", F.lit(True).alias("_known")), "query_id", "left")
    reason = (F.when(F.col("_known").isNull(), "unknown query_id").when(F.col("_k") > 1, "duplicate query execution").when(F.col("returned") < 0, "negative result count")
               .when(F.trim("service") == "", "missing search service"))
    return j.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("_k", "_known")


def anomaly_windows(examples: DataFrame, limit: int = 5) -> DataFrame:
    """The highest and lowest extreme times as anomaly windows."""
    return examples.where(F.col("rank") <= limit).select("series_id", "side", "rank", "ts", "value")


def pair_anomalies(windows: DataFrame, events: DataFrame, hours: int = 6) -> DataFrame:
    """Anomaly times with events of the market whose effective start is at most `hours` away."""
    s = F.expr(f"INTERVAL {hours} HOURS")
    spans = events.select("series_id", "event_id", "start_at", (F.col("start_at") - s).alias("_lo"), (F.col("start_at") + s).alias("_hi"))
    j = overlap_join(windows, spans, ["series_id"], "ts", "_lo", "_hi", closed_end=True)
    return j.withColumn("hours_apart", r6((F.unix_micros("start_at") - F.unix_micros("ts")) / 3.6e9)).drop("_lo", "_hi")
