"""Series quality: intervals, availability, reports, issues, gates and grid validation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_if, floor_ts, hours_between, r6, share
from .align import KEYS, MarketClock, coverage
from .common import quantiles, top_k
from .target import iqr_outliers


def previous_row(df: DataFrame, keys: list[str], cols: list[str], bucket_seconds: int = 30 * 86400) -> DataFrame:
    """Add `prev_<col>`: the row before in time, found inside its time bucket or from the last row of an earlier one."""
    base = df.withColumn("_b", F.floor(F.unix_seconds("ts") / bucket_seconds))
    w = Window.partitionBy(*keys, "_b").orderBy("ts")
    rows = base.withColumn("_p", F.lag(F.struct(*cols)).over(w))
    ends = base.groupBy(*keys, "_b").agg(F.max_by(F.struct(*cols), "ts").alias("_e"))
    ends = ends.select(*keys, "_b", F.lag("_e").over(Window.partitionBy(*keys).orderBy("_b")).alias("_c"))
    j = rows.join(ends, [*keys, "_b"])
    return j.select(*df.columns, *[F.coalesce(F.col(f"_p.{c}"), F.col(f"_c.{c}")).alias(f"prev_{c}") for c in cols])


def intervals(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """How often each gap between distinct times occurs: (keys, seconds, occurrences)."""
    keys = KEYS if keys is None else keys
    times = df.where(F.col("ts").isNotNull()).select(*keys, "ts").distinct()
    p = previous_row(times, keys, ["ts"]).where(F.col("prev_ts").isNotNull())
    gap = F.round((F.unix_micros("ts") - F.unix_micros("prev_ts")) / 1e6, 6)
    return p.groupBy(*keys, gap.alias("seconds")).agg(F.count(F.lit(1)).alias("occurrences"))


def modal_interval(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Most frequent gap between distinct times, the shorter one on ties."""
    keys = KEYS if keys is None else keys
    return intervals(df, keys).groupBy(*keys).agg(F.min_by("seconds", F.struct(-F.col("occurrences"), F.col("seconds"))).alias("modal_seconds"))


def availability_metrics(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Hours from observation to availability: median, max, share after the observation."""
    keys = KEYS if keys is None else keys
    x = df.where(F.col("ts").isNotNull() & F.col("available_at").isNotNull()).withColumn("_h", hours_between("available_at", "ts"))
    base = x.groupBy(*keys).agg(r6(F.max("_h")).alias("max_availability_lag_hours"), share(count_if(F.col("_h") > 0), F.count(F.lit(1))).alias("available_after_rate"))
    return base.join(quantiles(x, keys, "_h", {"m": .5}).select(*keys, r6("m").alias("median_availability_lag_hours")), keys)


def series_quality(evidence: DataFrame, loaded: DataFrame, aligned: DataFrame, specs: DataFrame, freq: str) -> DataFrame:
    """One profile row per series from load evidence, raw times and the aligned grid.

    `specs`: keys, path, unit, availability_type, availability_present.
    """
    cov = coverage(aligned).select(*KEYS, F.col("slots").alias("aligned_rows"), F.col("observations").alias("aligned_non_null_rows"),
                                   F.col("coverage").alias("aligned_coverage_rate"), F.col("missing").alias("missing_interval_count"))
    out = iqr_outliers(aligned, KEYS).select(*KEYS, "outlier_count")
    q = (evidence.join(specs, KEYS).join(cov, KEYS, "left").join(out, KEYS, "left").join(modal_interval(loaded), KEYS, "left")
         .join(availability_metrics(loaded), KEYS, "left").na.fill({"outlier_count": 0}))
    return (q.withColumn("outlier_rate", share("outlier_count", "aligned_non_null_rows")).withColumn("expected_frequency", F.lit(freq)))


def quality_issues(report: DataFrame, target: str) -> DataFrame:
    """Every rule a series breaks, with severity and code; `issue_rank` orders critical to low, then name and code."""
    is_t, cov = F.col("name") == target, F.col("aligned_coverage_rate")
    issue = lambda cond, sev, code: F.when(cond, F.struct(sev.alias("severity") if isinstance(sev, Column) else F.lit(sev).alias("severity"), F.lit(code).alias("code")))
    none = F.col("aligned_non_null_rows") == 0
    low_sev = F.when(is_t, "critical").otherwise("high")
    mid_sev = F.when(is_t, "high").otherwise("medium")
    rules = [
        issue(none, "critical", "series_has_no_values"), issue(~none & (cov < 0.5), low_sev, "very_low_coverage"),
        issue(~none & (cov >= 0.5) & (cov < 0.9), mid_sev, "low_coverage"), issue(~none & (cov >= 0.9) & (cov < 0.98), "medium", "incomplete_coverage"),
        issue(F.col("invalid_timestamp_rows") > 0, "high", "invalid_timestamps"), issue(F.col("non_numeric_rows") > 0, "high", "non_numeric_values"),
        issue(F.col("duplicate_timestamp_rows") > 0, "medium", "duplicate_timestamps"),
        issue(~is_t & (F.col("availability_type") == "unknown"), "medium", "availability_unknown"),
        issue(~is_t & (F.col("availability_type") == "forecast") & ~F.col("availability_present"), "high", "forecast_vintage_unknown"),
        issue(~is_t & (F.col("availability_type") == "observed_only"), "high", "lookahead_risk")]
    order = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    e = report.select(*KEYS, F.explode(F.array_compact(F.array(*rules))).alias("_i")).select(*KEYS, "_i.severity", "_i.code")
    w = Window.partitionBy("series_id").orderBy(order, "name", "code")          # at most ten rules per series
    return e.withColumn("issue_rank", F.row_number().over(w).cast("long"))


def alignment_quality(aligned: DataFrame, target: str, min_obs: int = 12, min_coverage: float = 0.5) -> DataFrame:
    """Grid size, complete rows and whether the target is usable for a study."""
    slot = aligned.groupBy("series_id", "ts").agg(
        (F.count("value") == F.count(F.lit(1))).alias("_full"), F.max(F.when(F.col("name") == target, F.col("value"))).isNotNull().alias("_t"))
    a = slot.groupBy("series_id").agg(F.min("ts").alias("start_at"), F.max("ts").alias("end_at"), F.count(F.lit(1)).alias("expected_rows"),
                                      count_if(F.col("_full")).alias("complete_case_rows"), count_if(F.col("_t")).alias("_n"))
    return a.select("series_id", "start_at", "end_at", "expected_rows", "complete_case_rows", share("complete_case_rows", "expected_rows").alias("complete_case_rate"),
                    ((F.col("_n") >= min_obs) & (F.col("_n") / F.col("expected_rows") >= min_coverage)).alias("usable"))


def series_profile(df: DataFrame, per_day: int, keys: list[str] | None = None) -> DataFrame:
    """Rows, times, range, NULLs, duplicates, negatives, complete-day rate and the five dominant gaps (minutes:count)."""
    keys = KEYS if keys is None else keys
    per_ts = df.groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("_k"), F.count("value").alias("_v"), F.min("value").alias("_lo"), F.max("value").alias("_hi"),
                                         count_if(F.col("value") < 0).alias("_neg"))
    base = per_ts.groupBy(*keys).agg(
        F.sum("_k").alias("rows"), F.count(F.lit(1)).alias("distinct_times"), F.min("ts").alias("start_at"), F.max("ts").alias("end_at"),
        F.sum(F.col("_k") - F.col("_v")).alias("null_values"), F.sum(F.when(F.col("_k") > 1, F.col("_k")).otherwise(0)).alias("duplicate_time_rows"),
        r6(F.min("_lo")).alias("min"), r6(F.max("_hi")).alias("max"), F.sum("_neg").alias("negative_rows"))
    days = per_ts.groupBy(*keys, F.to_date("ts").alias("_d")).agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(
        share(count_if(F.col("_n") >= per_day), F.count(F.lit(1))).alias("complete_day_rate"))
    gaps = top_k(intervals(df, keys), keys, [F.desc("occurrences"), F.asc("seconds")], 5)
    item = F.concat_ws(":", F.floor(F.col("seconds") / 60).cast("string"), F.col("occurrences").cast("string"))
    gaps = gaps.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("t")))), lambda s: s["t"]), ",").alias("dominant_intervals"))
    return base.join(days, keys, "left").join(gaps, keys, "left")


def complete_days(df: DataFrame, slots: int = 96, before: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Days with exactly `slots` points."""
    keys = ["series_id"] if keys is None else keys
    x = df.where(F.col("value").isNotNull())
    if before is not None:
        x = x.where(F.col("ts") < F.lit(before).cast("timestamp"))
    return x.groupBy(*keys, F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("points")).where(F.col("points") == slots)


def grid_runs(df: DataFrame, clock: MarketClock, keys: list[str]) -> DataFrame:
    """(keys, ts, last, n, off_grid, not_finite): neighbouring rows of a task that stand one interval apart, as one row.

    Every row is in one run; a grid that is read in its order shrinks to a few runs for each task that holds some of it.
    """
    step = clock.seconds * 1_000_000
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    x = df.where(F.col("ts").isNotNull()).select(*keys, "ts", (floor_ts("ts", clock.seconds, clock.tz) != F.col("ts")).alias("off_grid"), bad.cast("int").alias("not_finite"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x.schema.fields if f.name in keys)

    def runs(batches):
        for batch in batches:
            if not len(batch):
                continue
            ts, off = batch.column("ts").cast(pa.int64()).to_numpy(), batch.column("off_grid").to_numpy(zero_copy_only=False)
            on = (np.diff(ts) == step) & (off[1:] == off[:-1])
            for k in keys:
                c = batch.column(k)
                on &= pc.fill_null(pc.equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.flatnonzero(~on) + 1])
            last = np.append(first[1:], len(ts)) - 1
            bad = np.add.reduceat(batch.column("not_finite").to_numpy().astype(np.int64), first)
            take = lambda c, at: batch.column(c).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*[take(k, first) for k in keys], take("ts", first), take("ts", last), pa.array(last - first + 1), take("off_grid", first), pa.array(bad)], names=[*keys, "ts", "last", "n", "off_grid", "not_finite"])
    return x.mapInArrow(runs, f"{kinds}, ts timestamp, last timestamp, n long, off_grid boolean, not_finite long")


def validate_grid(df: DataFrame, clock: MarketClock, keys: list[str] | None = None, keep=lambda df: df) -> DataFrame:
    """One row per broken rule of a price grid: unique, on the grid, contiguous, finite.

    Rules are told from runs of rows (`grid_runs`); only series whose runs overlap are opened again, to find the times that occur
    twice. `keep` persists the runs, which are read for both.
    """
    keys = ["series_id"] if keys is None else keys
    runs = keep(grid_runs(df, clock, keys))
    gap = lambda c: count_if(F.unix_micros("ts") - F.unix_micros(c) != clock.seconds * 1_000_000)
    whole = keep(previous_row(runs, keys, ["last"]).groupBy(*keys).agg(
        F.max(F.coalesce(F.col("prev_last") >= F.col("ts"), F.lit(False))).alias("_twice"), F.lit(0).cast("long").alias("duplicate_times"),
        F.sum(F.when(F.col("off_grid"), F.col("n")).otherwise(0)).alias("off_grid"), gap("prev_last").alias("not_contiguous"), F.sum("not_finite").alias("not_finite")))
    opened = runs.join(whole.where("_twice").select(*keys), keys, "left_semi").select(*keys, F.explode(F.sequence("ts", "last", F.expr(f"INTERVAL {clock.seconds} SECONDS"))).alias("ts"), "off_grid")
    per_ts = opened.groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("_k"), F.max("off_grid").alias("off_grid"))
    again = previous_row(per_ts, keys, ["ts"]).groupBy(*keys).agg(F.sum(F.col("_k") - 1).alias("duplicate_times"), count_if(F.col("off_grid")).alias("off_grid"), gap("prev_ts").alias("not_contiguous"))
    a = whole.where(~F.col("_twice")).drop("_twice").unionByName(again.join(whole.select(*keys, "not_finite"), keys))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).cast("long").alias("rows")) for r in ("duplicate_times", "off_grid", "not_contiguous", "not_finite")])
    return a.select(*keys, F.explode(rules).alias("_r")).select(*keys, "_r.rule", "_r.rows").where(F.col("rows") > 0)


def data_quality(evidence: DataFrame, loaded: DataFrame, aligned: DataFrame, specs: DataFrame, freq: str, target: str, keep=lambda df: df) -> dict[str, DataFrame]:
    """The quality evidence of a study in one call: series reports, ordered issues and the alignment report."""
    report = keep(series_quality(evidence, loaded, aligned, specs, freq))
    return {"series": report, "issues": quality_issues(report, target), "alignment": alignment_quality(aligned, target)}
