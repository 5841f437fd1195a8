"""Rules that turn study results into evidence statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_if, r6
from .align import KEYS


def eta_squared(calendar: DataFrame) -> DataFrame:
    """Between-group share of variance per calendar grouping, from the group summaries alone."""
    keys = ["series_id", "grouping"]
    g = calendar.where(F.col("mean").isNotNull() & (F.col("observations") > 0))
    tot = g.groupBy(*keys).agg((F.sum(F.col("mean") * F.col("observations")) / F.sum("observations")).alias("_m"), F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= 2)
    n = F.col("observations")
    a = g.join(tot, keys).groupBy(*keys).agg(
        F.sum(n * (F.col("mean") - F.col("_m")) * (F.col("mean") - F.col("_m"))).alias("_b"),
        F.coalesce(F.sum(F.greatest(n - 1, F.lit(0)) * F.col("std") * F.col("std")), F.lit(0.0)).alias("_w"))
    return a.select(*keys, F.when(F.col("_b") + F.col("_w") > 0, r6(F.col("_b") / (F.col("_b") + F.col("_w")))).alias("eta_squared"))


def drifting(profile: DataFrame, trend: DataFrame) -> DataFrame:
    """Drivers whose whole-sample drift reaches one of their own standard deviations."""
    j = profile.select(*KEYS, "observations", "std").join(trend.select(*KEYS, "trend_slope_per_interval"), KEYS)
    j = j.where(F.col("trend_slope_per_interval").isNotNull() & (F.col("observations") > 0) & (F.col("std") != 0))
    return j.withColumn("drifting", F.abs("trend_slope_per_interval") * F.col("observations") >= F.col("std"))


def monotonic(response: DataFrame) -> DataFrame:
    """Do the target means move one way across the driver's quartiles? Fewer than three buckets count as monotonic."""
    w = Window.partitionBy(*KEYS).orderBy("bucket")                              # at most four buckets per key
    s = response.where(F.col("target_mean").isNotNull()).withColumn("_d", F.col("target_mean") - F.lag("target_mean").over(w))
    up, down = F.min(F.coalesce(F.col("_d") >= 0, F.lit(True))), F.min(F.coalesce(F.col("_d") <= 0, F.lit(True)))
    return s.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("buckets"), ((F.count(F.lit(1)) < 3) | up | down).alias("monotonic"))


def group_spread(grouped: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Spread of r across a driver's groups; support when it reaches the threshold."""
    g = grouped.where(F.col("correlation").isNotNull()).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("groups"), r6(F.max("correlation") - F.min("correlation")).alias("spread")).where(F.col("groups") >= 2)
    return g.withColumn("status", F.when(F.col("spread") >= threshold, "candidate_support").otherwise("not_supported"))


def lag_scan_gaps(scan: DataFrame) -> DataFrame:
    """Scans that run out of pairs, with the last usable lag, and drivers with no usable r at all."""
    c = F.col("correlation")
    a = scan.groupBy(*KEYS).agg(count_if(c.isNotNull()).alias("usable_lags"), count_if(c.isNull()).alias("starved_lags"), F.max(F.when(c.isNotNull(), F.col("lag"))).alias("last_usable_lag"))
    return a.withColumn("truncated", (F.col("usable_lags") > 0) & (F.col("starved_lags") > 0)).withColumn("no_evidence", F.col("usable_lags") == 0)


def volatility_regime(rolling: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Ratio of the largest to the smallest one-day rolling std; a flat day is support by itself."""
    d = rolling.where(F.col("span") == "one_day")
    ratio = F.when(F.col("minimum_std") > 0, r6(F.col("maximum_std") / F.col("minimum_std")))
    status = (F.when(F.col("maximum_std").isNull(), "not_tested").when(F.col("minimum_std").isNull(), "inconclusive").when(F.col("minimum_std") == 0, "candidate_support")
               .when(ratio >= threshold, "candidate_support").otherwise("not_supported"))
    return d.select("series_id", ratio.alias("ratio"), status.alias("status"))


# Evidence thresholds as (item, metric, comparison, threshold). A support item holds when any of its metrics passes.
RULES = (
    ("distribution", "abs_skewness", ">=", 0.5), ("distribution", "kurtosis", ">=", 1.0), ("calendar", "max_eta_squared", ">=", 0.06),
    ("autocorrelation", "max_abs_autocorrelation", ">=", 0.2), ("coverage", "min_driver_coverage", "<", 0.9), ("contemporaneous", "max_abs_correlation", ">=", 0.1),
    ("lead_lag", "max_best_lag", ">", 0.0), ("seasonality", "max_seasonal_strength", ">=", 0.3), ("spike_clustering", "persistence_ratio", ">", 1.5),
    ("concentration", "top_5_percent_share", ">=", 0.15), ("extremes", "extreme_count", ">", 0.0), ("outliers", "driver_outlier_count", ">", 0.0),
    ("collinearity", "strong_pairs", ">", 0.0), ("pacf", "significant_lags", ">", 0.0), ("stationarity", "non_stationary", ">", 0.0),
    ("variance", "asinh_recommended", ">", 0.0), ("baselines", "best_beats_persistence", ">", 0.0), ("inflation", "max_vif", ">=", 5.0),
    ("nonlinearity", "nonlinear_drivers", ">", 0.0), ("precedence", "preceding_drivers", ">", 0.0), ("stability", "unstable_drivers", ">", 0.0),
)


def apply_rules(metrics: DataFrame, rules=RULES) -> DataFrame:
    """Status per item from tidy metrics (series_id, metric, value): any passing metric supports; no value means not tested."""
    items = F.array(*[F.struct(F.lit(i).alias("item"), F.lit(m).alias("metric"), F.lit(o).alias("op"), F.lit(t).alias("threshold")) for i, m, o, t in rules])
    all_rules = metrics.select("series_id").distinct().withColumn("_r", F.explode(items)).select("series_id", "_r.*")
    j = all_rules.join(metrics, ["series_id", "metric"], "left")
    v, t = F.col("value"), F.col("threshold")
    hit = F.when(F.col("op") == ">=", v >= t).when(F.col("op") == ">", v > t).otherwise(v < t)
    a = j.groupBy("series_id", "item").agg(F.bool_or(hit).alias("_hit"), F.count("value").alias("tested_metrics"))
    return a.select("series_id", "item", "tested_metrics", F.when(F.col("tested_metrics") == 0, "not_tested").when(F.col("_hit"), "candidate_support").otherwise("not_supported").alias("status"))


def study_gates(quality: DataFrame, issues: DataFrame, usable: DataFrame, target: str) -> DataFrame:
    """Study gates per market: target usable, target coverage, critical and high issues, the blocking codes."""
    t = quality.where(F.col("name") == target).select("series_id", (F.col("aligned_coverage_rate") >= 0.98).alias("target_coverage_ok"))
    i = issues.groupBy("series_id").agg(
        count_if(F.col("severity") == "critical").alias("critical_issues"), count_if(F.col("severity") == "high").alias("high_issues"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("severity") == "critical", F.col("code")))), ",").alias("blocking_codes"))
    g = usable.select("series_id", F.col("usable").alias("target_usable")).join(t, "series_id", "left").join(i, "series_id", "left").na.fill(
        {"critical_issues": 0, "high_issues": 0, "blocking_codes": ""})
    return g.withColumn("passed", F.col("target_usable") & (F.col("critical_issues") == 0))


def rank_relationships(rels: DataFrame, best: DataFrame) -> DataFrame:
    """Every Pearson, Spearman and best-lag coefficient of a market in one list, strongest first.

    `rels`: keys, method, correlation; `best`: keys, lag, correlation.
    """
    u = rels.select(*KEYS, "method", F.lit(0).cast("long").alias("lag"), "correlation").unionByName(best.select(*KEYS, F.lit("best_lag").alias("method"), "lag", "correlation"))
    w = Window.partitionBy("series_id").orderBy(F.desc(F.abs("correlation")), "name", "method")          # three rows per driver
    return u.where(F.col("correlation").isNotNull()).withColumn("rank", F.row_number().over(w).cast("long"))


def rank_contrasts(contrasts: DataFrame, value: str = "mean_difference", keys: list[str] | None = None) -> DataFrame:
    """Largest contrast of each comparison, and how many compared segments overlap."""
    keys = ["series_id", "kind"] if keys is None else keys
    order = F.struct(-F.abs(value), F.col("left_id"), F.col("right_id"))
    b = contrasts.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min_by(F.struct("left_id", "right_id", value), order).alias("_b"), count_if(F.col("overlap_rows") > 0).alias("overlapping_pairs"), F.count(F.lit(1)).alias("contrasts"))
    return b.select(*keys, "_b.left_id", "_b.right_id", f"_b.{value}", "overlapping_pairs", "contrasts")
