"""Driver profiles and target-driver relationships, keyed by (series_id, name).

`pairs` is the result of `align.pair_with_target`: a study builds it once and hands it to every function here.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.columns import count_if, no_nan, per_day, r6, share
from ..functions.tails import f_upper_udf, pearson_p_udf
from .align import KEYS, Segment, explode_segments, widen
from .common import (drop_halo, gram, halo_window, lag_moments, lag_table, moment_corr, prefix_sums, quantiles, ranked_values,
                     with_halo, with_lags)
from .target import changes, iqr_outliers, overlaps, sample_skew

MI_BINS = 12
GRANGER_CEILING = 96


def drivers_of(aligned: DataFrame, target: str) -> DataFrame:
    return aligned.where(F.col("name") != target)


def driver_distribution(drivers: DataFrame) -> DataFrame:
    n = F.count("value").cast("double")
    base = drivers.groupBy(*KEYS).agg(
        F.count("value").alias("observations"), r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("std"),
        r6(F.min("value")).alias("min"), r6(F.max("value")).alias("max"), r6(sample_skew(F.skewness("value"), n)).alias("skewness"),
        share(count_if(F.col("value") == 0), F.count("value")).alias("zero_rate"),
        share(count_if(F.col("value") < 0), F.count("value")).alias("negative_rate"))
    q = quantiles(drivers, KEYS, "value", {"q1": .25, "median": .5, "q3": .75})
    return base.join(q.select(*KEYS, *[r6(c).alias(c) for c in ("q1", "median", "q3")]), KEYS, "left")


def driver_outliers(drivers: DataFrame, k: float = 1.5) -> DataFrame:
    return iqr_outliers(drivers, KEYS, k).withColumn("outlier_rate", share("outlier_count", "observations"))


def driver_trend(drivers: DataFrame) -> DataFrame:
    return changes(drivers, KEYS).drop("mean_absolute_change")


def collinearity(aligned: DataFrame, drivers: list[str], threshold: float = 0.8) -> DataFrame:
    """Pairwise r of all drivers in one aggregate; `strong` marks |r| at or above the threshold."""
    wide = widen(aligned, drivers)
    pairs = [(a, b) for i, a in enumerate(drivers) for b in drivers[i + 1:]]
    both = {p: F.col(p[0]).isNotNull() & F.col(p[1]).isNotNull() for p in pairs}
    aggs = []
    for j, p in enumerate(pairs):
        aggs += [F.corr(*p).alias(f"r{j}"), count_if(both[p]).alias(f"n{j}")]
    out = F.array(*[F.struct(F.lit(a).alias("left_name"), F.lit(b).alias("right_name"),
                             F.when(F.col(f"n{j}") >= 3, no_nan(F.col(f"r{j}"))).alias("r"), F.col(f"n{j}").alias("observations"))
                    for j, (a, b) in enumerate(pairs)])
    e = wide.groupBy("series_id").agg(*aggs).withColumn("_p", F.explode(out))
    return e.select("series_id", "_p.left_name", "_p.right_name", r6("_p.r").alias("correlation"), "_p.observations",
                    F.coalesce(F.abs("_p.r") >= threshold, F.lit(False)).alias("strong"))


@pandas_udf(T.ArrayType(T.DoubleType()))
def _inflation(g: pd.Series) -> pd.Series:
    def one(flat):
        m = np.asarray(flat, float)
        k = int(round(len(m) ** 0.5))
        m = m.reshape(k, k)
        n, s = m[0, 0], m[0, 1:]
        c = m[1:, 1:] - np.outer(s, s) / n
        out = []
        for j in range(k - 1):
            rest = [i for i in range(k - 1) if i != j]
            beta = np.linalg.lstsq(c[np.ix_(rest, rest)], c[rest, j], rcond=None)[0]
            unexplained = (c[j, j] - c[rest, j] @ beta) / c[j, j] if c[j, j] > 0 else 0.0
            out.append(float(1.0 / unexplained) if unexplained > 1e-12 else None)
        return out
    return g.map(one)


def vif(aligned: DataFrame, drivers: list[str]) -> DataFrame:
    """Variance inflation from the drivers' cross-product matrix over complete cases (at least 24)."""
    wide = widen(aligned, drivers).dropna(subset=drivers)
    stats = wide.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("complete_cases"), *[F.avg(c).alias(f"_m_{c}") for c in drivers],
        *[F.stddev_pop(c).alias(f"_s_{c}") for c in drivers]).where(F.col("complete_cases") >= 24)
    z = wide.join(stats, "series_id").select("series_id", F.array(F.lit(1.0), *[
        F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(F.lit(0.0)) for c in drivers]).alias("v"))
    e = gram(z, ["series_id"], "v").select("series_id", F.posexplode(_inflation("g")).alias("_j", "_v"))
    names = F.array(*[F.lit(c) for c in drivers])
    return e.join(stats.select("series_id", "complete_cases"), "series_id").select(
        "series_id", names[F.col("_j")].alias("name"), "complete_cases", r6("_v").alias("vif"), r6(1 - 1 / F.col("_v")).alias("r_squared"),
        F.when(F.col("_v").isNull(), "unavailable").when(F.col("_v") >= 10, "severe").when(F.col("_v") >= 5, "moderate")
        .otherwise("acceptable").alias("severity"))


def pearson_table(pairs: DataFrame, keys: list[str], min_obs: int, p_value: bool = True) -> DataFrame:
    """r and n per key over pairwise-complete rows; r is NULL below `min_obs` or for a constant side."""
    ok = (F.col("observations") >= min_obs) & (F.col("_x0") < F.col("_x1")) & (F.col("_y0") < F.col("_y1"))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    x, y = F.when(both, F.col("x")), F.when(both, F.col("y"))
    t = pairs.groupBy(*keys).agg(
        F.corr(x, y).alias("_r"), count_if(both).alias("observations"), F.min(x).alias("_x0"), F.max(x).alias("_x1"),
        F.min(y).alias("_y0"), F.max(y).alias("_y1")).withColumn("_r", F.when(ok, no_nan(F.col("_r"))))
    out = [*keys, r6("_r").alias("correlation")]
    if p_value:
        out.append(r6(pearson_p_udf("_r", F.col("observations").cast("double"))).alias("p_value"))
    return t.select(*out, "observations")


def pearson(pairs: DataFrame, min_obs: int = 12, p_value: bool = True) -> DataFrame:
    return pearson_table(pairs, KEYS, min_obs, p_value)


def spearman(pairs: DataFrame, min_obs: int = 12, p_value: bool = True) -> DataFrame:
    """Rank correlation; equal (x, y) pairs are counted before the ranks are joined on."""
    p = pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    joint = p.groupBy(*KEYS, "x", "y").agg(F.count(F.lit(1)).alias("_w"))
    for c in ("x", "y"):
        rv = ranked_values(p, KEYS, c).select(*KEYS, F.col("_v").alias(c), (F.col("_before") + (F.col("_cnt") + 1) / 2 - (F.col("_n") + 1) / 2).alias(f"_r{c}"))
        joint = joint.join(rv, [*KEYS, c])
    s = joint.groupBy(*KEYS).agg(
        F.sum("_w").alias("observations"), F.sum(F.col("_w") * F.col("_rx") * F.col("_ry")).alias("_xy"),
        F.sum(F.col("_w") * F.col("_rx") * F.col("_rx")).alias("_xx"), F.sum(F.col("_w") * F.col("_ry") * F.col("_ry")).alias("_yy"))
    rho = F.when((F.col("observations") >= min_obs) & (F.col("_xx") > 0) & (F.col("_yy") > 0), F.col("_xy") / F.sqrt(F.col("_xx") * F.col("_yy")))
    s = s.withColumn("_r", rho)
    out = [*KEYS, r6("_r").alias("correlation")]
    if p_value:
        out.append(r6(pearson_p_udf("_r", F.col("observations").cast("double"))).alias("p_value"))
    return s.select(*out, "observations")


def lagged_pairs(pairs: DataFrame, max_lag: int) -> DataFrame:
    """(series_id, name, i, lag, x = driver `lag` slots earlier, y = target now); incomplete pairs kept."""
    p = pairs.select(*KEYS, "i", "x", "y")
    return lag_table(p, KEYS, "x", max_lag).select(*KEYS, "i", "lag", F.col("lagged").alias("x"), "y")


def lead_scan(pairs: DataFrame, max_lag: int = 72, min_obs: int = 12) -> DataFrame:
    m = lag_moments(pairs, KEYS, "x", "y", max_lag)
    return m.select(*KEYS, "lag", r6(F.when(F.col("n") >= min_obs, moment_corr())).alias("correlation"), F.col("n").alias("observations"))


def lead_scan_best(scan: DataFrame, p_value: bool = False) -> DataFrame:
    """Largest |r| per driver, the smaller lag on ties."""
    best = (scan.where(F.col("correlation").isNotNull()).groupBy(*KEYS)
            .agg(F.min_by(F.struct("lag", "correlation", "observations"), F.struct(-F.abs("correlation"), F.col("lag"))).alias("_b"))
            .select(*KEYS, "_b.lag", "_b.correlation", "_b.observations"))
    return best.withColumn("p_value", r6(pearson_p_udf("correlation", F.col("observations").cast("double")))) if p_value else best


def pearson_by_hour(pairs: DataFrame, min_obs: int = 12, p_value: bool = True) -> DataFrame:
    p = pairs.withColumn("grp", F.hour("ts").cast("long"))
    return pearson_table(p, [*KEYS, "grp"], min_obs, p_value).where(F.col("correlation").isNotNull())


def pearson_by_month(pairs: DataFrame, min_obs: int = 12, p_value: bool = True) -> DataFrame:
    p = pairs.withColumn("grp", F.month("ts").cast("long"))
    return pearson_table(p, [*KEYS, "grp"], min_obs, p_value).where(F.col("correlation").isNotNull())


def quartile_response(pairs: DataFrame, min_obs: int = 12, keep=lambda df: df) -> DataFrame:
    """Target mean and median per driver quartile: right-closed buckets, equal edges merged."""
    p = pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    q = quantiles(p, KEYS, "x", {"e0": 0.0, "e1": .25, "e2": .5, "e3": .75, "e4": 1.0})
    distinct = p.groupBy(*KEYS, "x").agg(F.lit(1).alias("_")).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_distinct"))
    ok = (F.col("n") >= max(min_obs, 8)) & (F.col("_distinct") >= 4)
    edges = q.join(distinct, KEYS).where(ok).select(*KEYS, F.array_distinct(F.array("e0", "e1", "e2", "e3", "e4")).alias("_e"))
    upper = F.slice("_e", 2, F.size("_e") - 1)
    j = p.join(edges, KEYS).where(F.size("_e") >= 2)
    bucket = F.size(F.filter(upper, lambda e: e < F.col("x"))) + 1
    b = j.withColumn("bucket", F.least(bucket, F.size("_e") - 1).cast("long"))
    b = keep(b)
    keys = [*KEYS, "bucket"]
    base = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("observations"), r6(F.min("x")).alias("feature_min"),
                                r6(F.max("x")).alias("feature_max"), r6(F.avg("y")).alias("target_mean"))
    med = quantiles(b, keys, "y", {"m": .5}).select(*keys, r6("m").alias("target_median"))
    return base.join(med, keys)


def mutual_information(pairs: DataFrame, max_lag: int, min_obs: int = 12, keep=lambda df: df) -> DataFrame:
    """MI over 12 x 12 equal-frequency rank bins for every lag, ranks taken over the paired rows of that lag."""
    keys = [*KEYS, "lag"]
    p = lagged_pairs(pairs, max_lag).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    joint = keep(p.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("_w")))
    for c in ("x", "y"):
        twice = 2 * F.col("_before") + F.col("_cnt") + 1                     # 2 * average rank, an integer
        bins = F.floor((MI_BINS * (twice - 1) + 2 * F.col("_n") - 1) / (2 * F.col("_n"))) - 1
        rv = ranked_values(p, keys, c).select(*keys, F.col("_v").alias(c), F.least(F.greatest(bins, F.lit(0)), F.lit(MI_BINS - 1)).alias(f"_b{c}"))
        joint = joint.join(rv, [*keys, c])
    distinct = (p.groupBy(*keys, "x").agg(F.lit(1).alias("_")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_distinct")))
    cells = joint.groupBy(*keys, "_bx", "_by").agg(F.sum("_w").alias("_c"))
    over = lambda *cols: F.sum("_c").over(Window.partitionBy(*keys, *cols))   # at most 144 cells per key
    cells = cells.withColumn("_n", over()).withColumn("_px", over("_bx") / F.col("_n")).withColumn("_py", over("_by") / F.col("_n"))
    pxy = F.col("_c") / F.col("_n")
    mi = cells.groupBy(*keys).agg(
        F.max("_n").alias("observations"), F.greatest(F.lit(0.0), F.sum(pxy * F.log(pxy / (F.col("_px") * F.col("_py"))))).alias("_mi"),
        (-F.sum(pxy * F.log("_px"))).alias("_hx"), (-F.sum(pxy * F.log("_py"))).alias("_hy"))
    h = F.least("_hx", "_hy")
    return (mi.join(distinct, keys).where((F.col("observations") >= min_obs) & (F.col("_distinct") >= MI_BINS))
              .select(*keys, "observations", r6("_mi").alias("mutual_information"), F.when(h > 0, r6(F.col("_mi") / h)).alias("normalized")))


def mutual_information_summary(mi: DataFrame, scan: DataFrame) -> DataFrame:
    """Best lag by normalized MI, |r| at that lag, and the nonlinearity flag."""
    best = mi.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("evaluated_lags"), F.min_by(F.struct("lag", "normalized"), F.struct(
        -F.coalesce("normalized", F.lit(0.0)), F.col("lag"))).alias("_b")).select(*KEYS, "evaluated_lags", "_b.lag", "_b.normalized")
    r = scan.select(*KEYS, "lag", F.abs("correlation").alias("absolute_pearson"))
    flag = (F.col("normalized") >= 0.05) & (F.col("absolute_pearson") < 0.1)
    return best.join(r, [*KEYS, "lag"], "left").withColumn("nonlinear", F.coalesce(flag, F.lit(False)))


@pandas_udf(T.StructType([T.StructField("rss_restricted", T.DoubleType()), T.StructField("rss_full", T.DoubleType())]))
def _nested_rss(g: pd.Series, lag: pd.Series) -> pd.DataFrame:
    out = []
    for flat, p in zip(g, lag):
        m = np.asarray(flat, float)
        k = int(round(len(m) ** 0.5))
        m = m.reshape(k, k)
        res = []
        for cols in (list(range(p + 1)), list(range(2 * p + 1))):
            beta = np.linalg.lstsq(m[np.ix_(cols, cols)], m[cols, -1], rcond=None)[0]
            res.append(float(m[-1, -1] - m[cols, -1] @ beta))
        out.append(res)
    return pd.DataFrame(out, columns=["rss_restricted", "rss_full"])


def granger(pairs: DataFrame, freq: str, max_lag: int = 72, min_obs: int = 12, ceiling: int = GRANGER_CEILING) -> DataFrame:
    """Does the driver's history improve the target's autoregression? F test at lags 1, 2, one day and the ceiling.

    Positions run over the paired rows. Each lag's two regressions come from one
    cross-product matrix of [1, target lags, driver lags, target].
    """
    p = pairs
    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    s = prefix_sums(p, KEYS, "i", {"seq": known.cast("long")}).where(known)
    stats = s.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"), *[f(c).alias(f"_{t}{c}") for c in ("x", "y") for t, f in (("m", F.avg), ("s", F.stddev_pop))])
    if max_lag > ceiling:
        raise ValueError(f"max_lag {max_lag} is beyond the ceiling of {ceiling}: a regression has 2 * max_lag + 1 terms")
    top = max_lag
    reach = F.least(F.lit(top), F.greatest(F.lit(1), F.floor(F.col("_n") / 20))).cast("int")
    stats = stats.where(F.col("_n") >= min_obs).withColumn("_ceil", reach).withColumn(
        "_lags", F.filter(F.array_distinct(F.array(F.lit(1), F.lit(2), F.lit(per_day(freq)), F.col("_ceil"))), lambda k: k <= F.col("_ceil")))
    z = s.join(stats, KEYS)
    for c in ("x", "y"):
        z = z.withColumn(c, F.when(F.col(f"_s{c}") > 0, (F.col(c) - F.col(f"_m{c}")) / F.col(f"_s{c}")).otherwise(F.lit(0.0)))
    h = with_halo(z, KEYS, back=top, order="seq")
    w = halo_window(KEYS, "seq").rowsBetween(-top, -1)
    h = drop_halo(h.withColumn("_ys", F.reverse(F.collect_list("y").over(w))).withColumn("_xs", F.reverse(F.collect_list("x").over(w))))
    e = h.withColumn("lag", F.explode("_lags")).where((F.col("seq") > F.col("lag")) & (F.col("_n") - F.col("lag") > 2 * F.col("lag") + 2))
    e = e.select(*KEYS, "lag", F.concat(F.array(F.lit(1.0)), F.slice("_ys", F.lit(1), F.col("lag")), F.slice("_xs", F.lit(1), F.col("lag")), F.array("y")).alias("v"))
    g = gram(e, [*KEYS, "lag"], "v").withColumn("_r", _nested_rss("g", "lag")).withColumn("observations", F.col("g")[0].cast("long"))
    r, u = F.col("_r.rss_restricted"), F.col("_r.rss_full")
    dof = F.col("observations") - (2 * F.col("lag") + 1)
    g = g.withColumn("_f", F.when((dof > 0) & (u > 0), ((r - u) / F.col("lag")) / (u / dof))).where(F.col("_f") >= 0)
    pv = f_upper_udf("_f", F.col("lag").cast("double"), dof.cast("double"))
    return g.withColumn("_p", pv).select(
        *KEYS, F.col("lag").cast("long").alias("lag"), "observations", r6("_f", 4).alias("f_statistic"), r6("_p").alias("p_value"), (F.col("_p") < 0.05).alias("rejects"),
        r6(F.greatest(F.lit(0.0), 1 - u / r)).alias("variance_reduction"))


def granger_strongest(tests: DataFrame) -> DataFrame:
    return tests.groupBy(*KEYS).agg(F.min_by(F.struct("lag", "p_value", "rejects"), F.struct("p_value", "lag")).alias("_b")).select(
        *KEYS, "_b.lag", "_b.p_value", F.col("_b.rejects").alias("precedes"))


def rolling_window(slots: int, freq: str, min_obs: int) -> int:
    day = per_day(freq)
    w = min(max(day, slots // 6), day * 30)
    if w < min_obs or slots < 3 * w:
        w = max(min_obs, slots // 3)
    return w


def rolling_correlation(pairs: DataFrame, window: int, min_obs: int = 12) -> DataFrame:
    """Correlation over the trailing `window` slots, sampled at every half window of usable values.

    Both sides are centred on the key's means first, so the running sums stay accurate.
    """
    p = pairs
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    p = p.withColumn("x", F.when(both, F.col("x"))).withColumn("y", F.when(both, F.col("y")))
    h = with_halo(p, KEYS, back=window - 1)
    w = halo_window(KEYS).rowsBetween(-(window - 1), 0)
    h = drop_halo(h.withColumn("_n", F.count("x").over(w)).withColumn("r", F.when(F.col("_n") >= min_obs, no_nan(F.corr("x", "y").over(w)))))
    seq = prefix_sums(h, KEYS, "i", {"seq": F.col("r").isNotNull().cast("long")}).where(F.col("r").isNotNull())
    stride = max(1, window // 2)
    return seq.where((F.col("seq") - 1) % stride == 0).select(*KEYS, "ts", ((F.col("seq") - 1) / stride + 1).cast("long").alias("sample"), "r")


def rolling_stability(samples: DataFrame) -> DataFrame:
    pos, neg, n = count_if(F.col("r") > 0), count_if(F.col("r") < 0), F.count(F.lit(1))
    sd = F.stddev_pop("r")
    return samples.groupBy(*KEYS).agg(
        n.alias("windows"), r6(F.avg("r")).alias("mean_correlation"), r6(sd).alias("std_correlation"), r6(F.min("r")).alias("min_correlation"),
        r6(F.max("r")).alias("max_correlation"), share(F.least(pos, neg), n).alias("sign_flip_share"),
        share(count_if(F.abs("r") >= 0.1), n).alias("share_above_0_1"),
        F.when((sd < 0.15) & (F.least(pos, neg) == 0), "stable").when(F.least(pos, neg) > 0, "sign_unstable").otherwise("magnitude_unstable").alias("stability"),
    ).where(F.col("windows") >= 3)


def compare_relationship_segments(pairs: DataFrame, segments: list[Segment], min_obs: int = 12, tz: str = "UTC") -> DataFrame:
    p = pairs
    s = pearson_table(explode_segments(p, segments, tz), [*KEYS, "segment_id", "kind", "ord"], min_obs, p_value=False)
    l = s.select(*KEYS, "kind", F.col("segment_id").alias("left_id"), F.col("ord").alias("_lo"), F.col("correlation").alias("left_r"))
    r = s.select(*KEYS, "kind", F.col("segment_id").alias("right_id"), F.col("ord").alias("_ro"), F.col("correlation").alias("right_r"))
    o = overlaps(p, KEYS, segments, tz)
    return (l.join(r, [*KEYS, "kind"]).where(F.col("_lo") < F.col("_ro")).join(o, [*KEYS, "left_id", "right_id"])
             .select(*KEYS, "kind", "left_id", "right_id", "left_r", "right_r", "overlap_rows", r6(F.col("left_r") - F.col("right_r")).alias("correlation_difference")))


def eligible_drivers(quality: DataFrame, min_rows: int = 12, min_coverage: float = 0.5) -> DataFrame:
    return quality.where((F.col("observations") >= min_rows) & (F.col("coverage") >= min_coverage)).select(*KEYS, "observations", "coverage")


def recommend_drivers(quality: DataFrame, profile: DataFrame, rels: DataFrame, pairs: DataFrame, limit: int = 8) -> DataFrame:
    """Tier, redundancy and rank of every driver from its quality, spread and contemporaneous coefficients.

    `quality`: keys, observations, coverage, availability_type, availability_present; `rels`: keys, correlation (one row
    per coefficient); `pairs`: strong pairs (series_id, left_name, right_name).
    """
    best = rels.where(F.col("correlation").isNotNull()).groupBy(*KEYS).agg(F.max_by("correlation", F.abs("correlation")).alias("best_r"))
    q = quality.join(profile.select(*KEYS, "std"), KEYS, "left").join(best, KEYS, "left")
    score = F.coalesce(F.abs("best_r"), F.lit(0.0))
    ready = (F.col("availability_type") == "known_at_timestamp") | ((F.col("availability_type") == "forecast") & F.col("availability_present"))
    base = F.when(F.col("observations") == 0, "excluded").when(F.col("coverage") < 0.5, "excluded").when(
        F.coalesce(F.col("std"), F.lit(0.0)) == 0, "excluded").when(score >= 0.1, "recommended").otherwise("exploratory")
    rows = q.withColumn("tier", base).withColumn("_score", score).withColumn("prediction_ready", ready)
    usable = rows.where(F.col("tier") != "excluded").select("series_id", "name", "_score")
    l = usable.select("series_id", F.col("name").alias("left_name"), F.col("_score").alias("_ls"))
    r = usable.select("series_id", F.col("name").alias("right_name"), F.col("_score").alias("_rs"))
    lost = (pairs.join(l, ["series_id", "left_name"]).join(r, ["series_id", "right_name"])
            .select("series_id", F.when(F.col("_ls") >= F.col("_rs"), F.col("right_name")).otherwise(F.col("left_name")).alias("name"),
                    F.when(F.col("_ls") >= F.col("_rs"), F.col("left_name")).otherwise(F.col("right_name")).alias("redundant_with"))
            .groupBy(*KEYS).agg(F.max("redundant_with").alias("redundant_with")))
    rows = rows.join(lost, KEYS, "left").withColumn(
        "tier", F.when((F.col("tier") == "recommended") & F.col("redundant_with").isNotNull(), "exploratory").otherwise(F.col("tier")))
    order = F.when(F.col("tier") == "recommended", 0).when(F.col("tier") == "exploratory", 1).otherwise(2)
    w = Window.partitionBy("series_id").orderBy(order, F.desc("_score"), F.desc("coverage"), "name")    # one row per driver
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).select(
        *KEYS, "tier", "rank", ((F.col("tier") == "recommended") & (F.col("rank") <= max(1, limit))).alias("selected"), "coverage", "observations",
        r6("best_r").alias("best_r"), "redundant_with", "prediction_ready")


def feature_evidence(pairs: DataFrame, freq: str) -> DataFrame:
    """Per feature: coverage, distinct values, changes, r at 0, 1 hour and 24 hours, and r in each half of the window."""
    hour = max(1, per_day(freq) // 24)
    p = pairs
    slots = p.groupBy(*KEYS).agg((F.max("i") + 1).alias("_slots"))
    l = with_lags(p, KEYS, ["x"], [hour, 24 * hour]).join(slots, KEYS)
    first = F.col("i") < F.floor(F.col("_slots") / 2)
    known = prefix_sums(p, KEYS, "i", {"seq": F.col("x").isNotNull().cast("long")}).where(F.col("x").isNotNull())
    ch = with_lags(known, KEYS, ["x"], [1], order="seq").groupBy(*KEYS).agg(count_if(F.col("x") != F.col("x_lag1")).alias("changes"))
    kinds = {"r_same_time": ("x", F.lit(True)), "r_lag_1h": (f"x_lag{hour}", F.lit(True)), "r_lag_24h": (f"x_lag{24 * hour}", F.lit(True)),
             "r_first_half": ("x", first), "r_second_half": ("x", ~first)}
    aggs = []
    for name, (c, cond) in kinds.items():
        ok = cond & F.col(c).isNotNull() & F.col("y").isNotNull()
        x, y = F.when(ok, F.col(c)), F.when(ok, F.col("y"))
        usable = (F.count(x) >= 3) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        aggs.append(F.when(usable, r6(F.corr(x, y))).alias(name))
    base = l.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("rows"), F.count("x").alias("valid_rows"), share(F.count("x"), F.count(F.lit(1))).alias("coverage"),
        r6(F.min("x")).alias("minimum"), r6(F.max("x")).alias("maximum"), r6(F.stddev_samp("x")).alias("std"), *aggs)
    distinct = p.where(F.col("x").isNotNull()).groupBy(*KEYS, "x").agg(F.lit(1).alias("_")).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("distinct_values"))
    return base.join(distinct, KEYS, "left").join(ch, KEYS, "left").na.fill({"changes": 0, "distinct_values": 0})
