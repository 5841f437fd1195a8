"""Unit-root and level-stationarity tests from distributed sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..functions.tails import adf_p_udf, kpss_p_udf
from .align import KEYS, fill_linear, reduce_resolution
from .common import drop_halo, gram, halo_window, lag_table, prefix_sums, with_halo, with_lags

# Least points and most lags of the unit-root tests.
MIN_POINTS = 32
LAG_CAP = 48
# MacKinnon (2010) 5 % critical value of the unit-root statistic with a constant.
ADF_CRITICAL_5 = (-2.86154, -2.8903, -4.234, -40.040)


def prepare(df: DataFrame, freq: str, keys: list[str] | None = None, max_points: int | None = None) -> DataFrame:
    """Gap-filled, densely numbered series with at least 32 points on their own grid: (keys, step, ts, i, value, n).

    The tests run on the whole grid however long it is; only a caller who gives `max_points` gets a coarser one.
    """
    keys = KEYS if keys is None else keys
    return fill_linear(reduce_resolution(df, freq, max_points, keys), keys).where(F.col("n") >= MIN_POINTS)


def both_forms(prepared: DataFrame, keys: list[str]) -> DataFrame:
    """The level and its first difference as two forms with their own dense `i` from 0."""
    cap = F.least(F.greatest(F.lit(4), F.floor(F.col("n") / 20)), F.greatest(F.lit(1), F.floor(86400 / F.col("step"))) * 2, F.lit(LAG_CAP)).cast("int")
    x = prepared.withColumn("max_lag", cap)
    d = (with_lags(x, keys, ["value"], [1]).where(F.col("value_lag1").isNotNull())
         .withColumn("value", F.col("value") - F.col("value_lag1")).withColumn("i", F.col("i") - 1).withColumn("n", F.col("n") - 1).drop("value_lag1"))
    return x.withColumn("form", F.lit("level")).unionByName(d.withColumn("form", F.lit("first_difference")))


def adf(forms: DataFrame, keys: list[str]) -> DataFrame:
    """Augmented Dickey-Fuller with a constant, lag by AIC.

    One cross-product matrix over the common sample gives every lag's fit; the
    few rows before it (at most the lag cap) travel as they are and are added
    for the final fit at the chosen lag.
    """
    k = [*keys, "form"]
    h = with_halo(forms, k, back=LAG_CAP + 1)
    w = halo_window(k)
    h = h.withColumn("_d", F.col("value") - F.lag("value").over(w)).withColumn("_x1", F.lag("value").over(w))
    h = drop_halo(h.withColumn("_ds", F.reverse(F.collect_list("_d").over(w.rowsBetween(-LAG_CAP, -1)))))
    shift = F.when(F.col("form") == "level", F.col("level")).otherwise(F.lit(0.0))     # conditioning only
    pad = lambda a: F.transform(F.sequence(F.lit(1), F.col("max_lag")), lambda j: F.coalesce(F.get(a, j - 1), F.lit(0.0)))
    v = (h.where(F.col("i") >= 1)
          .select(*k, "n", "i", "max_lag", F.concat(F.array(F.lit(1.0), F.col("_x1") - shift), pad(F.col("_ds")), F.array("_d")).alias("v")))
    common = gram(v.where(F.col("i") > F.col("max_lag")), k, "v")
    early = v.groupBy(*k).agg(F.first("n").alias("n"), F.first("max_lag").alias("max_lag"),
                              F.collect_list(F.when(F.col("i") <= F.col("max_lag"), F.struct("i", "v"))).alias("early"))

    def fit(g, cols, rows):
        sub, rhs = g[np.ix_(cols, cols)], g[cols, -1]
        inv = np.linalg.pinv(sub)
        beta = inv @ rhs
        rss = g[-1, -1] - rhs @ beta
        return beta, rss, np.sqrt(max(rss, 0.0) / (rows - len(cols)) * inv[1, 1])

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                m = int(row.max_lag)
                g = np.asarray(row.g, float).reshape(m + 3, m + 3)
                rows = row.n - 1 - m
                aic = [rows * np.log(fit(g, list(range(p + 2)), rows)[1] / rows) + 2 * (p + 2) for p in range(m + 1)]
                p = int(np.argmin(aic))
                for e in row.early:
                    if e["i"] > p:
                        x = np.asarray(e["v"], float)
                        g = g + np.outer(x, x)
                rows = row.n - 1 - p
                beta, _, se = fit(g, list(range(p + 2)), rows)
                out.append([*[getattr(row, c) for c in k], p, rows, beta[1] / se])
            yield pd.DataFrame(out, columns=[*k, "used_lag", "observations", "tau"])

    schema = ", ".join(f"{c} string" for c in k) + ", used_lag long, observations long, tau double"
    out = common.join(early, k).select(*k, "n", "max_lag", "g", "early").mapInPandas(solve, schema)
    crit = sum(F.lit(c) / F.pow(F.col("observations"), F.lit(j)) for j, c in enumerate(ADF_CRITICAL_5))
    return out.withColumn("critical_5", crit).withColumn("p", adf_p_udf("tau"))


def kpss(forms: DataFrame, keys: list[str]) -> DataFrame:
    """KPSS around a level with the automatic bandwidth.

    The Bartlett-weighted long-run variance with bandwidth l equals the mean
    square of (l+1)-term running sums over l+1, so any bandwidth needs only the
    prefix sums and one grouping by position.
    """
    k = [*keys, "form"]
    st = forms.groupBy(*k).agg(F.avg("value").alias("_mu"))
    e = forms.join(st, k).withColumn("e", F.col("value") - F.col("_mu")).withColumnRenamed("n", "_n")
    longest = e.agg(F.max("_n")).first()[0] or 1          # one number; sets how many lags are summed
    cov_top = int(longest ** (2 / 9) + 1e-9) + 1
    cov = F.floor(F.pow(F.col("_n"), F.lit(2.0 / 9.0)) + F.lit(1e-9))
    half = F.col("_n") / 2.0
    auto = (lag_table(e, k, "e", cov_top).where(F.col("lag") <= cov).groupBy(*k).agg(
        F.first("_n").alias("_n"),
        (F.sum(F.when(F.col("lag") == 0, F.col("e") * F.col("lagged"))) / F.first("_n")
         + F.coalesce(F.sum(F.when(F.col("lag") > 0, F.col("e") * F.col("lagged") / half)), F.lit(0.0))).alias("_s0"),
        F.coalesce(F.sum(F.when(F.col("lag") > 0, F.col("lag") * F.col("e") * F.col("lagged") / half)), F.lit(0.0)).alias("_s1")))
    gamma = 1.1447 * F.pow(F.pow(F.col("_s1") / F.col("_s0"), F.lit(2.0)), F.lit(1.0 / 3.0))
    band = auto.select(*k, F.least(F.floor(gamma * F.pow(F.col("_n"), F.lit(1.0 / 3.0))), F.col("_n") - 1).alias("used_lag"))
    s = prefix_sums(e, k, "i", {"S": F.col("e")}).join(band, k)
    ends = F.array(F.struct(F.col("i").alias("t"), F.col("S").alias("v"), (F.col("S") * F.col("S")).alias("ss")),
                   F.struct((F.col("i") + F.col("used_lag") + 1).alias("t"), (-F.col("S")).alias("v"), F.lit(0.0).alias("ss")))
    win = (s.withColumn("_e", F.explode(ends)).groupBy(*k, "_n", "used_lag", "_e.t").agg(F.sum("_e.v").alias("v"), F.sum("_e.ss").alias("ss")))
    tot = win.groupBy(*k, F.col("_n").alias("n"), "used_lag").agg(F.sum(F.col("v") * F.col("v")).alias("_q"), F.sum("ss").alias("_ss"))
    out = tot.withColumn("statistic", F.col("_ss") / (F.col("n") * F.col("n")) / (F.col("_q") / (F.col("n") * (F.col("used_lag") + 1))))
    return out.select(*k, "used_lag", "n", "statistic").withColumn("p", kpss_p_udf("statistic"))


def verdict(adf_rejects, kpss_rejects):
    return (F.when(adf_rejects & ~kpss_rejects, "stationary").when(~adf_rejects & kpss_rejects, "unit_root")
             .when(adf_rejects & kpss_rejects, "trend_or_break_suspected").otherwise("inconclusive"))


def stationarity_tests(forms: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Both tests on the `both_forms` frame, one row per key and form, with the form's verdict."""
    keys = KEYS if keys is None else keys
    k = [*keys, "form"]
    a = adf(forms, keys).select(*k, r6("tau").alias("adf_statistic"), r6("p").alias("adf_p"), F.col("used_lag").alias("adf_lag"), "observations",
                                r6("critical_5").alias("adf_critical_5"), (F.col("p") < 0.05).alias("_ar"))
    b = kpss(forms, keys).select(*k, r6("statistic").alias("kpss_statistic"), r6("p").alias("kpss_p"), F.col("used_lag").alias("kpss_lag"), (F.col("p") < 0.05).alias("_kr"))
    return a.join(b, k).withColumn("verdict", verdict(F.col("_ar"), F.col("_kr"))).drop("_ar", "_kr")


def stationarity(forms: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Verdict of the level and the transform it calls for."""
    keys = KEYS if keys is None else keys
    t = stationarity_tests(forms, keys)
    pick = lambda f: F.max(F.when(F.col("form") == f, F.col("verdict")))
    v = t.groupBy(*keys).agg(pick("level").alias("level_verdict"), pick("first_difference").alias("difference_verdict"))
    return v.withColumn("recommended_transform", F.when(F.col("level_verdict") == "stationary", "none").when(
        F.col("difference_verdict") == "stationary", "first_difference").otherwise("seasonal_or_structural_review"))
