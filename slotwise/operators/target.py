"""Statistics of one target series per `series_id` on its canonical grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_if, no_nan, per_day, r6, share
from ..functions.tails import chi2_upper_udf
from .align import Segment, explode_segments
from .common import (drop_halo, halo_window, lag_moments, moment_corr, prefix_sums, quantiles, ranked_values, top_k,
                     with_halo, with_lags)

SID = ["series_id"]
# Percentiles of the duration curve.
DURATION_PERCENTILES = (0, 1, 2, 5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 98, 99, 100)
MAD_TO_SD = 1.482602218505602


def only(aligned: DataFrame, target: str) -> DataFrame:
    return aligned.where(F.col("name") == target).drop("name")


def sample_skew(g, n):
    """Bias-corrected skewness from the population form."""
    return F.when(n >= 3, g * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurt(g, n):
    """Bias-corrected excess kurtosis from the population form."""
    return F.when(n >= 4, ((n + 1) * g + 6) * (n - 1) / ((n - 2) * (n - 3)))


def price_distribution(aligned: DataFrame, target: str) -> DataFrame:
    x = only(aligned, target)
    n = F.count("value").cast("double")
    base = x.groupBy("series_id").agg(
        F.count("value").alias("observations"), r6(F.avg("value")).alias("mean"),
        r6(F.stddev_samp("value")).alias("std"), r6(F.min("value")).alias("min"), r6(F.max("value")).alias("max"),
        r6(sample_skew(F.skewness("value"), n)).alias("skewness"),
        r6(sample_kurt(F.kurtosis("value"), n)).alias("kurtosis"))
    probs = {"q01": .01, "q05": .05, "q25": .25, "median": .5, "q75": .75, "q95": .95, "q99": .99}
    q = quantiles(x, SID, "value", probs)
    return base.join(q.select("series_id", *[r6(p).alias(p) for p in probs]), "series_id")


def rolling(df: DataFrame, keys: list[str], window: int, minimum: int, chunk: int | None = None) -> DataFrame:
    """Trailing mean and sample std over `window` slots where at least `minimum` values exist."""
    h = with_halo(df, keys, back=window - 1, chunk=chunk)
    w = halo_window(keys).rowsBetween(-(window - 1), 0)
    enough = F.count("value").over(w) >= minimum
    h = (h.withColumn("roll_mean", F.when(enough, F.avg("value").over(w)))
          .withColumn("roll_std", F.when(enough, F.stddev_samp("value").over(w))))
    return drop_halo(h)


def price_rolling(aligned: DataFrame, target: str, freq: str) -> DataFrame:
    x = only(aligned, target)
    day = per_day(freq)
    parts = []
    for label, window in (("one_day", day), ("seven_days", day * 7)):
        roll = rolling(x, SID, window, max(2, window // 2))
        parts.append(roll.groupBy("series_id").agg(
            F.lit(label).alias("span"), F.lit(window).cast("long").alias("window_intervals"),
            r6(F.max_by("roll_mean", F.when(F.col("roll_mean").isNotNull(), F.col("i")))).alias("latest_mean"),
            r6(F.max_by("roll_std", F.when(F.col("roll_std").isNotNull(), F.col("i")))).alias("latest_std"),
            r6(F.min("roll_mean")).alias("minimum_mean"), r6(F.max("roll_mean")).alias("maximum_mean"),
            r6(F.min("roll_std")).alias("minimum_std"), r6(F.max("roll_std")).alias("maximum_std")))
    out = parts[0].unionByName(parts[1])
    return out.join(changes(x, SID), "series_id")


def changes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Slope on the grid position, std of first differences and mean absolute change."""
    d = with_lags(df, keys, ["value"], [1]).withColumn("_d", F.col("value") - F.col("value_lag1"))
    return d.groupBy(*keys).agg(
        r6(F.regr_slope("value", "i")).alias("trend_slope_per_interval"),
        r6(F.stddev_samp("_d")).alias("first_difference_std"),
        r6(F.avg(F.abs("_d"))).alias("mean_absolute_change"))


def fences(df: DataFrame, keys: list[str], k: float) -> DataFrame:
    q = quantiles(df, keys, "value", {"q1": .25, "q3": .75})
    iqr = F.col("q3") - F.col("q1")
    return q.select(*keys, "q1", "q3", (F.col("q1") - k * iqr).alias("lower"), (F.col("q3") + k * iqr).alias("upper"))


def price_extremes(aligned: DataFrame, target: str, k: float = 3.0) -> DataFrame:
    x = only(aligned, target).where(F.col("value").isNotNull())
    j = x.join(fences(x, SID, k).select("series_id", "lower", "upper"), "series_id")
    v, n = F.col("value"), F.count(F.lit(1))
    return j.groupBy("series_id").agg(
        n.alias("observations"), r6(F.first("upper")).alias("upper_threshold"), r6(F.first("lower")).alias("lower_threshold"),
        count_if(v > F.col("upper")).alias("high_spike_count"), share(count_if(v > F.col("upper")), n).alias("high_spike_rate"),
        count_if(v < F.col("lower")).alias("extreme_low_count"), share(count_if(v < F.col("lower")), n).alias("extreme_low_rate"),
        count_if(v < 0).alias("negative_count"), share(count_if(v < 0), n).alias("negative_rate"),
        count_if(v == 0).alias("zero_count"), share(count_if(v == 0), n).alias("zero_rate"))


def extreme_examples(aligned: DataFrame, target: str, k: float = 3.0, limit: int = 10) -> DataFrame:
    """The `limit` highest and lowest values outside the fences, with their times."""
    x = only(aligned, target).where(F.col("value").isNotNull())
    j = x.join(fences(x, SID, k).select("series_id", "lower", "upper"), "series_id")
    hi = top_k(j.where(F.col("value") > F.col("upper")), SID, [F.desc("value"), "ts"], limit).withColumn("side", F.lit("high"))
    lo = top_k(j.where(F.col("value") < F.col("lower")), SID, [F.asc("value"), "ts"], limit).withColumn("side", F.lit("low"))
    return hi.unionByName(lo).select("series_id", "side", "rank", "ts", r6("value").alias("value"))


def price_autocorr(aligned: DataFrame, target: str, max_lag: int = 72) -> DataFrame:
    x = only(aligned, target)
    limit = x.groupBy("series_id").agg(F.greatest(F.count("value") - 2, F.lit(0)).alias("_max"))
    m = lag_moments(x, SID, "value", "value", max_lag).where((F.col("lag") > 0) & (F.col("n") > 0))
    return (m.select("series_id", "lag", r6(moment_corr()).alias("correlation"), F.col("n").alias("pairs"))
            .join(limit, "series_id").where(F.col("lag") <= F.col("_max")).drop("_max"))


def price_calendar(aligned: DataFrame, target: str, tz: str = "UTC") -> DataFrame:
    """Count, mean, median, std by hour, weekday (Monday 0), day type (weekend 1) and month."""
    from ..functions.columns import to_local
    x = only(aligned, target).where(F.col("value").isNotNull())
    t = to_local("ts", tz)
    groups = F.array(*[F.struct(F.lit(n).alias("grouping"), e.cast("long").alias("grp")) for n, e in (
        ("hour_of_day", F.hour(t)), ("day_of_week", F.weekday(t)),
        ("day_type", (F.weekday(t) >= 5).cast("int")), ("month", F.month(t)))])
    g = x.withColumn("_g", F.explode(groups)).select("series_id", "_g.grouping", "_g.grp", "value")
    keys = ["series_id", "grouping", "grp"]
    base = g.groupBy(*keys).agg(F.count(F.lit(1)).alias("observations"), r6(F.avg("value")).alias("mean"),
                                r6(F.stddev_samp("value")).alias("std"))
    return base.join(quantiles(g, keys, "value", {"median": .5}).select(*keys, r6("median").alias("median")), keys)


def iqr_outliers(df: DataFrame, keys: list[str], k: float = 1.5) -> DataFrame:
    """Outlier count per key; 0 when fewer than 4 values or the IQR is 0."""
    x = df.where(F.col("value").isNotNull())
    j = x.join(fences(x, keys, k), keys)
    v = F.col("value")
    out = (F.col("q3") > F.col("q1")) & ((v < F.col("lower")) | (v > F.col("upper")))
    return j.groupBy(*keys).agg(F.count(F.lit(1)).alias("observations"), count_if(out).alias("_o")).select(
        *keys, "observations", F.when(F.col("observations") >= 4, F.col("_o")).otherwise(F.lit(0)).cast("long").alias("outlier_count"))


def with_sequence(df: DataFrame, keys: list[str]) -> DataFrame:
    """Positions `seq` (1..n) over the rows that have a value, in grid order."""
    known = F.col("value").isNotNull().cast("long")
    return prefix_sums(df, keys, "i", {"seq": known}).where(F.col("value").isNotNull())


def runs(df: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Maximal runs of `flag` over a dense `seq`: one row (keys, length) per run."""
    p = prefix_sums(df, keys, "seq", {"_k": F.col(flag).cast("long")})
    return (p.where(flag).groupBy(*keys, (F.col("seq") - F.col("_k")).alias("_run"))
             .agg(F.count(F.lit(1)).alias("length")).drop("_run"))


def spike_regime(aligned: DataFrame, target: str, k: float = 3.0, keep=lambda df: df) -> DataFrame:
    x = only(aligned, target)
    f = fences(x, SID, k).select("series_id", "lower", "upper")
    s = (with_sequence(x, SID).join(f, "series_id")
         .withColumn("high", F.col("value") > F.col("upper")).withColumn("low", F.col("value") < F.col("lower"))
         .withColumn("calm", ~(F.col("high") | F.col("low"))))
    s = keep(s)
    nxt = drop_halo(with_halo(s, SID, ahead=1, order="seq")
                    .withColumn("_next", F.lead("high", 1).over(halo_window(SID, "seq"))))
    n = F.count(F.lit(1))
    base = nxt.groupBy("series_id").agg(
        n.alias("observations"), r6(F.first("upper")).alias("upper_threshold"), r6(F.first("lower")).alias("lower_threshold"),
        share(count_if(F.col("value") < 0), n).alias("negative_share"), share(count_if(F.col("value") == 0), n).alias("zero_share"),
        share(count_if(F.col("high")), n).alias("high_spike_share"), share(count_if(F.col("low")), n).alias("low_spike_share"),
        share(count_if(F.col("high") & F.col("_next")), count_if(F.col("high") & F.col("_next").isNotNull())).alias("spike_follows_spike"))
    out = base.withColumn("persistence_ratio", F.when(F.col("high_spike_share") > 0,
                                                      r6(F.col("spike_follows_spike") / F.col("high_spike_share"))))
    for flag in ("high", "low", "calm"):
        r = runs(s, SID, flag).groupBy("series_id").agg(
            n.alias(f"{flag}_episodes"), r6(F.avg("length")).alias(f"{flag}_mean_length"), F.max("length").alias(f"{flag}_max_length"))
        out = out.join(r, "series_id", "left")
    fill = {f"{f}_{m}": 0 for f in ("high", "low", "calm") for m in ("episodes", "max_length")}
    return out.na.fill(fill).drop("calm_episodes", "calm_mean_length").withColumnRenamed("calm_max_length", "longest_calm")


def spike_concentration(aligned: DataFrame, target: str, k: float = 3.0, limit: int = 5) -> DataFrame:
    """Hours and months that hold most high spikes."""
    x = only(aligned, target).where(F.col("value").isNotNull())
    s = x.join(fences(x, SID, k).select("series_id", "upper"), "series_id").where(F.col("value") > F.col("upper"))
    parts = F.array(F.struct(F.lit("hour").alias("part"), F.hour("ts").cast("long").alias("grp")),
                    F.struct(F.lit("month").alias("part"), F.month("ts").cast("long").alias("grp")))
    g = (s.withColumn("_p", F.explode(parts)).groupBy("series_id", "_p.part", "_p.grp")
          .agg(F.count(F.lit(1)).alias("spike_count")))
    tot = s.groupBy("series_id").agg(F.count(F.lit(1)).alias("_t"))
    t = top_k(g, ["series_id", "part"], [F.desc("spike_count"), "grp"], limit)
    return t.join(tot, "series_id").select("series_id", "part", "rank", "grp", "spike_count",
                                           share("spike_count", "_t").alias("share_of_spikes"))


def duration_curve(aligned: DataFrame, target: str) -> DataFrame:
    """Value exceeded for each share of the time (rank picked half-even, as round() does)."""
    rv = ranked_values(only(aligned, target), SID, "value")
    at = lambda p: F.bround(F.lit(p / 100.0) * (F.col("_n") - 1), 0)
    from_top = F.col("_n") - F.col("_before") - F.col("_cnt")     # rows above this value
    hit = lambda p: (from_top <= at(p)) & (at(p) < from_top + F.col("_cnt"))
    pts = F.array_compact(F.array(*[F.when(hit(p), F.lit(p)) for p in DURATION_PERCENTILES]))
    return (rv.withColumn("_p", F.explode(pts))
              .select("series_id", r6(F.col("_p") / 100.0).alias("exceedance_share"), r6("_v").alias("price")))


def duration_summary(aligned: DataFrame, target: str) -> DataFrame:
    x = only(aligned, target)
    rv = ranked_values(x, SID, "value")
    mean = x.groupBy("series_id").agg(F.avg("value").alias("_mean"))
    v, c, n, b = F.col("_v"), F.col("_cnt"), F.col("_n"), F.col("_before")
    tail = F.greatest(F.lit(1), F.bround(n * 0.05, 0)).cast("long")
    top = F.greatest(F.lit(0), F.least(c, b + c - (n - tail)))     # rows of this value in the top tail
    low = F.greatest(F.lit(0), F.least(c, tail - b))
    a = rv.join(mean, "series_id").groupBy("series_id").agg(
        F.max(n).alias("observations"),
        F.sum(F.when(v > 0, c).otherwise(0)).alias("_pos"), F.sum(F.when(v < 0, c).otherwise(0)).alias("_neg"),
        F.sum(F.when(v > F.col("_mean"), c).otherwise(0)).alias("_above"),
        (F.sum(v * top) / F.max(tail)).alias("_top"), (F.sum(v * low) / F.max(tail)).alias("_bot"),
        F.sum(F.greatest(v, F.lit(0.0)) * top).alias("_toppos"), F.sum(F.when(v > 0, v * c)).alias("_possum"))
    q = quantiles(x, SID, "value", {"p05": .05, "p50": .5, "p95": .95}).drop("n")
    return a.join(q, "series_id").select(
        "series_id", "observations", share("_pos", "observations").alias("share_above_zero"),
        share("_neg", "observations").alias("share_below_zero"), share("_above", "observations").alias("share_above_mean"),
        r6("_top").alias("top_5_percent_mean"), r6("_bot").alias("bottom_5_percent_mean"),
        F.when(F.col("_possum") > 0, r6(F.col("_toppos") / F.col("_possum"))).alias("top_5_percent_share"),
        r6(F.col("p95") - F.col("p05")).alias("spread_p95_minus_p05"),
        F.when(F.col("p50") > 0, r6(F.col("p95") / F.col("p50"))).alias("ratio_p95_to_median"))


def naive_baselines(aligned: DataFrame, target: str, freq: str) -> DataFrame:
    """Errors of repeating the last slot, the last day and the last week."""
    x, day = only(aligned, target), per_day(freq)
    lags = (("persistence", 1, 0), ("daily_naive", day, 2 * day), ("weekly_naive", day * 7, 14 * day))
    l = with_lags(x, SID, ["value"], sorted({k for _, k, _ in lags}))
    size = x.groupBy("series_id").agg(F.count(F.lit(1)).alias("_slots"))
    items = F.array(*[F.struct(F.lit(n).alias("baseline"), F.lit(k).cast("long").alias("lag_intervals"),
                               F.lit(need).cast("long").alias("need"), F.col(f"value_lag{k}").alias("p")) for n, k, need in lags])
    e = (l.withColumn("_b", F.explode(items)).join(size, "series_id")
          .where((F.col("_slots") > F.col("_b.need")) & F.col("value").isNotNull() & F.col("_b.p").isNotNull())
          .select("series_id", "_b.baseline", "_b.lag_intervals", (F.col("value") - F.col("_b.p")).alias("err"))
          .withColumn("abs_err", F.abs("err")))
    keys = ["series_id", "baseline"]
    m = e.groupBy(*keys).agg(
        F.max("lag_intervals").alias("lag_intervals"), F.count(F.lit(1)).alias("observations"), r6(F.avg("abs_err")).alias("mae"),
        r6(F.sqrt(F.avg(F.col("err") * F.col("err")))).alias("rmse"), r6(F.avg("err")).alias("bias"))
    m = m.join(quantiles(e, keys, "abs_err", {"m": .5}).select(*keys, r6("m").alias("median_absolute_error")), keys)
    w = Window.partitionBy("series_id")          # at most three rows per series
    ref = F.max(F.when(F.col("baseline") == "persistence", F.col("mae"))).over(w)
    best = F.min(F.struct("mae", "lag_intervals", "baseline")).over(w)
    m = m.withColumn("mae_ratio_to_persistence", F.when(ref > 0, r6(F.col("mae") / ref))).withColumn("is_best", best["baseline"] == F.col("baseline"))
    scale = (quantiles(x.withColumn("_a", F.abs("value")), SID, "_a", {"s": .5})
             .select("series_id", F.when(F.col("s") == 0, F.lit(1.0)).otherwise(F.col("s")).alias("_s")))
    near = (x.where(F.col("value").isNotNull()).join(scale, "series_id").groupBy("series_id")
             .agg(share(count_if(F.abs("value") < 0.01 * F.col("_s")), F.count(F.lit(1))).alias("near_zero_share")))
    return m.join(near, "series_id").withColumn("percentage_errors_reliable", F.col("near_zero_share") < 0.01)


def variance_stabilization(aligned: DataFrame, target: str, keep=lambda df: df) -> DataFrame:
    x = only(aligned, target).where(F.col("value").isNotNull())
    med = quantiles(x, SID, "value", {"center": .5}).drop("n")
    d = x.join(med, "series_id").withColumn("_dev", F.abs(F.col("value") - F.col("center")))
    d = keep(d)
    mad = quantiles(d, SID, "_dev", {"mad": .5}).where((F.col("n") >= 8) & (F.col("mad") > 0)).select(
        "series_id", (F.col("mad") * MAD_TO_SD).alias("scale"))
    z = d.join(mad, "series_id").withColumn("raw", (F.col("value") - F.col("center")) / F.col("scale"))
    z = z.withColumn("asinh", F.asinh("raw"))
    n = F.count(F.lit(1))
    aggs = [n.alias("observations"), r6(F.first("center")).alias("robust_center"), r6(F.first("scale")).alias("robust_scale")]
    for c in ("raw", "asinh"):
        s, k = F.skewness(c), F.kurtosis(c)
        jb = n / 6 * (s * s + k * k / 4)
        aggs += [r6(s).alias(f"{c}_skewness"), r6(k).alias(f"{c}_kurtosis"), r6(jb, 4).alias(f"{c}_jarque_bera"),
                 r6(F.exp(-jb / 2)).alias(f"{c}_p_value"), share(count_if(F.abs(c) > 5), n).alias(f"{c}_share_beyond_5")]
    return z.groupBy("series_id").agg(*aggs).withColumn(
        "recommended_transform", F.when(F.abs("asinh_kurtosis") < F.abs("raw_kurtosis") * 0.8, F.lit("asinh_median_mad")).otherwise(F.lit("none")))


def segment_stats(aligned: DataFrame, target: str, segments: list[Segment], min_obs: int = 3, tz: str = "UTC", keep=lambda df: df) -> DataFrame:
    s = keep(explode_segments(only(aligned, target), segments, tz))
    keys = ["series_id", "segment_id"]
    base = s.groupBy(*keys, "kind", "ord").agg(
        F.count(F.lit(1)).alias("selected_rows"), F.count("value").alias("observations"),
        share(F.count("value"), F.count(F.lit(1))).alias("coverage"), (F.count("value") >= min_obs).alias("sufficient"),
        r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("std"),
        r6(F.min("value")).alias("minimum"), r6(F.max("value")).alias("maximum"))
    q = quantiles(s, keys, "value", {"q25": .25, "median": .5, "q75": .75})
    return base.join(q.select(*keys, *[r6(c).alias(c) for c in ("q25", "median", "q75")]), keys, "left")


def overlaps(rows: DataFrame, keys: list[str], segments: list[Segment], tz: str = "UTC") -> DataFrame:
    """Rows shared by each pair of same-kind segments; the pair list depends on the segments only."""
    pairs = [(a, b) for i, a in enumerate(segments) for b in segments[i + 1:] if a.kind == b.kind]
    items = F.array(*[F.struct(F.lit(a.segment_id).alias("left_id"), F.lit(b.segment_id).alias("right_id"),
                               (a.mask(tz=tz) & b.mask(tz=tz)).cast("long").alias("both")) for a, b in pairs])
    return (rows.withColumn("_p", F.explode(items)).groupBy(*keys, "_p.left_id", "_p.right_id")
                .agg(F.sum("_p.both").alias("overlap_rows")))


def compare_price_segments(aligned: DataFrame, target: str, segments: list[Segment], min_obs: int = 3, tz: str = "UTC", keep=lambda df: df) -> DataFrame:
    """Contrasts left - right for every pair of segments of one kind."""
    s = keep(segment_stats(aligned, target, segments, min_obs, tz, keep))
    l = s.select("series_id", "kind", F.col("segment_id").alias("left_id"), F.col("ord").alias("_lo"),
                 *[F.col(c).alias(f"_l_{c}") for c in ("mean", "median", "std")])
    r = s.select("series_id", "kind", F.col("segment_id").alias("right_id"), F.col("ord").alias("_ro"),
                 *[F.col(c).alias(f"_r_{c}") for c in ("mean", "median", "std")])
    j = l.join(r, ["series_id", "kind"]).where(F.col("_lo") < F.col("_ro"))
    o = overlaps(only(aligned, target), SID, segments, tz)
    return j.join(o, ["series_id", "left_id", "right_id"]).select(
        "series_id", "kind", "left_id", "right_id", "overlap_rows",
        *[r6(F.col(f"_l_{c}") - F.col(f"_r_{c}")).alias(f"{c}_difference") for c in ("mean", "median", "std")])


def histogram(df: DataFrame, keys: list[str], col: str = "value") -> DataFrame:
    """Equal-width histogram with clamp(round(sqrt(n)), 12, 60) bins; the last bin is closed."""
    x = df.where(F.col(col).isNotNull())
    ext = x.groupBy(*keys).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"), F.count(F.lit(1)).alias("_n")).withColumn(
        "bins", F.least(F.greatest(F.bround(F.sqrt("_n"), 0), F.lit(12)), F.lit(60)).cast("long"))
    width = (F.col("_hi") - F.col("_lo")) / F.col("bins")
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col(col) - F.col("_lo")) / width), F.col("bins") - 1)).otherwise(F.lit(0))
    return (x.join(ext, keys).withColumn("bin", at.cast("long")).withColumn("_left", F.col("_lo") + F.col("bin") * width)
             .groupBy(*keys, "bins", "bin").agg(r6(F.first("_left")).alias("left_edge"), F.count(F.lit(1)).alias("observations")))


def decompose(filled: DataFrame, freq: str, keys: list[str] | None = None, passes: int = 2) -> DataFrame:
    """Additive trend + day + week split of a gap-free series.

    The trend is a centred moving average over one week (one day when two weeks
    are not there), read from a halo; the seasonal parts are per-phase means,
    refined by `passes` rounds of day then week. Not a LOESS fit, on purpose:
    every step is a window with a halo or a grouped mean.
    """
    keys = SID if keys is None else keys
    day, week = per_day(freq), per_day(freq) * 7
    size = filled.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    x = filled.join(size, keys).where(F.col("_n") >= 2 * day)
    half_w, half_d = week // 2, day // 2
    h = with_halo(x, keys, back=half_w, ahead=half_w)
    w = halo_window(keys)
    wide, short = w.rowsBetween(-half_w, half_w), w.rowsBetween(-half_d, half_d)
    h = h.withColumn("trend", F.when(F.col("_n") >= 2 * week, F.avg("value").over(wide)).otherwise(F.avg("value").over(short)))
    x = drop_halo(h).withColumn("_pw", F.col("i") % week)
    # The week phase fixes the day phase, so the rounds run on one row per week phase, not on the series.
    s = (x.groupBy(*keys, "_pw", "_n").agg(F.sum(F.col("value") - F.col("trend")).alias("_s"), F.count(F.lit(1)).alias("_k"))
          .withColumn("_pd", F.col("_pw") % day).withColumn("day", F.lit(0.0)).withColumn("week", F.lit(0.0)))
    same_hour, whole = Window.partitionBy(*keys, "_pd"), Window.partitionBy(*keys)
    for _ in range(passes):
        s = s.withColumn("_m", F.sum(F.col("_s") - F.col("_k") * F.col("week")).over(same_hour) / F.sum("_k").over(same_hour))
        s = s.withColumn("_w", 1.0 / F.count(F.lit(1)).over(same_hour))
        s = s.withColumn("day", F.col("_m") - F.sum(F.col("_m") * F.col("_w")).over(whole) / F.sum("_w").over(whole))
        s = s.withColumn("_m", F.col("_s") / F.col("_k") - F.col("day"))
        s = s.withColumn("week", F.when(F.col("_n") >= 2 * week, F.col("_m") - F.avg("_m").over(whole)).otherwise(F.lit(0.0)))
    x = x.join(s.select(*keys, "_pw", "day", "week"), [*keys, "_pw"])
    return x.withColumn("remainder", F.col("value") - F.col("trend") - F.col("day") - F.col("week")).drop("_pw", "_n")


def decomposition_summary(parts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Strengths, variance shares and the daily shape of a `decompose` result."""
    keys = SID if keys is None else keys
    var = F.var_pop
    a = parts.groupBy(*keys).agg(
        *[var(c).alias(f"_v_{c}") for c in ("trend", "day", "week", "remainder")],
        *[var(F.col("remainder") + F.col(c)).alias(f"_d_{c}") for c in ("trend", "day", "week")], F.count(F.lit(1)).alias("observations"))
    total = sum(F.col(f"_v_{c}") for c in ("trend", "day", "week", "remainder"))
    strength = lambda c: F.when(F.col(f"_d_{c}") > 0, r6(F.greatest(F.lit(0.0), 1 - F.col("_v_remainder") / F.col(f"_d_{c}"))))
    hours = parts.groupBy(*keys, F.hour("ts").cast("long").alias("_h")).agg(r6(F.avg("day")).alias("_m"))
    shape = hours.groupBy(*keys).agg(
        F.min_by("_h", F.struct(-F.col("_m"), F.col("_h"))).alias("peak_hour"), F.min_by("_h", F.struct("_m", "_h")).alias("trough_hour"),
        r6(F.max("_m") - F.min("_m")).alias("peak_to_trough"))
    return a.join(shape, keys).select(
        *keys, "observations", *[strength(c).alias(f"{c}_strength") for c in ("trend", "day", "week")],
        *[r6(F.col(f"_v_{c}") / total).alias(f"{c}_share") for c in ("trend", "day", "week", "remainder")],
        r6(F.sqrt("_v_remainder")).alias("remainder_std"), "peak_hour", "trough_hour", "peak_to_trough")


def autocovariances(filled: DataFrame, keys: list[str], max_lag: int) -> DataFrame:
    """Sums of (x(t)-m)(x(t-k)-m) for k = 0..max_lag and n, one row per lag."""
    n = filled.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    m = lag_moments(filled, keys, "value", "value", max_lag)
    return m.select(*keys, "lag", F.col("sxy").alias("s")).join(n, keys)


# Fixed value: the longest lag of a series.
LAG_CEILING = 400         # longest lag of the recursions that run over the sums of one series


def checked_lag(max_lag: int, ceiling: int = LAG_CEILING) -> int:
    if max_lag > ceiling:
        raise ValueError(f"max_lag {max_lag} is beyond the ceiling of {ceiling}")
    return max_lag


def lag_limit(n, max_lag: int):
    return F.least(F.lit(checked_lag(max_lag)), F.greatest(F.lit(1), F.floor(n / 2) - 1))


def price_pacf(filled: DataFrame, max_lag: int, keys: list[str] | None = None) -> DataFrame:
    """Partial autocorrelations (Yule-Walker): Durbin-Levinson over at most 400 sums per series."""
    import numpy as np
    import pandas as pd
    keys = SID if keys is None else keys
    s = autocovariances(filled, keys, checked_lag(max_lag)).where(F.col("lag") <= lag_limit(F.col("n"), max_lag))

    def levinson(key, pdf):
        pdf = pdf.sort_values("lag")
        rho = (pdf["s"] / pdf["s"].iloc[0]).to_numpy()
        phi, out, var = np.zeros(0), [], 1.0
        for k in range(1, len(rho)):
            a = (rho[k] - phi @ rho[k - 1:0:-1]) / var if k > 1 else rho[1]
            phi = np.append(phi - a * phi[::-1], a)
            var *= 1.0 - a * a
            out.append(a)
        return pd.DataFrame({**dict(zip(keys, key)), "lag": np.arange(1, len(rho)), "partial": out, "n": int(pdf["n"].iloc[0])})

    schema = ", ".join(f"{k} string" for k in keys) + ", lag long, partial double, n long"
    band = F.lit(1.96) / F.sqrt("n")
    return s.groupBy(*keys).applyInPandas(levinson, schema).select(
        *keys, "lag", r6("partial").alias("partial_correlation"), (F.abs("partial") > band).alias("significant"), r6(band).alias("band"))


def ljung_box(filled: DataFrame, freq: str, max_lag: int, keys: list[str] | None = None) -> DataFrame:
    """Ljung-Box statistic and p at lags 1, 2, one day, one week and the limit."""
    keys = SID if keys is None else keys
    s = autocovariances(filled, keys, checked_lag(max_lag))
    w = Window.partitionBy(*keys)                             # at most 401 sums per series
    day = per_day(freq)
    r = s.withColumn("_r", F.col("s") / F.max(F.when(F.col("lag") == 0, F.col("s"))).over(w)).where(F.col("lag") >= 1)
    run = w.orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    q = r.withColumn("statistic", F.col("n") * (F.col("n") + 2) * F.sum(F.col("_r") * F.col("_r") / (F.col("n") - F.col("lag"))).over(run))
    limit = lag_limit(F.col("n"), max_lag)
    keep = (F.col("lag") <= limit) & (F.col("lag").isin(1, 2, day, 7 * day) | (F.col("lag") == limit))
    return q.where(keep).select(*keys, "lag", r6("statistic").alias("statistic"),
                                r6(chi2_upper_udf("statistic", F.col("lag").cast("double"))).alias("p_value"))


