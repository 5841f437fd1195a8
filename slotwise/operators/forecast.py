"""Point-in-time forecast input, baselines, similar days and backtest metrics.

Every frame is keyed by (series_id, fold_id), so all folds of all markets are one job.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import count_if, freq_seconds, hours_between, no_nan, r6, shift_ts
from .align import grid
from .common import drop_halo, gram, halo_window, latest, prefix_sums, quantiles, top_k, with_halo
from .quality import complete_days

KEYS = ["series_id", "fold_id"]
# Source column -> model column.
ACTUAL_MAP = {"actual_load": "actual_load", "total_generation": "act_total_gen", "non_market_output": "non_market_output", "renewable_output": "act_new_energy_total", "actual_wind": "act_new_energy_wind",
              "actual_solar": "act_new_energy_solar", "actual_hydro": "act_hydro", "positive_reserve": "positive_reserve", "negative_reserve": "negative_reserve"}
# Source column -> model column of forecasts, weather columns, lags and windows of price features.
FORECAST_MAP = {"forecast_load": "fcst_load_type_11", "forecast_generation": "fcst_total_gen", "forecast_hydro": "fcst_water"}
WEATHER = ("temperature", "wind_speed_eighty", "cloud_cover", "solar_radiation", "hour_precipitation")
PRICE_LAGS = (2, 4, 8, 96, 192, 672)
PRICE_WINDOWS = (4, 16, 96, 672)
# Daily factor name -> (model column, aggregate).
FACTORS = {"net_load": ("fcst_net_load", "avg"), "load": ("fcst_load_type_11", "avg"), "renewable": ("fcst_re_total", "avg"), "solar_output": ("fcst_new_energy_pv_unified", "max"), "temperature": ("wx_temperature", "avg"),
           "wind": ("wx_wind_speed_eighty", "avg"), "cloud": ("wx_cloud_cover", "avg"), "radiation": ("wx_solar_radiation", "max"), "precipitation": ("wx_hour_precipitation", "sum")}
# Price limits and the spike level.
PRICE_FLOOR, PRICE_CAP, SPIKE = -120.0, 1500.0, 500.0


SHARES = 256


def visible(df: DataFrame, as_of: str, future: bool = False, keys: list[str] | None = None) -> DataFrame:
    """Newest version per timestamp that had arrived by `as_of`; actuals also must not lie after it."""
    at = F.lit(as_of).cast("timestamp")
    v = df.where(F.col("available_at") <= at)
    return latest(v if future else v.where(F.col("ts") <= at), [*(keys or ["series_id"]), "ts"], ["available_at", "tie"])


def visible_at_folds(df: DataFrame, folds: DataFrame, future: bool = False) -> DataFrame:
    """`visible` at every fold's cutoff at once; a market has a handful of folds and `tie` is a number.

    Rows of one slot and arrival are one row before cutoffs are met, as every fold sees all of them or none. Both steps hold
    plain numbers only, which Spark combines in hash maps; a struct would be sorted, every row of a task at once.
    Cutoffs are copied into SHARES shares of the time line, so that the rows of a market do not meet in one task.
    """
    rest = [c for c in df.columns if c not in ("series_id", "ts", "available_at", "tie")]
    tie = F.coalesce("tie", F.lit(-(1 << 63)))
    once = df.groupBy("series_id", "ts", "available_at").agg(*[F.max_by(c, tie).alias(c) for c in [*rest, "tie"]])
    cuts = folds.select("series_id", "fold_id", "as_of").withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    v = once.withColumn("_share", F.pmod(F.hash("ts", "available_at"), F.lit(SHARES))).join(cuts, ["series_id", "_share"]).drop("_share").where(F.col("available_at") <= F.col("as_of"))
    v = v if future else v.where(F.col("ts") <= F.col("as_of"))
    order = [c for c in df.columns if c not in ("series_id", "ts")]
    return v.groupBy(*KEYS, "ts").agg(*[F.max_by(c, "available_at").alias(c) for c in order])


def backtest_anchors(target: DataFrame, now: str, slots: int = 96, folds: int = 3, max_age: int = 90, gap: int = 7) -> DataFrame:
    """Newest complete days at most `max_age` days old and at least `gap` days apart, oldest first."""
    today = F.lit(now).cast("date")
    d = complete_days(target, slots).where((F.col("day") < today) & (F.datediff(today, F.col("day")) <= max_age))
    days = d.groupBy("series_id").agg(F.sort_array(F.collect_list("day"), False).alias("_d"))     # at most `max_age` days
    start = F.array().cast("array<date>")
    pick = F.aggregate("_d", start, lambda acc, x: F.when((F.size(acc) < folds) & ((F.size(acc) == 0) | (F.datediff(F.element_at(acc, -1), x) >= gap)), F.concat(acc, F.array(x))).otherwise(acc))
    p = days.select("series_id", F.sort_array(pick).alias("_p")).where(F.size("_p") == folds)
    return p.select("series_id", F.posexplode("_p").alias("fold_id", "target_day")).withColumn("fold_id", (F.col("fold_id") + 1).cast("long"))


def backtest_origins(anchors: DataFrame, origin: str) -> DataFrame:
    """Fold cutoffs with the lead time the live forecast from `origin` has to the next midnight."""
    o = F.lit(origin).cast("timestamp")
    lead = F.unix_seconds(F.date_add(F.to_date(o), 1).cast("timestamp")) - F.unix_seconds(o)
    s = F.col("target_day").cast("timestamp")
    return anchors.select("series_id", "fold_id", shift_ts(s, -lead).alias("as_of"), s.alias("target_start"), shift_ts(s, 86400).alias("target_end"))


def snapshots(target: DataFrame, actuals: DataFrame, forecasts: DataFrame, folds: DataFrame, freq: str = "15min") -> DataFrame:
    """Model input of every fold on a gap-free grid up to its target end, from what was visible at its cutoff.

    Adds net load, weather (history up to the cutoff, forecast after it) and source flags. Columns absent from the
    sources stay absent.
    """
    t = visible_at_folds(target, folds).select(*KEYS, "ts", F.col("rt_price"))
    a = visible_at_folds(actuals, folds).drop("available_at", "tie")
    f = visible_at_folds(forecasts, folds, future=True).drop("available_at", "tie")
    a = a.select(*KEYS, "ts", *[F.col(c).alias(f"a_{c}") for c in a.columns if c not in (*KEYS, "ts")])
    f = f.select(*KEYS, "ts", *[F.col(c).alias(f"f_{c}") for c in f.columns if c not in (*KEYS, "ts")])
    lo = t.select(*KEYS, "ts").unionByName(a.select(*KEYS, "ts")).unionByName(f.select(*KEYS, "ts")).groupBy(*KEYS).agg(F.min("ts").alias("lo"))
    step = freq_seconds(freq)
    b = lo.join(folds, KEYS).withColumn("hi", shift_ts("target_end", -step)).where(F.col("lo") <= F.col("hi"))
    g = grid(b, freq).select(*KEYS, "as_of", "target_start", "target_end", "ts", "i")
    j = g.join(t, [*KEYS, "ts"], "left").join(a, [*KEYS, "ts"], "left").join(f, [*KEYS, "ts"], "left")
    has = set(j.columns)
    out = [*g.columns, no_nan("rt_price").alias("rt_price")]
    out += [F.col(f"a_{s}").alias(d) for s, d in ACTUAL_MAP.items() if f"a_{s}" in has]
    out += [F.col(f"f_{s}").alias(d) for s, d in FORECAST_MAP.items() if f"f_{s}" in has]
    wind, solar = (F.col(f"f_{c}") if f"f_{c}" in has else None for c in ("forecast_wind", "forecast_solar"))
    out += [c.alias(n) for c, n in ((wind, "fcst_new_energy_type_4"), (solar, "fcst_new_energy_pv_unified")) if c is not None]
    parts = [c for c in (wind, solar) if c is not None]
    if parts:
        total = sum((F.coalesce(c, F.lit(0.0)) for c in parts), F.lit(0.0))
        re = F.when(F.coalesce(*parts).isNotNull(), total)
        out.append(re.alias("fcst_re_total"))
        if "f_forecast_load" in has:
            out.append((F.col("f_forecast_load") - re).alias("fcst_net_load"))
    past = F.col("ts") <= F.col("as_of")
    wx = []
    for c in WEATHER:
        h, p = (F.col(f"{k}_{c}") if f"{k}_{c}" in has else F.lit(None).cast("double") for k in ("a", "f"))
        wx.append(F.when(past, h).otherwise(p))
    out += [w.alias(f"wx_{c}") for w, c in zip(wx, WEATHER)]
    seen = sum((w.isNotNull().cast("double") for w in wx), F.lit(0.0))
    out += [past.cast("double").alias("wx_source_hist"), (~past).cast("double").alias("wx_source_forecast"), (seen > 0).cast("double").alias("wx_weather_available_mask"), (seen / len(WEATHER)).alias("wx_weather_core_coverage")]
    return j.select(*out)


def preflight(target: DataFrame, snapshot: DataFrame, folds: DataFrame, min_history: int = 2016, min_horizon: int = 72) -> DataFrame:
    """One row per fold and gate: freshness (over 24 h rejects, over 2 h warns), history points, horizon coverage."""
    v = visible_at_folds(target, folds).where(F.col("rt_price").isNotNull())
    f = folds.join(v.groupBy(*KEYS).agg(F.max("ts").alias("_last"), F.count(F.lit(1)).alias("_hist")), KEYS, "left")
    horizon = (F.col("ts") >= F.col("target_start")) & (F.col("ts") < F.col("target_end"))
    h = snapshot.where(horizon).groupBy(*KEYS).agg(count_if(F.col("fcst_load_type_11").isNotNull()).alias("_h"))
    age = hours_between("as_of", "_last")
    j = f.join(h, KEYS, "left").na.fill({"_hist": 0, "_h": 0})
    gates = F.array(F.struct(F.lit("freshness_hours").alias("gate"), r6(age).alias("value"), F.when(age.isNull() | (age > 24), "reject").when(age > 2, "warn").otherwise("pass").alias("status")),
                    F.struct(F.lit("history_points").alias("gate"), F.col("_hist").cast("double").alias("value"), F.when(F.col("_hist") >= min_history, "pass").otherwise("reject").alias("status")),
                    F.struct(F.lit("horizon_points").alias("gate"), F.col("_h").cast("double").alias("value"), F.when(F.col("_h") >= min_horizon, "pass").otherwise("reject").alias("status")))
    return j.select(*KEYS, F.explode(gates).alias("_g")).select(*KEYS, "_g.*")


def _shifted(snapshot: DataFrame, seconds: int, name: str) -> DataFrame:
    return snapshot.where(F.col("rt_price").isNotNull()).select(*KEYS, shift_ts("ts", seconds).alias("ts"), F.col("rt_price").alias(name))


def origin_baselines(snapshot: DataFrame) -> DataFrame:
    """Target slots with the last price before the target, the price a day and a week earlier."""
    s = snapshot.where((F.col("ts") >= F.col("target_start")) & (F.col("ts") < F.col("target_end"))).select(*KEYS, "ts")
    last = snapshot.where((F.col("ts") < F.col("target_start")) & F.col("rt_price").isNotNull()).groupBy(*KEYS).agg(F.max_by("rt_price", "ts").alias("persistence"))
    d, w = _shifted(snapshot, 86400, "day_naive"), _shifted(snapshot, 7 * 86400, "week_naive")
    return s.join(last, KEYS, "left").join(d, [*KEYS, "ts"], "left").join(w, [*KEYS, "ts"], "left")


def baseline_overlap(snapshot: DataFrame) -> DataFrame:
    """Target slots that have both the day and the week baseline."""
    return origin_baselines(snapshot).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("points"), count_if(F.col("day_naive").isNotNull() & F.col("week_naive").isNotNull()).alias("common_points"))


def raw_features(snapshot: DataFrame, slots: int = 96) -> DataFrame:
    """Causal features before filling: calendar waves, price lags, shifted rolling moments, ramps, future-visible columns, driver lags."""
    h = F.hour("ts") + F.minute("ts") / 60.0
    slot = F.floor((F.hour("ts") * 60 + F.minute("ts")) / (1440 / slots))
    two_pi = F.lit(2 * math.pi)
    wave = {"hour": h / 24.0, "slot": slot / float(slots), "dow": F.weekday("ts") / 7.0}
    price = F.when(F.col("ts") <= F.col("as_of"), F.col("rt_price"))
    known = [c for c in snapshot.columns if c not in (*KEYS, "as_of", "target_start", "target_end", "ts", "i", "rt_price")]
    future = [c for c in known if c.startswith(("fcst_", "wx_", "news_"))]
    actual = [c for c in known if c not in future]
    s = snapshot.withColumn("_p", price)
    for c in actual:
        s = s.withColumn(c, F.when(F.col("ts") <= F.col("as_of"), F.col(c)))
    back = max(*PRICE_LAGS, *PRICE_WINDOWS) + 1
    x = with_halo(s, KEYS, back=back)
    w = halo_window(KEYS)
    cols = [F.lag("_p", k).over(w).alias(f"price_lag_{k}") for k in PRICE_LAGS]
    for n in PRICE_WINDOWS:
        fr = w.rowsBetween(-n, -1)
        enough = F.count("_p").over(fr) >= min(16, n)
        cols += [F.when(enough, F.avg("_p").over(fr)).alias(f"price_mean_{n}"), F.when(enough, F.stddev_samp("_p").over(fr)).alias(f"price_std_{n}")]
    cols += [(F.lag("_p", 1).over(w) - F.lag("_p", 2).over(w)).alias("price_ramp_1"), (F.lag("_p", 1).over(w) - F.lag("_p", 5).over(w)).alias("price_ramp_4")]
    cols += [F.lag(c, k).over(w).alias(f"hist_{c}_lag{k}") for c in actual for k in (96, 672)]
    if "fcst_net_load" in future:
        cols.append((F.col("fcst_net_load") - F.lag("fcst_net_load", 4).over(w)).alias("net_load_ramp_4"))
    x = drop_halo(x.select("*", *cols))
    waves = [f(two_pi * v).alias(f"{n}_{t}") for n, v in wave.items() for t, f in (("sin", F.sin), ("cos", F.cos))]
    extra = [(F.weekday("ts") >= 5).cast("double").alias("weekend")]
    if {"fcst_re_total", "fcst_load_type_11"} <= set(future):
        extra.append(F.when(F.col("fcst_load_type_11") != 0, F.col("fcst_re_total") / F.col("fcst_load_type_11")).alias("renewable_load_ratio"))
    if "fcst_new_energy_pv_unified" in future:
        pv = F.col("fcst_new_energy_pv_unified")
        extra += [(F.col(c) * pv).alias(n) for c, n in (("wx_solar_radiation", "solar_pv_interaction"), ("wx_cloud_cover", "cloud_pv_interaction")) if c in future]
    return x.select("*", *waves, *extra).drop("_p", *actual)


def feature_names(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c not in (*KEYS, "as_of", "target_start", "target_end", "ts", "i", "rt_price")]


def fill_from_training(features: DataFrame) -> DataFrame:
    """Fill every feature with its exact median over the training rows, else 0."""
    names = feature_names(features)
    items = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in names])
    long = features.where(F.col("ts") <= F.col("as_of")).select(*KEYS, F.explode(items).alias("_i")).select(*KEYS, "_i.name", "_i.value").where(F.col("value").isNotNull())
    med = quantiles(long, [*KEYS, "name"], "value", {"m": .5}).groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("name", "m"))).alias("_m"))
    j = features.join(med, KEYS, "left")
    return j.select(*[c for c in features.columns if c not in names], *[F.coalesce(F.col(c).cast("double"), F.element_at("_m", F.lit(c)), F.lit(0.0)).alias(c) for c in names])


def daily_factors(snapshot: DataFrame) -> DataFrame:
    """Per-day factors of each fold: forecast and weather levels, price range, negative and spike ratios."""
    fn = {"avg": F.avg, "max": F.max, "sum": F.sum}
    has = set(snapshot.columns)
    aggs = [fn[how](c).alias(n) for n, (c, how) in FACTORS.items() if c in has]
    p = F.col("rt_price")
    aggs += [F.avg(p).alias("price_mean"), (F.max(p) - F.min(p)).alias("price_range"), F.avg(F.coalesce((p < 0).cast("double"), F.lit(0.0))).alias("negative_ratio"),
             F.avg(F.coalesce((p >= SPIKE).cast("double"), F.lit(0.0))).alias("spike_ratio"), count_if(p.isNotNull() & (F.col("ts") <= F.col("as_of"))).alias("points")]
    return snapshot.groupBy(*KEYS, "as_of", "target_start", F.to_date("ts").alias("day")).agg(*aggs)


def similar_days(factors: DataFrame, k: int = 7, windows: tuple[int, ...] = (30, 90, 240), min_points: int = 90, keep=lambda df: df) -> DataFrame:
    """The k most similar complete days before each target day, with weights; calendar days where no factor is shared.

    Distances per factor are scaled by its IQR over the candidates; a missing factor costs two scales, another
    weekday 0.35. Days are one row per date, so a fold ranks at most its own history of days. `keep` persists the
    scored days and the picks, which several steps read.
    """
    names = [n for n in FACTORS if n in factors.columns]
    day0 = F.to_date("target_start")
    tgt = factors.where(F.col("day") == day0).select(*KEYS, *[F.col(n).alias(f"_t_{n}") for n in names])
    cand = factors.where((F.col("day") < day0) & (F.col("points") >= min_points)).select(*KEYS, "day", day0.alias("target_day"), *names)
    items = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])
    long = cand.select(*KEYS, F.explode(items).alias("_i")).select(*KEYS, "_i.name", "_i.value")
    q = quantiles(long, [*KEYS, "name"], "value", {"q1": .25, "q3": .75})
    sd = long.groupBy(*KEYS, "name").agg(F.stddev_samp("value").alias("_sd"))
    iqr = F.col("q3") - F.col("q1")
    sc = q.join(sd, [*KEYS, "name"]).select(*KEYS, "name", F.when(iqr > 1e-6, iqr).otherwise(F.greatest(F.coalesce("_sd", F.lit(1.0)), F.lit(1.0))).alias("s"))
    sc = sc.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("name", "s"))).alias("_s"))
    j = cand.join(tgt, KEYS, "left").join(sc, KEYS, "left")
    scale = {n: F.element_at("_s", F.lit(n)) for n in names}
    used = {n: F.col(f"_t_{n}").isNotNull() & scale[n].isNotNull() for n in names}
    dist = sum((F.when(used[n], F.coalesce(F.abs(F.col(n) - F.col(f"_t_{n}")), scale[n] * 2) / scale[n]).otherwise(F.lit(0.0)) for n in names), F.lit(0.0))
    weight = sum((used[n].cast("int") for n in names), F.lit(0))
    same = F.weekday("day") == F.weekday("target_day")
    j = j.withColumn("_w", weight).withColumn("score", F.when(F.col("_w") > 0, F.round(dist / F.col("_w") + F.when(same, 0.0).otherwise(0.35), 9)))
    j = j.withColumn("age", F.datediff("target_day", "day"))
    base = keep(j.select(*KEYS, "day", "score", "age", same.alias("same")))
    scored = base.where(F.col("score").isNotNull())
    order = [F.asc("score"), F.asc("day")]
    picks = None
    for pos, (limit, take) in enumerate([*[(w, max(1, k // 3)) for w in windows], (None, 2 * k)]):
        src = scored if limit is None else scored.where(F.col("age") <= limit)
        p = top_k(src, KEYS, order, take, "_r").withColumn("_o", F.lit(pos))
        picks = p if picks is None else picks.unionByName(p)
    best = picks.groupBy(*KEYS, "day").agg(F.min(F.struct("_o", "_r")).alias("_k"), F.first("score").alias("score"))
    chosen = keep(top_k(best, KEYS, [F.asc("_k")], k, "pick"))
    med = Window.partitionBy(*KEYS)                                                 # at most k rows
    chosen = chosen.withColumn("_e", F.exp(-F.col("score") / F.greatest(F.percentile("score", F.lit(0.5)).over(med), F.lit(0.7))))
    chosen = chosen.withColumn("weight", F.col("_e") / F.sum("_e").over(med)).select(*KEYS, "day", "pick", "score", "weight")
    # Folds without a usable factor fall back to the newest days of the same weekday, else the newest days.
    blank = base.join(chosen.select(*KEYS).distinct(), KEYS, "left_anti")
    any_same = blank.groupBy(*KEYS).agg(F.max(F.col("same").cast("int")).alias("_any"))
    blank = blank.join(any_same, KEYS).where((F.col("_any") == 0) | F.col("same"))
    back = top_k(blank, KEYS, [F.desc("day")], k, "pick")
    back = back.withColumn("weight", 1.0 / F.count(F.lit(1)).over(med)).select(*KEYS, "day", "pick", F.lit(None).cast("double").alias("score"), "weight")
    return chosen.unionByName(back)


def similar_day_prior(snapshot: DataFrame, days: DataFrame, slots: int = 96) -> DataFrame:
    """Weighted curve and spread over the chosen days; days with missing points are stretched over the slots by position."""
    step = 86400 // slots
    p = snapshot.where(F.col("rt_price").isNotNull() & (F.col("ts") <= F.col("as_of"))).withColumn("day", F.to_date("ts"))
    d = p.select(*KEYS, "target_start", "day", "ts", "rt_price").join(days, [*KEYS, "day"])
    curve = d.groupBy(*KEYS, "target_start", "day", "weight").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "rt_price"))), lambda s: s["rt_price"]).alias("_c"))   # one day
    e = curve.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    pos = F.col("slot") / float(slots - 1) * (F.size("_c") - 1)
    lo = F.floor(pos).cast("int")
    v = F.get("_c", lo) + (F.coalesce(F.get("_c", lo + 1), F.get("_c", lo)) - F.get("_c", lo)) * (pos - lo)
    e = e.withColumn("_v", v)
    return e.groupBy(*KEYS, shift_ts("target_start", F.col("slot") * step).alias("ts")).agg(
        (F.sum(F.col("_v") * F.col("weight")) / F.sum("weight")).alias("prior"), F.stddev_pop("_v").alias("spread"), F.count(F.lit(1)).alias("days"))


def training_windows(features: DataFrame, value: str = "rt_price", back: int = 96, ahead: int = 96, stride: int = 2, limit: int | None = None) -> DataFrame:
    """Start positions of all complete training windows before the cutoff, with history and future arrays.

    Only a caller who gives `limit` gets them evenly thinned to that many.
    """
    train = features.where(F.col("ts") <= F.col("as_of"))
    last = train.groupBy(*KEYS).agg((F.max("i") + 1).alias("_end"))
    h = with_halo(train.select(*KEYS, "ts", "i", F.col(value).alias("v")), KEYS, back=back, ahead=ahead)
    w = halo_window(KEYS)
    arr = lambda a, b: F.transform(F.collect_list(F.struct("v")).over(w.rowsBetween(a, b)), lambda s: s["v"])
    h = drop_halo(h.withColumn("_n", F.count("v").over(w.rowsBetween(0, ahead - 1))).withColumn("history", arr(-back, -1)).withColumn("future", arr(0, ahead - 1)))
    s = h.join(last, KEYS).where((F.col("i") >= back) & ((F.col("i") - back) % stride == 0) & (F.col("i") + ahead <= F.col("_end")) & (F.col("_n") == ahead))
    s = prefix_sums(s, KEYS, "i", {"_k": F.lit(1)}).withColumn("_k", F.col("_k") - 1)
    if limit is None:
        return s.select(*KEYS, F.col("_k").alias("sample"), F.col("i").alias("start_i"), F.col("ts").alias("start_at"), "history", "future")
    m = s.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_m"))
    keep = m.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("_m"), F.lit(limit)) - 1)))
    at = F.when(F.col("_m") <= limit, F.col("_j")).otherwise(F.bround(F.col("_j") * ((F.col("_m") - 1) / F.lit(float(max(1, limit - 1)))), 0)).cast("long")
    keep = keep.select(*KEYS, "_j", at.alias("_k"))
    return s.join(keep, [*KEYS, "_k"]).select(*KEYS, F.col("_j").alias("sample"), F.col("i").alias("start_i"), F.col("ts").alias("start_at"), "history", "future")


def standardize(features: DataFrame, names: list[str]) -> DataFrame:
    """Features minus their training mean over their population standard deviation (1 where it is 0)."""
    st = features.where(F.col("ts") <= F.col("as_of")).groupBy(*KEYS).agg(*[F.avg(c).alias(f"_m_{c}") for c in names], *[F.stddev_pop(c).alias(f"_s_{c}") for c in names])
    j = features.join(st, KEYS)
    z = lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 1e-12, F.col(f"_s_{c}")).otherwise(F.lit(1.0))
    return j.select(*[c for c in features.columns if c not in names], *[z(c).alias(c) for c in names])


def fit_predict(scaled: DataFrame, names: list[str], ridge: float = 1.0) -> DataFrame:
    """Ridge regression per market and fold from one cross-product matrix, predicted over the target slots and clipped.

    Training rows are summed where they are; only k x k sums move.
    """
    vec = F.array(F.lit(1.0), *[F.col(c) for c in names])
    train = scaled.where((F.col("ts") <= F.col("as_of")) & F.col("rt_price").isNotNull())
    g = gram(train.select(*KEYS, F.concat(vec, F.array(F.col("rt_price"))).alias("v")), KEYS, "v")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(flat: pd.Series) -> pd.Series:
        def one(x):
            m = np.asarray(x, float)
            k = int(round(len(m) ** 0.5))
            m = m.reshape(k, k)
            a = m[:-1, :-1] + ridge * np.diag([0.0] + [1.0] * (k - 2))
            return np.linalg.lstsq(a, m[:-1, -1], rcond=None)[0].tolist()
        return flat.map(one)

    beta = g.select(*KEYS, solve("g").alias("_b"))
    t = scaled.where((F.col("ts") >= F.col("target_start")) & (F.col("ts") < F.col("target_end"))).join(beta, KEYS)
    dot = F.aggregate(F.zip_with(vec, F.col("_b"), lambda x, b: x * b), F.lit(0.0), lambda a, x: a + x)
    return t.select(*KEYS, "ts", F.least(F.greatest(dot, F.lit(PRICE_FLOOR)), F.lit(PRICE_CAP)).alias("predicted"))


def blend(df: DataFrame) -> DataFrame:
    """Mix a model with the prior: more weight for certainty, less for divergence; clipped to the price limits."""
    div = F.abs(F.col("model") - F.col("prior")) / F.greatest("spread", F.lit(30.0))
    clip = lambda c, a, b: F.least(F.greatest(c, F.lit(a)), F.lit(b))
    w = clip(F.lit(0.45) + 0.40 * clip(F.col("certainty"), 0.0, 1.0) - 0.12 * clip(div, 0.0, 2.0), 0.25, 0.85)
    return df.withColumn("model_weight", w).withColumn("final", clip(F.col("model_weight") * F.col("model") + (1 - F.col("model_weight")) * F.col("prior"), PRICE_FLOOR, PRICE_CAP))


METHODS = ("predicted", "persistence", "day_naive", "week_naive")


def forecast_metrics(points: DataFrame) -> DataFrame:
    """MAE, RMSE, bias and n per method, per fold and over all folds (fold_id NULL), on points every method has."""
    known = F.col("actual").isNotNull()
    for m in METHODS:
        known = known & F.col(m).isNotNull()
    items = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("p")) for m in METHODS])
    e = points.where(known).withColumn("_i", F.explode(items)).select(*KEYS, "_i.method", (F.col("_i.p") - F.col("actual")).alias("e"))
    both = e.withColumn("fold_id", F.explode(F.array(F.col("fold_id"), F.lit(None).cast("long"))))
    return both.groupBy("series_id", "method", "fold_id").agg(F.count(F.lit(1)).alias("observations"), r6(F.avg(F.abs("e"))).alias("mae"), r6(F.sqrt(F.avg(F.col("e") * F.col("e")))).alias("rmse"), r6(F.avg("e")).alias("bias"))


def verdict(metrics: DataFrame, min_points: int = 72) -> DataFrame:
    """Is the model better than both naive methods on enough points, and are the folds stable?"""
    fold, own = F.col("fold_id").isNotNull(), F.col("method") == "predicted"
    mae = lambda m: F.max(F.when(~fold & (F.col("method") == m), F.col("mae")))
    a = metrics.groupBy("series_id").agg(F.min(F.when(fold & own, F.col("observations"))).alias("fewest_points"), mae("predicted").alias("model_mae"), mae("day_naive").alias("day_mae"), mae("week_naive").alias("week_mae"),
                                         F.min(F.when(fold & own, F.col("mae"))).alias("best_fold_mae"), F.max(F.when(fold & own, F.col("mae"))).alias("worst_fold_mae"))
    enough = F.col("fewest_points") >= min_points
    return a.withColumn("enough_points", enough).withColumn("gain_verified", enough & (F.col("model_mae") < F.least("day_mae", "week_mae"))).withColumn("unstable", (F.col("best_fold_mae") > 0) & (F.col("worst_fold_mae") > 2 * F.col("best_fold_mae")))


def error_by_hour(points: DataFrame, worst: int = 3) -> DataFrame:
    """Model and naive errors per hour, the rank among the worst hours, and the naive methods that beat the model there."""
    p = points.where(F.col("actual").isNotNull() & F.col("predicted").isNotNull())
    mae = lambda m: r6(F.avg(F.abs(F.col(m) - F.col("actual"))))
    h = p.groupBy("series_id", F.hour("ts").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("observations"), *[mae(m).alias(f"{m}_mae") for m in METHODS])
    w = Window.partitionBy("series_id").orderBy(F.desc("predicted_mae"), "hour")         # 24 rows
    stronger = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"{m}_mae") < F.col("predicted_mae"), F.lit(m)) for m in METHODS[1:]])), ",")
    return h.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("worst", F.col("rank") <= worst).withColumn("stronger_baselines", stronger)
