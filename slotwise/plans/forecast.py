"""Queries over point-in-time forecast input, baselines, similar days and backtests."""

from pyspark.sql import functions as F

from ..functions.columns import r6, shift_ts
from ..operators import align as al
from ..operators import forecast as fc
from .base import big, query, r

# Hourly market input out of `events`: every row is a version of its hour, available up to six hours later.
# Target: all event types. Actual load: error. Forecasts of load, wind, solar: click, view, signup. Temperature: error (actual), click (forecast).
SRC_SQL = """vr AS (SELECT 'm' || (user_id % 2) AS series_id, date_trunc('hour', ts) AS ts, event_type, value, date_trunc('hour', ts) + to_hours(CAST(event_id % 7 AS INTEGER)) AS available_at, event_id AS tie FROM events),
fo AS (SELECT s.series_id, f.* FROM (SELECT DISTINCT series_id FROM vr) s CROSS JOIN (SELECT * FROM (VALUES (1, TIMESTAMP '2024-01-13 06:00:00'), (2, TIMESTAMP '2024-01-20 06:00:00'), (3, TIMESTAMP '2024-01-27 06:00:00')) v(fold_id, as_of)) f),
fd AS (SELECT series_id, CAST(fold_id AS BIGINT) AS fold_id, as_of, as_of + INTERVAL 18 HOUR AS target_start, as_of + INTERVAL 42 HOUR AS target_end FROM fo),
tv AS (SELECT series_id, fold_id, ts, arg_max(value, (available_at, tie)) AS rt_price FROM vr JOIN fd USING (series_id) WHERE available_at <= as_of AND ts <= as_of GROUP BY 1, 2, 3),
av AS (SELECT series_id, fold_id, ts, arg_max(value, (available_at, tie)) AS actual_load FROM vr JOIN fd USING (series_id) WHERE event_type = 'error' AND available_at <= as_of AND ts <= as_of GROUP BY 1, 2, 3),
fw AS (SELECT series_id, date_trunc('hour', ts) AS ts, max(value) FILTER (event_type = 'click') AS forecast_load, max(value) FILTER (event_type = 'view') AS forecast_wind, max(value) FILTER (event_type = 'signup') AS forecast_solar FROM vr WHERE event_type IN ('click', 'view', 'signup') GROUP BY 1, 2),
lo AS (SELECT series_id, fold_id, min(ts) AS lo FROM (SELECT series_id, fold_id, ts FROM tv UNION ALL SELECT series_id, fold_id, ts FROM av UNION ALL SELECT series_id, fold_id, ts FROM fw CROSS JOIN (SELECT DISTINCT fold_id FROM fd)) GROUP BY 1, 2),
gr AS (SELECT fd.*, unnest(generate_series(lo, target_end - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ts, lo FROM fd JOIN lo USING (series_id, fold_id)),
sn AS (SELECT gr.series_id, gr.fold_id, as_of, target_start, target_end, gr.ts, CAST(date_diff('hour', lo, gr.ts) AS BIGINT) AS i, rt_price, actual_load, forecast_load AS fcst_load_type_11, forecast_wind AS fcst_new_energy_type_4, forecast_solar AS fcst_new_energy_pv_unified,
 CASE WHEN coalesce(forecast_wind, forecast_solar) IS NOT NULL THEN coalesce(forecast_wind, 0) + coalesce(forecast_solar, 0) END AS fcst_re_total, forecast_load - CASE WHEN coalesce(forecast_wind, forecast_solar) IS NOT NULL THEN coalesce(forecast_wind, 0) + coalesce(forecast_solar, 0) END AS fcst_net_load,
 CASE WHEN gr.ts <= as_of THEN actual_load ELSE forecast_load END AS wx_temperature FROM gr LEFT JOIN tv USING (series_id, fold_id, ts) LEFT JOIN av USING (series_id, fold_id, ts) LEFT JOIN fw ON fw.series_id = gr.series_id AND fw.ts = gr.ts)"""
ORIGIN_SQL = SRC_SQL + """,
sv AS (SELECT * FROM sn WHERE rt_price IS NOT NULL), la AS (SELECT series_id, fold_id, arg_max(rt_price, ts) AS persistence FROM sv WHERE ts < target_start GROUP BY 1, 2),
bs AS (SELECT s.series_id, s.fold_id, s.ts, persistence, d.rt_price AS day_naive, w.rt_price AS week_naive FROM sn s LEFT JOIN la USING (series_id, fold_id) LEFT JOIN sv d ON d.series_id = s.series_id AND d.fold_id = s.fold_id AND d.ts = s.ts - INTERVAL 1 DAY
 LEFT JOIN sv w ON w.series_id = s.series_id AND w.fold_id = s.fold_id AND w.ts = s.ts - INTERVAL 7 DAY WHERE s.ts >= s.target_start AND s.ts < s.target_end),
tr AS (SELECT series_id, ts, avg(value) AS actual FROM vr GROUP BY 1, 2),
pt AS (SELECT bs.*, actual, (coalesce(day_naive, persistence) + coalesce(week_naive, persistence)) / 2 AS predicted FROM bs LEFT JOIN tr USING (series_id, ts))"""


def _versions(t):
    ts, e = F.col("ts").cast("timestamp"), F.col("event_id")
    h = F.date_trunc("hour", ts)
    return t.read("events").select(F.concat(F.lit("m"), (F.col("user_id") % 2).cast("string")).alias("series_id"), h.alias("ts"), "event_type", "value", shift_ts(h, e % 7 * 3600).alias("available_at"), e.alias("tie"))


def folds(t):
    cut = [(1, "2024-01-13 06:00:00"), (2, "2024-01-20 06:00:00"), (3, "2024-01-27 06:00:00")]
    f = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("fold_id"), F.lit(a).cast("timestamp").alias("as_of")) for i, a in cut]))
    d = _versions(t).select("series_id").distinct().select("series_id", f.alias("_f")).select("series_id", "_f.*")
    return t.once("folds", lambda: d.withColumn("target_start", shift_ts("as_of", 18 * 3600)).withColumn("target_end", shift_ts("as_of", 42 * 3600)))


def sources(t):
    v = _versions(t)
    target = v.select("series_id", "ts", F.col("value").alias("rt_price"), "available_at", "tie")
    actual = v.where(F.col("event_type") == "error").select("series_id", "ts", F.col("value").alias("actual_load"), F.col("value").alias("temperature"), "available_at", "tie")
    pick = lambda n: F.max(F.when(F.col("event_type") == n, F.col("value")))
    fcst = v.where(F.col("event_type").isin("click", "view", "signup")).groupBy("series_id", "ts").agg(pick("click").alias("forecast_load"), pick("view").alias("forecast_wind"), pick("signup").alias("forecast_solar"), pick("click").alias("temperature"))
    return target, actual, fcst.withColumn("available_at", F.lit("2024-01-01").cast("timestamp")).withColumn("tie", F.lit(0).cast("long"))


def snapshot(t):
    return t.once("snapshot", lambda: fc.snapshots(*sources(t), folds(t), "1h"))


SNAP = ["rt_price", "actual_load", "fcst_load_type_11", "fcst_re_total", "fcst_net_load", "wx_temperature"]


@query("visible", f"WITH {SRC_SQL} SELECT series_id, ts, {r('arg_max(value, (available_at, tie))')} AS rt_price, max(available_at) AS available_at FROM vr WHERE available_at <= TIMESTAMP '2024-01-13 06:00:00' AND ts <= TIMESTAMP '2024-01-13 06:00:00' GROUP BY 1, 2")
def _(t):
    return fc.visible(sources(t)[0], "2024-01-13 06:00:00").select("series_id", "ts", r6("rt_price").alias("rt_price"), "available_at")


@query("visible_at_folds", f"WITH {SRC_SQL} SELECT series_id, fold_id, ts, {r('rt_price')} AS rt_price FROM tv")
def _(t):
    return fc.visible_at_folds(sources(t)[0], folds(t)).select("series_id", "fold_id", "ts", r6("rt_price").alias("rt_price"))


@query("backtest_anchors", """WITH h AS (SELECT 'm' || (user_id % 2) AS series_id, date_trunc('hour', ts) AS ts FROM events GROUP BY 1, 2), d AS (SELECT series_id, CAST(ts AS DATE) AS day FROM h GROUP BY 1, 2 HAVING count(*) = 24),
d1 AS (SELECT series_id, max(day) AS a FROM d WHERE day < DATE '2024-01-29' GROUP BY 1), d2 AS (SELECT d.series_id, max(day) AS b FROM d JOIN d1 USING (series_id) WHERE day <= a - 7 GROUP BY 1), d3 AS (SELECT d.series_id, max(day) AS c FROM d JOIN d2 USING (series_id) WHERE day <= b - 7 GROUP BY 1)
SELECT series_id, CAST(f AS BIGINT) AS fold_id, CASE f WHEN 1 THEN c WHEN 2 THEN b ELSE a END AS target_day FROM d1 JOIN d2 USING (series_id) JOIN d3 USING (series_id) CROSS JOIN (SELECT unnest([1, 2, 3]) AS f)""")
def _(t):
    return fc.backtest_anchors(_anchor_target(t), "2024-01-29", slots=24)


def _anchor_target(t):
    return al.resample(t.events(), "1h", keys=["series_id"])


@query("backtest_origins", """WITH h AS (SELECT 'm' || (user_id % 2) AS series_id, date_trunc('hour', ts) AS ts FROM events GROUP BY 1, 2), d AS (SELECT series_id, CAST(ts AS DATE) AS day FROM h GROUP BY 1, 2 HAVING count(*) = 24),
d1 AS (SELECT series_id, max(day) AS a FROM d WHERE day < DATE '2024-01-29' GROUP BY 1), d2 AS (SELECT d.series_id, max(day) AS b FROM d JOIN d1 USING (series_id) WHERE day <= a - 7 GROUP BY 1), d3 AS (SELECT d.series_id, max(day) AS c FROM d JOIN d2 USING (series_id) WHERE day <= b - 7 GROUP BY 1),
x AS (SELECT series_id, CAST(f AS BIGINT) AS fold_id, CAST(CASE f WHEN 1 THEN c WHEN 2 THEN b ELSE a END AS TIMESTAMP) AS s FROM d1 JOIN d2 USING (series_id) JOIN d3 USING (series_id) CROSS JOIN (SELECT unnest([1, 2, 3]) AS f))
SELECT series_id, fold_id, s - INTERVAL 870 MINUTE AS as_of, s AS target_start, s + INTERVAL 1 DAY AS target_end FROM x""")
def _(t):
    return fc.backtest_origins(fc.backtest_anchors(_anchor_target(t), "2024-01-29", slots=24), "2024-01-29 09:30:00")


@query("snapshots", f"WITH {SRC_SQL} SELECT series_id, fold_id, ts, i, {', '.join(f'{r(c)} AS {c}' for c in SNAP)}, CASE WHEN ts <= as_of THEN 1.0 ELSE 0.0 END::DOUBLE AS wx_source_hist, CASE WHEN wx_temperature IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS wx_weather_available_mask FROM sn")
def _(t):
    return snapshot(t).select("series_id", "fold_id", "ts", "i", *[r6(c).alias(c) for c in SNAP], "wx_source_hist", "wx_weather_available_mask")


@query("preflight", f"""WITH {SRC_SQL}, h AS (SELECT series_id, fold_id, max(ts) AS l, count(*) AS n FROM tv WHERE rt_price IS NOT NULL GROUP BY 1, 2), z AS (SELECT series_id, fold_id, count(fcst_load_type_11) AS z FROM sn WHERE ts >= target_start AND ts < target_end GROUP BY 1, 2),
a AS (SELECT fd.series_id, fd.fold_id, (epoch(as_of) - epoch(l)) / 3600.0 AS age, n, z FROM fd JOIN h USING (series_id, fold_id) JOIN z USING (series_id, fold_id))
SELECT series_id, fold_id, 'freshness_hours' AS gate, {r('age')} AS value, CASE WHEN age > 24 THEN 'reject' WHEN age > 2 THEN 'warn' ELSE 'pass' END AS status FROM a UNION ALL SELECT series_id, fold_id, 'history_points', n, CASE WHEN n >= 500 THEN 'pass' ELSE 'reject' END FROM a
UNION ALL SELECT series_id, fold_id, 'horizon_points', z, CASE WHEN z >= 18 THEN 'pass' ELSE 'reject' END FROM a""")
def _(t):
    return fc.preflight(sources(t)[0], snapshot(t), folds(t), 500, 18)


@query("origin_baselines", f"WITH {ORIGIN_SQL} SELECT series_id, fold_id, ts, {r('persistence')} AS persistence, {r('day_naive')} AS day_naive, {r('week_naive')} AS week_naive FROM bs")
def _(t):
    return fc.origin_baselines(snapshot(t)).select("series_id", "fold_id", "ts", *[r6(c).alias(c) for c in ("persistence", "day_naive", "week_naive")])


@query("baseline_overlap", f"WITH {ORIGIN_SQL} SELECT series_id, fold_id, count(*) AS points, {big('count_if(day_naive IS NOT NULL AND week_naive IS NOT NULL)')} AS common_points FROM bs GROUP BY 1, 2")
def _(t):
    return fc.baseline_overlap(snapshot(t))


CHECKED = ["hour_sin", "weekend", "price_lag_2", "price_lag_96", "price_mean_16", "price_std_16", "price_mean_96", "price_ramp_4", "hist_actual_load_lag96", "fcst_re_total", "renewable_load_ratio", "net_load_ramp_4"]
FEATURE_SQL = SRC_SQL + """,
fp AS (SELECT *, CASE WHEN ts <= as_of THEN rt_price END AS p, CASE WHEN ts <= as_of THEN actual_load END AS al FROM sn),
ff AS (SELECT series_id, fold_id, ts, as_of, sin(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24.0) AS hour_sin, CASE WHEN isodow(ts) >= 6 THEN 1.0 ELSE 0.0 END AS weekend, lag(p, 2) OVER k AS price_lag_2, lag(p, 96) OVER k AS price_lag_96,
 CASE WHEN count(p) OVER w16 >= 16 THEN avg(p) OVER w16 END AS price_mean_16, CASE WHEN count(p) OVER w16 >= 16 THEN stddev_samp(p) OVER w16 END AS price_std_16, CASE WHEN count(p) OVER w96 >= 16 THEN avg(p) OVER w96 END AS price_mean_96,
 lag(p, 1) OVER k - lag(p, 5) OVER k AS price_ramp_4, lag(al, 96) OVER k AS hist_actual_load_lag96, fcst_re_total, fcst_re_total / nullif(fcst_load_type_11, 0) AS renewable_load_ratio, fcst_net_load - lag(fcst_net_load, 4) OVER k AS net_load_ramp_4
 FROM fp WINDOW k AS (PARTITION BY series_id, fold_id ORDER BY i), w16 AS (PARTITION BY series_id, fold_id ORDER BY i ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING), w96 AS (PARTITION BY series_id, fold_id ORDER BY i ROWS BETWEEN 96 PRECEDING AND 1 PRECEDING)),
md AS (SELECT series_id, fold_id, """ + ", ".join(f"median({c}) AS {c}" for c in CHECKED) + " FROM ff WHERE ts <= as_of GROUP BY 1, 2)"


@query("forecast_features", f"WITH {FEATURE_SQL} SELECT ff.series_id, ff.fold_id, ff.ts, {', '.join(f'{r(f'coalesce(ff.{c}, md.{c}, 0)', 8)} AS {c}' for c in CHECKED)} FROM ff JOIN md USING (series_id, fold_id)")
def _(t):
    f = fc.fill_from_training(t.keep(fc.raw_features(snapshot(t), 24)))
    return f.select("series_id", "fold_id", "ts", *[r6(c, 8).alias(c) for c in CHECKED])


DAY_SQL = SRC_SQL + """,
df AS (SELECT series_id, fold_id, any_value(as_of) AS as_of, any_value(target_start) AS target_start, CAST(ts AS DATE) AS day, avg(fcst_net_load) AS net_load, avg(fcst_load_type_11) AS load, avg(fcst_re_total) AS renewable, max(fcst_new_energy_pv_unified) AS solar_output, avg(wx_temperature) AS temperature,
 avg(rt_price) AS price_mean, max(rt_price) - min(rt_price) AS price_range, avg(CASE WHEN rt_price < 0 THEN 1.0 ELSE 0.0 END) AS negative_ratio, avg(CASE WHEN rt_price >= 500 THEN 1.0 ELSE 0.0 END) AS spike_ratio, count(*) FILTER (rt_price IS NOT NULL AND ts <= as_of)::BIGINT AS points FROM sn GROUP BY series_id, fold_id, CAST(ts AS DATE))"""
FACTOR_COLS = ["net_load", "load", "renewable", "solar_output", "temperature", "price_mean", "price_range", "negative_ratio", "spike_ratio"]


@query("daily_factors", f"WITH {DAY_SQL} SELECT series_id, fold_id, day, {', '.join(f'{r(c)} AS {c}' for c in FACTOR_COLS)}, points FROM df")
def _(t):
    return fc.daily_factors(snapshot(t)).select("series_id", "fold_id", "day", *[r6(c).alias(c) for c in FACTOR_COLS], "points")


NAMES = ["net_load", "load", "renewable", "solar_output", "temperature"]
SIM_SQL = DAY_SQL + f""",
ca AS (SELECT *, CAST(target_start AS DATE) AS td FROM df WHERE day < CAST(target_start AS DATE) AND points >= 20), tg AS (SELECT series_id, fold_id, {', '.join(f'{n} AS t_{n}' for n in NAMES)} FROM df WHERE day = CAST(target_start AS DATE)),
sc AS (SELECT series_id, fold_id, {', '.join(f'CASE WHEN quantile_cont({n}, 0.75) - quantile_cont({n}, 0.25) > 1e-6 THEN quantile_cont({n}, 0.75) - quantile_cont({n}, 0.25) WHEN count({n}) > 0 THEN greatest(coalesce(stddev_samp({n}), 1), 1) END AS s_{n}' for n in NAMES)} FROM ca GROUP BY 1, 2),
sd AS (SELECT ca.series_id, ca.fold_id, day, td, {' + '.join(f'CASE WHEN t_{n} IS NOT NULL AND s_{n} IS NOT NULL THEN coalesce(abs({n} - t_{n}), s_{n} * 2) / s_{n} ELSE 0 END' for n in NAMES)} AS d, {' + '.join(f'CASE WHEN t_{n} IS NOT NULL AND s_{n} IS NOT NULL THEN 1 ELSE 0 END' for n in NAMES)} AS w
 FROM ca LEFT JOIN tg USING (series_id, fold_id) LEFT JOIN sc USING (series_id, fold_id)),
sr AS (SELECT *, round(d / w + CASE WHEN isodow(day) = isodow(td) THEN 0 ELSE 0.35 END, 9) AS score FROM sd WHERE w > 0),
pk AS (SELECT *, 0 AS o, row_number() OVER k AS rn FROM sr WHERE td - day <= 30 WINDOW k AS (PARTITION BY series_id, fold_id ORDER BY score, day) QUALIFY rn <= 2 UNION ALL SELECT *, 1, row_number() OVER k AS rn FROM sr WHERE td - day <= 90 WINDOW k AS (PARTITION BY series_id, fold_id ORDER BY score, day) QUALIFY rn <= 2
 UNION ALL SELECT *, 2, row_number() OVER k AS rn FROM sr WHERE td - day <= 240 WINDOW k AS (PARTITION BY series_id, fold_id ORDER BY score, day) QUALIFY rn <= 2 UNION ALL SELECT *, 3, row_number() OVER k AS rn FROM sr WINDOW k AS (PARTITION BY series_id, fold_id ORDER BY score, day) QUALIFY rn <= 14),
pd AS (SELECT series_id, fold_id, day, any_value(score) AS score, min(o * 100 + rn) AS k FROM pk GROUP BY 1, 2, 3), pr AS (SELECT *, row_number() OVER (PARTITION BY series_id, fold_id ORDER BY k) AS pick FROM pd QUALIFY pick <= 7),
pe AS (SELECT *, exp(-score / greatest(median(score) OVER (PARTITION BY series_id, fold_id), 0.7)) AS e FROM pr), sim AS (SELECT series_id, fold_id, day, pick, score, e / sum(e) OVER (PARTITION BY series_id, fold_id) AS weight FROM pe)"""


def _similar(t):
    return t.keep(fc.similar_days(t.keep(fc.daily_factors(snapshot(t))), min_points=20, keep=t.keep))


@query("similar_days", f"WITH {SIM_SQL} SELECT series_id, fold_id, day, pick, {r('score')} AS score, {r('weight')} AS weight FROM sim")
def _(t):
    return _similar(t).select("series_id", "fold_id", "day", "pick", r6("score").alias("score"), r6("weight").alias("weight"))


PRIOR_SQL = SIM_SQL + """,
cv AS (SELECT sn.series_id, sn.fold_id, target_start, sim.day, weight, list(rt_price ORDER BY ts) AS c FROM sn JOIN sim ON sim.series_id = sn.series_id AND sim.fold_id = sn.fold_id AND sim.day = CAST(sn.ts AS DATE) WHERE rt_price IS NOT NULL AND ts <= as_of GROUP BY 1, 2, 3, 4, 5),
cp AS (SELECT *, s, s / 23.0::DOUBLE * (len(c) - 1) AS pos FROM cv CROSS JOIN (SELECT unnest(generate_series(0, 23)) AS s)),
cx AS (SELECT *, c[floor(pos)::INT + 1] + (coalesce(c[floor(pos)::INT + 2], c[floor(pos)::INT + 1]) - c[floor(pos)::INT + 1]) * (pos - floor(pos)) AS v FROM cp),
prr AS (SELECT series_id, fold_id, target_start + to_hours(s) AS ts, sum(v * weight) / sum(weight) AS prior, stddev_pop(v) AS spread, count(*) AS days FROM cx GROUP BY series_id, fold_id, target_start, s)"""


def _prior(t):
    return fc.similar_day_prior(snapshot(t), _similar(t), 24)


@query("similar_day_prior", f"WITH {PRIOR_SQL} SELECT series_id, fold_id, ts, {r('prior')} AS prior, {r('spread')} AS spread, days FROM prr")
def _(t):
    return _prior(t).select("series_id", "fold_id", "ts", r6("prior").alias("prior"), r6("spread").alias("spread"), "days")


@query("blend", f"""WITH {PRIOR_SQL}, b AS (SELECT *, prior * 1.4 - 10 AS model, hour(ts) / 20.0 AS certainty FROM prr), c AS (SELECT *, least(greatest(0.45 + 0.40 * least(greatest(certainty, 0), 1) - 0.12 * least(greatest(abs(model - prior) / greatest(spread, 30), 0), 2), 0.25), 0.85) AS w FROM b)
SELECT series_id, fold_id, ts, {r('w')} AS model_weight, {r('least(greatest(w * model + (1 - w) * prior, -120), 1500)')} AS final FROM c""")
def _(t):
    p = _prior(t).withColumn("model", F.col("prior") * 1.4 - 10).withColumn("certainty", F.hour("ts") / 20.0)
    return fc.blend(p).select("series_id", "fold_id", "ts", r6("model_weight").alias("model_weight"), r6("final").alias("final"))


@query("training_windows", f"""WITH {SRC_SQL}, tn AS (SELECT series_id, fold_id, ts, i, rt_price AS v, max(i) OVER (PARTITION BY series_id, fold_id) + 1 AS n FROM sn WHERE ts <= as_of),
w AS (SELECT *, count(v) OVER (PARTITION BY series_id, fold_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS c, sum(v) OVER (PARTITION BY series_id, fold_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS fs, sum(coalesce(v, 0)) OVER (PARTITION BY series_id, fold_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS hs FROM tn),
s AS (SELECT *, row_number() OVER (PARTITION BY series_id, fold_id ORDER BY i) - 1 AS k FROM w WHERE i >= 12 AND (i - 12) % 2 = 0 AND i + 12 <= n AND c = 12)
SELECT series_id, fold_id, k AS sample, i AS start_i, ts AS start_at, {r('fs')} AS future_sum, {r('hs')} AS history_sum FROM s""")
def _(t):
    w = fc.training_windows(snapshot(t), back=12, ahead=12, stride=2)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return w.select("series_id", "fold_id", "sample", "start_i", "start_at", r6(total("future")).alias("future_sum"), r6(total("history")).alias("history_sum"))


MODEL = ["price_lag_96", "price_mean_96", "fcst_load_type_11", "fcst_re_total", "hour_sin", "hour_cos", "weekend"]


@query("standardize", f"""WITH {FEATURE_SQL}, fl AS (SELECT ff.series_id, ff.fold_id, ff.ts, ff.as_of, {', '.join(f'coalesce(ff.{c}, md.{c}, 0) AS {c}' for c in CHECKED)} FROM ff JOIN md USING (series_id, fold_id)),
st AS (SELECT series_id, fold_id, {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in CHECKED[:6])} FROM fl WHERE ts <= as_of GROUP BY 1, 2)
SELECT series_id, fold_id, ts, {', '.join(f'{r(f'({c} - m_{c}) / CASE WHEN s_{c} > 1e-12 THEN s_{c} ELSE 1 END', 5)} AS {c}' for c in CHECKED[:6])} FROM fl JOIN st USING (series_id, fold_id)""")
def _(t):
    f = fc.fill_from_training(t.keep(fc.raw_features(snapshot(t), 24)))
    return fc.standardize(f, CHECKED[:6]).select("series_id", "fold_id", "ts", *[r6(c, 5).alias(c) for c in CHECKED[:6]])


@query("fit_predict")
def _(t):
    """Ridge point forecast per market and fold (least squares, so no SQL form; tested against numpy)."""
    f = t.keep(fc.fill_from_training(t.keep(fc.raw_features(snapshot(t), 24))))
    return fc.fit_predict(fc.standardize(f, MODEL), MODEL).withColumn("predicted", r6("predicted"))


def points(t):
    b = fc.origin_baselines(snapshot(t))
    truth = _versions(t).groupBy("series_id", "ts").agg(F.avg("value").alias("actual"))
    pred = (F.coalesce("day_naive", "persistence") + F.coalesce("week_naive", "persistence")) / 2
    return b.join(truth, ["series_id", "ts"], "left").withColumn("predicted", pred)


METRIC_SQL = ORIGIN_SQL + f""",
pc AS (SELECT * FROM pt WHERE actual IS NOT NULL AND predicted IS NOT NULL AND persistence IS NOT NULL AND day_naive IS NOT NULL AND week_naive IS NOT NULL),
pu AS (SELECT series_id, fold_id, unnest([{', '.join(f"{{'m': '{m}', 'e': {m} - actual}}" for m in fc.METHODS)}]) AS x FROM pc),
mt AS (SELECT series_id, x.m AS method, fold_id, count(*) AS observations, {r('avg(abs(x.e))')} AS mae, {r('sqrt(avg(x.e * x.e))')} AS rmse, {r('avg(x.e)')} AS bias FROM pu GROUP BY GROUPING SETS ((series_id, x.m, fold_id), (series_id, x.m)))"""


@query("forecast_metrics", f"WITH {METRIC_SQL} SELECT * FROM mt")
def _(t):
    return fc.forecast_metrics(points(t))


@query("verdict", f"""WITH {METRIC_SQL}, a AS (SELECT series_id, min(observations) FILTER (fold_id IS NOT NULL AND method = 'predicted') AS fewest_points, max(mae) FILTER (fold_id IS NULL AND method = 'predicted') AS model_mae, max(mae) FILTER (fold_id IS NULL AND method = 'day_naive') AS day_mae,
 max(mae) FILTER (fold_id IS NULL AND method = 'week_naive') AS week_mae, min(mae) FILTER (fold_id IS NOT NULL AND method = 'predicted') AS best_fold_mae, max(mae) FILTER (fold_id IS NOT NULL AND method = 'predicted') AS worst_fold_mae FROM mt GROUP BY 1)
SELECT *, fewest_points >= 5 AS enough_points, fewest_points >= 5 AND model_mae < least(day_mae, week_mae) AS gain_verified, best_fold_mae > 0 AND worst_fold_mae > 2 * best_fold_mae AS unstable FROM a""")
def _(t):
    return fc.verdict(fc.forecast_metrics(points(t)), 5)


@query("error_by_hour", f"""WITH {ORIGIN_SQL}, h AS (SELECT series_id, {big('hour(ts)')} AS hour, count(*) AS observations, {', '.join(f'{r(f'avg(abs({m} - actual))')} AS {m}_mae' for m in fc.METHODS)} FROM pt WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY predicted_mae DESC, hour) AS rank FROM h)
SELECT *, rank <= 3 AS worst, array_to_string(list_filter([{', '.join(f"CASE WHEN {m}_mae < predicted_mae THEN '{m}' END" for m in fc.METHODS[1:])}], lambda x: x IS NOT NULL), ',') AS stronger_baselines FROM k""")
def _(t):
    return fc.error_by_hour(points(t))
