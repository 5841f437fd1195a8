"""Queries over the target series."""

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import align as al
from ..operators import target as tg
from .base import ALIGNED_SQL, FILLED_SQL, TARGET, TARGET_SQL, big, query, r

SEGMENTS = [
    al.Segment("peak", "hours", hours=(9, 10, 11, 18, 19, 20)), al.Segment("valley", "hours", hours=(0, 1, 2, 3, 4, 5)),
    al.Segment("early", "hours", hours=(5, 6, 7, 8)),
    al.Segment("first_half", "time_range", start="2024-01-01 00:00:00", end="2024-01-15 23:00:00"),
    al.Segment("second_half", "time_range", start="2024-01-15 12:00:00", end="2024-01-31 23:00:00"),
    al.Segment("january", "months", months=(1,)),
]
SEGMENTS_SQL = """,
segs AS (SELECT * FROM (VALUES ('peak','hours',0),('valley','hours',1),('early','hours',2),('first_half','time_range',3),('second_half','time_range',4),('january','months',5)) v(segment_id, kind, ord))"""
SEGMENT_TEST = """(CASE g.segment_id WHEN 'peak' THEN hour(t.ts) IN (9,10,11,18,19,20) WHEN 'valley' THEN hour(t.ts) IN (0,1,2,3,4,5) WHEN 'early' THEN hour(t.ts) IN (5,6,7,8)
  WHEN 'first_half' THEN t.ts BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-15 23:00:00'
  WHEN 'second_half' THEN t.ts BETWEEN TIMESTAMP '2024-01-15 12:00:00' AND TIMESTAMP '2024-01-31 23:00:00' WHEN 'january' THEN month(t.ts) = 1 END)"""


@query("price_distribution", f"""WITH {TARGET_SQL}
SELECT series_id, count(value) AS observations, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS std, {r('min(value)')} AS min, {r('max(value)')} AS max,
 {r('skewness(value)')} AS skewness, {r('kurtosis(value)')} AS kurtosis, {r('quantile_cont(value,0.01)')} AS q01, {r('quantile_cont(value,0.05)')} AS q05,
 {r('quantile_cont(value,0.25)')} AS q25, {r('quantile_cont(value,0.5)')} AS median, {r('quantile_cont(value,0.75)')} AS q75,
 {r('quantile_cont(value,0.95)')} AS q95, {r('quantile_cont(value,0.99)')} AS q99 FROM xv GROUP BY series_id""")
def _(t):
    return tg.price_distribution(t.aligned(), TARGET)


def _roll(label, w):
    fr = f"OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    m = max(2, w // 2)
    return f"""SELECT series_id, i, '{label}' AS span, {w} AS w, CASE WHEN count(value) {fr} >= {m} THEN avg(value) {fr} END AS rm,
      CASE WHEN count(value) {fr} >= {m} THEN stddev_samp(value) {fr} END AS rs FROM x"""


@query("price_rolling", f"""WITH {TARGET_SQL},
ro AS ({_roll('one_day', 24)} UNION ALL {_roll('seven_days', 168)}),
d AS (SELECT *, value - lag(value) OVER (PARTITION BY series_id ORDER BY i) AS dv FROM x),
c AS (SELECT series_id, {r('regr_slope(value, i)')} AS trend_slope_per_interval, {r('stddev_samp(dv)')} AS first_difference_std, {r('avg(abs(dv))')} AS mean_absolute_change FROM d GROUP BY 1)
SELECT ro.series_id, span, {big('w')} AS window_intervals, {r('arg_max(rm, i) FILTER (rm IS NOT NULL)')} AS latest_mean, {r('arg_max(rs, i) FILTER (rs IS NOT NULL)')} AS latest_std,
 {r('min(rm)')} AS minimum_mean, {r('max(rm)')} AS maximum_mean, {r('min(rs)')} AS minimum_std, {r('max(rs)')} AS maximum_std,
 any_value(trend_slope_per_interval) AS trend_slope_per_interval, any_value(first_difference_std) AS first_difference_std, any_value(mean_absolute_change) AS mean_absolute_change
FROM ro JOIN c USING (series_id) GROUP BY ro.series_id, span, w""")
def _(t):
    return tg.price_rolling(t.aligned(), TARGET, "1h")


FENCE_SQL = """,
f AS (SELECT series_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM xv GROUP BY 1),
fx AS (SELECT xv.*, q1 - 3.0 * (q3 - q1) AS lower, q3 + 3.0 * (q3 - q1) AS upper FROM xv JOIN f USING (series_id))"""


@query("price_extremes", f"""WITH {TARGET_SQL}{FENCE_SQL}
SELECT series_id, count(*) AS observations, {r('any_value(upper)')} AS upper_threshold, {r('any_value(lower)')} AS lower_threshold,
 count_if(value > upper)::BIGINT AS high_spike_count, {r('count_if(value > upper) / count(*)')} AS high_spike_rate,
 count_if(value < lower)::BIGINT AS extreme_low_count, {r('count_if(value < lower) / count(*)')} AS extreme_low_rate,
 count_if(value < 0)::BIGINT AS negative_count, {r('count_if(value < 0) / count(*)')} AS negative_rate,
 count_if(value = 0)::BIGINT AS zero_count, {r('count_if(value = 0) / count(*)')} AS zero_rate FROM fx GROUP BY 1""")
def _(t):
    return tg.price_extremes(t.aligned(), TARGET)


@query("extreme_examples", f"""WITH {TARGET_SQL}{FENCE_SQL},
h AS (SELECT series_id, 'high' AS side, row_number() OVER (PARTITION BY series_id ORDER BY value DESC, ts) AS rank, ts, value FROM fx WHERE value > upper
 UNION ALL SELECT series_id, 'low', row_number() OVER (PARTITION BY series_id ORDER BY value, ts), ts, value FROM fx WHERE value < lower)
SELECT series_id, side, rank, ts, {r('value')} AS value FROM h WHERE rank <= 10""")
def _(t):
    return tg.extreme_examples(t.aligned(), TARGET)


@query("price_autocorr", f"""WITH {TARGET_SQL},
l AS (SELECT a.series_id, k.lag, a.value AS v, b.value AS p FROM x a CROSS JOIN (SELECT unnest(generate_series(1, 72)) AS lag) k
  JOIN x b ON b.series_id = a.series_id AND b.i = a.i - k.lag WHERE a.value IS NOT NULL AND b.value IS NOT NULL),
m AS (SELECT series_id, count(value) - 2 AS mx FROM x GROUP BY 1)
SELECT l.series_id, {big('lag')} AS lag, {r('corr(v, p)')} AS correlation, count(*) AS pairs FROM l JOIN m USING (series_id) WHERE lag <= mx GROUP BY l.series_id, lag""")
def _(t):
    return tg.price_autocorr(t.aligned(), TARGET, 72)


@query("price_calendar", f"""WITH {TARGET_SQL},
g AS (SELECT series_id, 'hour_of_day' AS grouping, hour(ts) AS grp, value FROM xv UNION ALL SELECT series_id, 'day_of_week', isodow(ts) - 1, value FROM xv
 UNION ALL SELECT series_id, 'day_type', CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END, value FROM xv UNION ALL SELECT series_id, 'month', month(ts), value FROM xv)
SELECT series_id, grouping, {big('grp')} AS grp, count(*) AS observations, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS std, {r('median(value)')} AS median FROM g GROUP BY 1, 2, 3""")
def _(t):
    return tg.price_calendar(t.aligned(), TARGET)


@query("iqr_outliers", f"""WITH {ALIGNED_SQL},
v AS (SELECT * FROM aligned WHERE value IS NOT NULL),
f AS (SELECT series_id, name, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(*) AS n FROM v GROUP BY 1, 2)
SELECT v.series_id, v.name, count(*) AS observations, {big('CASE WHEN any_value(n) >= 4 THEN count_if(q3 > q1 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))) ELSE 0 END')} AS outlier_count
FROM v JOIN f USING (series_id, name) GROUP BY 1, 2""")
def _(t):
    return tg.iqr_outliers(t.aligned(), ["series_id", "name"])


RUNS_SQL = """,
s AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY i) AS seq, value > upper AS high, value < lower AS low, NOT (value > upper OR value < lower) AS calm FROM fx),
s2 AS (SELECT *, lead(high) OVER (PARTITION BY series_id ORDER BY seq) AS nx FROM s),
fl AS (SELECT series_id, seq, 'high' AS flag FROM s WHERE high UNION ALL SELECT series_id, seq, 'low' FROM s WHERE low UNION ALL SELECT series_id, seq, 'calm' FROM s WHERE calm),
isl AS (SELECT series_id, flag, seq - row_number() OVER (PARTITION BY series_id, flag ORDER BY seq) AS g FROM fl),
rl AS (SELECT series_id, flag, g, count(*) AS length FROM isl GROUP BY 1, 2, 3),
rs AS (SELECT series_id, flag, count(*) AS episodes, avg(length) AS mean_length, max(length) AS max_length FROM rl GROUP BY 1, 2)"""


@query("spike_regime", f"""WITH {TARGET_SQL}{FENCE_SQL}{RUNS_SQL},
b AS (SELECT series_id, count(*) AS observations, {r('any_value(upper)')} AS upper_threshold, {r('any_value(lower)')} AS lower_threshold,
 {r('count_if(value < 0) / count(*)')} AS negative_share, {r('count_if(value = 0) / count(*)')} AS zero_share, {r('count_if(high) / count(*)')} AS high_spike_share,
 {r('count_if(low) / count(*)')} AS low_spike_share,
 CASE WHEN count_if(high AND nx IS NOT NULL) > 0 THEN {r('count_if(high AND nx) / count_if(high AND nx IS NOT NULL)')} ELSE 0.0 END AS spike_follows_spike FROM s2 GROUP BY 1)
SELECT b.*, CASE WHEN high_spike_share > 0 THEN {r('spike_follows_spike / high_spike_share')} END AS persistence_ratio,
 {big('coalesce(h.episodes, 0)')} AS high_episodes, {r('h.mean_length')} AS high_mean_length, {big('coalesce(h.max_length, 0)')} AS high_max_length,
 {big('coalesce(l.episodes, 0)')} AS low_episodes, {r('l.mean_length')} AS low_mean_length, {big('coalesce(l.max_length, 0)')} AS low_max_length, {big('coalesce(c.max_length, 0)')} AS longest_calm
FROM b LEFT JOIN rs h ON h.series_id = b.series_id AND h.flag = 'high' LEFT JOIN rs l ON l.series_id = b.series_id AND l.flag = 'low'
 LEFT JOIN rs c ON c.series_id = b.series_id AND c.flag = 'calm'""")
def _(t):
    return tg.spike_regime(t.aligned(), TARGET, keep=t.keep)


@query("spike_concentration", f"""WITH {TARGET_SQL}{FENCE_SQL},
sp AS (SELECT series_id, ts FROM fx WHERE value > upper),
g AS (SELECT series_id, 'hour' AS part, hour(ts) AS grp, count(*) AS n FROM sp GROUP BY 1, 2, 3 UNION ALL SELECT series_id, 'month', month(ts), count(*) FROM sp GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY series_id, part ORDER BY n DESC, grp) AS rank FROM g), t AS (SELECT series_id, count(*) AS tot FROM sp GROUP BY 1)
SELECT k.series_id, part, rank, {big('grp')} AS grp, n AS spike_count, {r('n / tot')} AS share_of_spikes FROM k JOIN t USING (series_id) WHERE rank <= 5""")
def _(t):
    return tg.spike_concentration(t.aligned(), TARGET)


@query("duration_curve", f"""WITH {TARGET_SQL},
o AS (SELECT series_id, value, row_number() OVER (PARTITION BY series_id ORDER BY value DESC) - 1 AS k, count(*) OVER (PARTITION BY series_id) AS n FROM xv),
p AS (SELECT unnest([0,1,2,5,10,20,30,40,50,60,70,80,90,95,98,99,100]) AS p)
SELECT series_id, {r('p / 100.0')} AS exceedance_share, {r('value')} AS price FROM o JOIN p ON k = round_even(CAST(p / 100.0 AS DOUBLE) * (n - 1), 0)""")
def _(t):
    return tg.duration_curve(t.aligned(), TARGET)


@query("duration_summary", f"""WITH {TARGET_SQL},
o AS (SELECT series_id, value, row_number() OVER w AS k, count(*) OVER (PARTITION BY series_id) AS n, avg(value) OVER (PARTITION BY series_id) AS m FROM xv WINDOW w AS (PARTITION BY series_id ORDER BY value DESC)),
o2 AS (SELECT *, greatest(1, round_even(n * 0.05::DOUBLE, 0)) AS tail FROM o)
SELECT series_id, count(*) AS observations, {r('count_if(value > 0) / count(*)')} AS share_above_zero, {r('count_if(value < 0) / count(*)')} AS share_below_zero, {r('count_if(value > m) / count(*)')} AS share_above_mean,
 {r('avg(value) FILTER (k <= tail)')} AS top_5_percent_mean, {r('avg(value) FILTER (k > n - tail)')} AS bottom_5_percent_mean,
 CASE WHEN sum(value) FILTER (value > 0) > 0 THEN {r('sum(greatest(value, 0)) FILTER (k <= tail) / sum(value) FILTER (value > 0)')} END AS top_5_percent_share,
 {r('quantile_cont(value, 0.95) - quantile_cont(value, 0.05)')} AS spread_p95_minus_p05, CASE WHEN median(value) > 0 THEN {r('quantile_cont(value, 0.95) / median(value)')} END AS ratio_p95_to_median
FROM o2 GROUP BY 1""")
def _(t):
    return tg.duration_summary(t.aligned(), TARGET)


@query("naive_baselines", f"""WITH {TARGET_SQL},
k AS (SELECT * FROM (VALUES ('persistence', 1, 0), ('daily_naive', 24, 48), ('weekly_naive', 168, 336)) v(baseline, lag, need)),
e AS (SELECT a.series_id, baseline, lag, a.value - b.value AS err FROM x a CROSS JOIN k JOIN x b ON b.series_id = a.series_id AND b.i = a.i - k.lag
  JOIN (SELECT series_id, count(*) AS n FROM x GROUP BY 1) c ON c.series_id = a.series_id WHERE c.n > need AND a.value IS NOT NULL AND b.value IS NOT NULL),
m AS (SELECT series_id, baseline, {big('max(lag)')} AS lag_intervals, count(*) AS observations, {r('avg(abs(err))')} AS mae, {r('sqrt(avg(err * err))')} AS rmse, {r('avg(err)')} AS bias, {r('median(abs(err))')} AS median_absolute_error FROM e GROUP BY 1, 2),
sc AS (SELECT series_id, CASE WHEN median(abs(value)) = 0 THEN 1.0 ELSE median(abs(value)) END AS s FROM xv GROUP BY 1),
nz AS (SELECT series_id, {r('count_if(abs(value) < 0.01 * s) / count(*)')} AS near_zero_share FROM xv JOIN sc USING (series_id) GROUP BY 1)
SELECT m.*, {r('mae / max(CASE WHEN baseline = $$persistence$$ THEN mae END) OVER (PARTITION BY m.series_id)')} AS mae_ratio_to_persistence,
 row_number() OVER (PARTITION BY m.series_id ORDER BY mae, lag_intervals) = 1 AS is_best, near_zero_share, near_zero_share < 0.01 AS percentage_errors_reliable FROM m JOIN nz USING (series_id)""")
def _(t):
    return tg.naive_baselines(t.aligned(), TARGET, "1h")


@query("variance_stabilization", f"""WITH {TARGET_SQL},
c AS (SELECT series_id, median(value) AS center FROM xv GROUP BY 1),
s AS (SELECT series_id, any_value(center) AS center, median(abs(value - center)) * 1.482602218505602 AS scale FROM xv JOIN c USING (series_id) GROUP BY 1),
z AS (SELECT series_id, center, scale, (value - center) / scale AS raw, asinh((value - center) / scale) AS ash FROM xv JOIN s USING (series_id) WHERE scale > 0),
n AS (SELECT series_id, any_value(center) AS center, any_value(scale) AS scale, count(*) AS n, avg(raw) AS mr, avg(ash) AS ma FROM z GROUP BY 1),
q AS (SELECT series_id, any_value(n.center) AS center, any_value(n.scale) AS scale, any_value(n) AS n, avg(pow(raw - mr, 3)) / pow(avg(pow(raw - mr, 2)), 1.5) AS sr, avg(pow(raw - mr, 4)) / pow(avg(pow(raw - mr, 2)), 2) - 3 AS kr,
 avg(pow(ash - ma, 3)) / pow(avg(pow(ash - ma, 2)), 1.5) AS sa, avg(pow(ash - ma, 4)) / pow(avg(pow(ash - ma, 2)), 2) - 3 AS ka, count_if(abs(raw) > 5) / count(*) AS br, count_if(abs(ash) > 5) / count(*) AS ba FROM z JOIN n USING (series_id) GROUP BY 1)
SELECT series_id, {big('n')} AS observations, {r('center')} AS robust_center, {r('scale')} AS robust_scale, {r('sr')} AS raw_skewness, {r('kr')} AS raw_kurtosis, {r('n / 6 * (sr * sr + kr * kr / 4)', 4)} AS raw_jarque_bera,
 {r('exp(-(n / 6 * (sr * sr + kr * kr / 4)) / 2)')} AS raw_p_value, {r('br')} AS raw_share_beyond_5, {r('sa')} AS asinh_skewness, {r('ka')} AS asinh_kurtosis, {r('n / 6 * (sa * sa + ka * ka / 4)', 4)} AS asinh_jarque_bera,
 {r('exp(-(n / 6 * (sa * sa + ka * ka / 4)) / 2)')} AS asinh_p_value, {r('ba')} AS asinh_share_beyond_5, CASE WHEN abs(round(ka, 6)) < abs(round(kr, 6)) * 0.8 THEN 'asinh_median_mad' ELSE 'none' END AS recommended_transform FROM q WHERE n >= 8""")
def _(t):
    return tg.variance_stabilization(t.aligned(), TARGET, t.keep)


SEG_STATS_SQL = f"""{SEGMENTS_SQL},
st AS (SELECT t.series_id, g.segment_id, g.kind, g.ord, count(*) AS selected_rows, count(value) AS observations, {r('count(value) / count(*)')} AS coverage, count(value) >= 3 AS sufficient,
 {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS std, {r('min(value)')} AS minimum, {r('max(value)')} AS maximum, {r('quantile_cont(value, 0.25)')} AS q25, {r('median(value)')} AS median, {r('quantile_cont(value, 0.75)')} AS q75
 FROM x t JOIN segs g ON {SEGMENT_TEST} GROUP BY 1, 2, 3, 4)"""


@query("price_segments", f"WITH {TARGET_SQL}{SEG_STATS_SQL} SELECT * REPLACE ({big('ord')} AS ord) FROM st")
def _(t):
    return tg.segment_stats(t.aligned(), TARGET, SEGMENTS)


CONTRAST_SQL = f"""WITH {TARGET_SQL}{SEG_STATS_SQL},
mem AS (SELECT t.series_id, t.i, g.segment_id FROM x t JOIN segs g ON {SEGMENT_TEST}),
o AS (SELECT a.series_id, a.segment_id AS l, b.segment_id AS rr, count(*) AS n FROM mem a JOIN mem b ON a.series_id = b.series_id AND a.i = b.i GROUP BY 1, 2, 3)
SELECT a.series_id, a.kind, a.segment_id AS left_id, b.segment_id AS right_id, {big('coalesce(o.n, 0)')} AS overlap_rows, {r('a.mean - b.mean')} AS mean_difference,
 {r('a.median - b.median')} AS median_difference, {r('a.std - b.std')} AS std_difference FROM st a JOIN st b ON a.series_id = b.series_id AND a.kind = b.kind AND a.ord < b.ord
 LEFT JOIN o ON o.series_id = a.series_id AND o.l = a.segment_id AND o.rr = b.segment_id"""


@query("compare_price_segments", CONTRAST_SQL)
def _(t):
    return tg.compare_price_segments(t.aligned(), TARGET, SEGMENTS, keep=t.keep)


@query("histogram", f"""WITH {ALIGNED_SQL},
e AS (SELECT series_id, name, min(value) AS lo, max(value) AS hi, {big('least(greatest(round_even(sqrt(count(value)), 0), 12), 60)')} AS bins FROM aligned GROUP BY 1, 2),
b AS (SELECT series_id, name, bins, lo, hi, CASE WHEN hi > lo THEN least(floor((value - lo) / ((hi - lo) / bins)), bins - 1) ELSE 0 END AS bin FROM aligned JOIN e USING (series_id, name) WHERE value IS NOT NULL)
SELECT series_id, name, bins, {big('bin')} AS bin, {r('any_value(lo + bin * ((hi - lo) / bins))')} AS left_edge, count(*) AS observations FROM b GROUP BY 1, 2, 3, 4""")
def _(t):
    return tg.histogram(t.aligned(), ["series_id", "name"])


@query("fill_linear", f"WITH {FILLED_SQL} SELECT series_id, ts, i, {r('value')} AS value, filled FROM filled")
def _(t):
    return t.filled_target().select("series_id", "ts", "i", r6("value").alias("value"), "filled")


def _phase(src, part, phase, other, out):
    m = f"(SELECT series_id, {phase} AS p, avg(value - trend - {other}) AS m FROM {src} GROUP BY 1, 2)"
    return f"""{out}m AS (SELECT series_id, p, m - avg(m) OVER (PARTITION BY series_id) AS m FROM {m}),
{out} AS (SELECT s.* REPLACE (m.m AS {part}) FROM {src} s JOIN {out}m m ON m.series_id = s.series_id AND m.p = s.{phase})"""


DECOMP_SQL = FILLED_SQL + f""",
t0 AS (SELECT *, i % 24 AS pd, i % 168 AS pw, 0.0::DOUBLE AS day, 0.0::DOUBLE AS week, avg(value) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN 84 PRECEDING AND 84 FOLLOWING) AS trend FROM filled),
{_phase('t0', 'day', 'pd', 'week', 't1')}, {_phase('t1', 'week', 'pw', 'day', 't2')}, {_phase('t2', 'day', 'pd', 'week', 't3')}, {_phase('t3', 'week', 'pw', 'day', 't4')},
parts AS (SELECT *, value - trend - day - week AS remainder FROM t4)"""


@query("decompose", f"""WITH {DECOMP_SQL}
SELECT series_id, ts, {r('trend')} AS trend, {r('day')} AS day, {r('week')} AS week, {r('remainder')} AS remainder FROM parts""")
def _(t):
    return tg.decompose(t.filled_target(), "1h").select("series_id", "ts", *[r6(c).alias(c) for c in ("trend", "day", "week", "remainder")])


@query("decomposition_summary", f"""WITH {DECOMP_SQL},
h AS (SELECT series_id, hour(ts) AS h, round(avg(day), 6) AS m FROM parts GROUP BY 1, 2),
sh AS (SELECT series_id, {big('arg_min(h, (-m, h))')} AS peak_hour, {big('arg_min(h, (m, h))')} AS trough_hour, {r('max(m) - min(m)')} AS peak_to_trough FROM h GROUP BY 1),
v AS (SELECT series_id, count(*) AS observations, var_pop(trend) AS vt, var_pop(day) AS vd, var_pop(week) AS vw, var_pop(remainder) AS vr, var_pop(remainder + trend) AS dt, var_pop(remainder + day) AS dd, var_pop(remainder + week) AS dw FROM parts GROUP BY 1)
SELECT v.series_id, observations, {r('greatest(0, 1 - vr / dt)')} AS trend_strength, {r('greatest(0, 1 - vr / dd)')} AS day_strength, {r('greatest(0, 1 - vr / dw)')} AS week_strength,
 {r('vt / (vt + vd + vw + vr)')} AS trend_share, {r('vd / (vt + vd + vw + vr)')} AS day_share, {r('vw / (vt + vd + vw + vr)')} AS week_share, {r('vr / (vt + vd + vw + vr)')} AS remainder_share, {r('sqrt(vr)')} AS remainder_std, peak_hour, trough_hour, peak_to_trough
FROM v JOIN sh USING (series_id)""")
def _(t):
    return tg.decomposition_summary(tg.decompose(t.filled_target(), "1h"))


ACF_SQL = FILLED_SQL + """,
mm AS (SELECT series_id, avg(value) AS m, count(*) AS n FROM filled GROUP BY 1),
ac AS (SELECT a.series_id, k.lag, any_value(n) AS n, sum((a.value - m) * (b.value - m)) AS s FROM filled a JOIN mm USING (series_id) CROSS JOIN (SELECT unnest(generate_series(0, 72)) AS lag) k
 JOIN filled b ON b.series_id = a.series_id AND b.i = a.i - k.lag GROUP BY 1, 2)"""


@query("price_pacf")
def _(t):
    """Partial autocorrelation: Durbin-Levinson is recursive, so there is no SQL form; tested against numpy."""
    return tg.price_pacf(t.filled_target(), 72)


@query("autocovariances", f"WITH {ACF_SQL} SELECT series_id, {big('lag')} AS lag, {r('s / n', 4)} AS gamma, n FROM ac")
def _(t):
    return tg.autocovariances(t.filled_target(), ["series_id"], 72).select("series_id", "lag", r6(F.col("s") / F.col("n"), 4).alias("gamma"), "n")


@query("ljung_box")
def _(t):
    """Ljung-Box test; the statistic is checked by `ljung_box_statistic`, the p-value by tests."""
    return tg.ljung_box(t.filled_target(), "1h", 72)


@query("ljung_box_statistic", f"""WITH {ACF_SQL},
rr AS (SELECT series_id, lag, n, s / max(CASE WHEN lag = 0 THEN s END) OVER (PARTITION BY series_id) AS rho FROM ac),
q AS (SELECT series_id, lag, n * (n + 2) * sum(rho * rho / (n - lag)) OVER (PARTITION BY series_id ORDER BY lag) AS q FROM rr WHERE lag >= 1)
SELECT series_id, {big('lag')} AS lag, {r('q')} AS statistic FROM q WHERE lag IN (1, 2, 24, 72)""")
def _(t):
    return tg.ljung_box(t.filled_target(), "1h", 72).select("series_id", "lag", "statistic")
