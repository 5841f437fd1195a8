"""Queries over grids, quality, evidence rules and anomalies."""

from pyspark.sql import functions as F

from ..functions.columns import r6, shift_ts
from ..operators import align as al
from ..operators import anomalies as an
from ..operators import evidence as ev
from ..operators import quality as ql
from ..operators import relations as rel
from ..operators import target as tg
from .base import ALIGNED_SQL, DRIVERS, PAIR_SQL, RAW_SQL, TARGET, big, query, r
from .relations import QUARTILE_SQL, RANK_SQL, scan_sql, BEST_SQL
from .sources import CLOCK_SQL, versions
from .target import FENCE_SQL, SEGMENTS, CONTRAST_SQL

KEYS = al.KEYS


def _resample(agg, expr):
    @query(f"resample_{agg}", f"""WITH {RAW_SQL} SELECT series_id, name, date_trunc('hour', ts) - to_hours(CAST(hour(ts) % 3 AS INTEGER)) AS ts, {r(expr)} AS value FROM obs GROUP BY 1, 2, 3""")
    def _(t):
        return al.resample(t.events(), "3h", agg).withColumn("value", r6("value"))


for _a, _e in {"mean": "avg(value)", "median": "median(value)", "sum": "sum(value)", "min": "min(value)", "max": "max(value)", "first": "arg_min(value, (ts, value))", "last": "arg_max(value, (ts, value))"}.items():
    _resample(_a, _e)


@query("window_filter", "SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12 06:00:00'")
def _(t):
    return al.window_filter(t.events(), "2024-01-05", "2024-01-12 06:00:00").select("event_id", "ts")


@query("align", f"WITH {ALIGNED_SQL} SELECT series_id, name, ts, i, {r('value')} AS value FROM aligned")
def _(t):
    return t.aligned().withColumn("value", r6("value"))


@query("widen", f"WITH {ALIGNED_SQL} SELECT series_id, ts, i, " + ", ".join(f"round(max(value) FILTER (name = '{n}'), 6) AS {n}" for n in DRIVERS) + " FROM aligned GROUP BY 1, 2, 3")
def _(t):
    w = al.widen(t.aligned(), DRIVERS)
    return w.select("series_id", "ts", "i", *[r6(n).alias(n) for n in DRIVERS])


@query("coverage", f"WITH {ALIGNED_SQL} SELECT series_id, name, count(*) AS slots, count(value) AS observations, count(*) - count(value) AS missing, {r('count(value) / count(*)')} AS coverage FROM aligned GROUP BY 1, 2")
def _(t):
    return al.coverage(t.aligned())


@query("reduce_resolution", f"""WITH {ALIGNED_SQL}, s AS (SELECT series_id, name, epoch(min(ts))::BIGINT AS a, epoch(max(ts))::BIGINT AS b FROM aligned GROUP BY 1, 2 HAVING count(value) > 0),
g AS (SELECT *, CASE WHEN b // 3600 - a // 3600 + 1 <= 300 THEN 3600 WHEN b // 7200 - a // 7200 + 1 <= 300 THEN 7200 WHEN b // 10800 - a // 10800 + 1 <= 300 THEN 10800 WHEN b // 21600 - a // 21600 + 1 <= 300 THEN 21600 WHEN b // 43200 - a // 43200 + 1 <= 300 THEN 43200 ELSE 86400 END AS step FROM s)
SELECT series_id, name, {big('step')} AS step, make_timestamp((epoch(ts)::BIGINT // step * step * 1000000)::BIGINT) AS ts, {big('epoch(ts)::BIGINT // step - any_value(a) // step')} AS i, {r('avg(value)')} AS value FROM aligned JOIN g USING (series_id, name) GROUP BY series_id, name, step, epoch(ts)::BIGINT // step""")
def _(t):
    return al.reduce_resolution(t.aligned(), "1h", 300).select(*KEYS, "step", "ts", "i", r6("value").alias("value"))


@query("market_clock", """SELECT event_id, ts, date_trunc('hour', ts) + to_minutes(CAST(minute(ts) // 15 * 15 AS INTEGER)) AS floor_ts,
 make_timestamp((ceil(epoch_us(ts) / 900000000.0) * 900000000)::BIGINT) AS ceil_ts FROM events""")
def _(t):
    c = al.MarketClock("m", "UTC", 15)
    return t.events().select("event_id", "ts", c.floor("ts").alias("floor_ts"), c.ceil("ts").alias("ceil_ts"))


@query("clock_grid", """WITH e AS (SELECT event_id, ts AS a, ts + to_hours(CAST(event_id % 12 + 1 AS INTEGER)) AS b FROM events WHERE event_type = 'error')
SELECT event_id, unnest(generate_series(make_timestamp((ceil(epoch_us(a) / 900000000.0) * 900000000)::BIGINT), make_timestamp((ceil(epoch_us(b) / 900000000.0) * 900000000 - 900000000)::BIGINT), INTERVAL 15 MINUTE)) AS ts FROM e""")
def _(t):
    e = t.events().where(F.col("name") == "error").select("event_id", F.col("ts").alias("a"), shift_ts("ts", (F.col("event_id") % 12 + 1) * 3600).alias("b"))
    return al.MarketClock("m", "UTC", 15).grid(e, "a", "b").select("event_id", "ts")


@query("segment_filter", f"WITH {ALIGNED_SQL} SELECT series_id, name, ts, {r('value')} AS value FROM aligned WHERE hour(ts) IN (9, 10, 11, 18, 19, 20)")
def _(t):
    return al.segment_filter(t.aligned(), SEGMENTS[0]).select(*KEYS, "ts", r6("value").alias("value"))


GAPS_SQL = """,
gp AS (SELECT series_id, name, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY series_id, name ORDER BY ts) AS us FROM (SELECT DISTINCT series_id, name, ts FROM ser WHERE ts IS NOT NULL)),
gc AS (SELECT series_id, name, us / 1000000.0 AS seconds, count(*) AS k FROM gp WHERE us IS NOT NULL GROUP BY 1, 2, 3),
gr AS (SELECT *, row_number() OVER (PARTITION BY series_id, name ORDER BY k DESC, seconds) AS rn FROM gc)"""


@query("modal_interval", f"WITH {CLOCK_SQL}{GAPS_SQL} SELECT series_id, name, {r('seconds')} AS modal_seconds FROM gr WHERE rn = 1")
def _(t):
    return ql.modal_interval(versions(t))


@query("availability_metrics", f"""WITH {CLOCK_SQL}, h AS (SELECT series_id, name, (epoch_us(available_at) - epoch_us(ts)) / 3600000000.0 AS h FROM ser WHERE ts IS NOT NULL)
SELECT series_id, name, {r('max(h)')} AS max_availability_lag_hours, {r('count_if(h > 0) / count(*)')} AS available_after_rate, {r('median(h)')} AS median_availability_lag_hours FROM h GROUP BY 1, 2""")
def _(t):
    return ql.availability_metrics(versions(t))


# Quality of a market: business-clock rows of series p0..p2, target `purchase`, one row per raw version.
QUALITY_SQL = CLOCK_SQL + GAPS_SQL + f""",
qr AS (SELECT series_id, name, ts, avg(value) AS value FROM (SELECT series_id, name, date_trunc('hour', ts) AS ts, value FROM ser WHERE ts IS NOT NULL) GROUP BY 1, 2, 3),
qb AS (SELECT series_id, min(ts) FILTER (value IS NOT NULL) AS lo, max(ts) FILTER (value IS NOT NULL) AS hi FROM qr WHERE name = 'purchase' GROUP BY 1),
qs AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM qb),
qa AS (SELECT s.series_id, n.name, s.ts, q.value FROM qs s JOIN (SELECT DISTINCT series_id, name FROM qr) n USING (series_id) LEFT JOIN qr q ON q.series_id = s.series_id AND q.name = n.name AND q.ts = s.ts),
qd AS (SELECT series_id, name, ts, count(*) AS k, count(value) AS kv FROM ser WHERE ts IS NOT NULL GROUP BY 1, 2, 3),
qe AS (SELECT series_id, name, {big('sum(k)')} AS valid_timestamp_rows, {big('sum(kv)')} AS valid_value_rows, {big('sum(CASE WHEN k > 1 THEN k ELSE 0 END)')} AS duplicate_timestamp_rows, {big('count_if(k > 1)')} AS duplicate_timestamp_keys, min(ts) AS first_ts, max(ts) AS last_ts FROM qd GROUP BY 1, 2),
qw AS (SELECT series_id, name, count(*) AS raw_rows, {big('count_if(ts IS NULL)')} AS invalid_timestamp_rows, 0::BIGINT AS non_numeric_rows FROM ser GROUP BY 1, 2),
qf AS (SELECT series_id, name, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(value) AS n FROM qa GROUP BY 1, 2),
qo AS (SELECT series_id, name, {big('CASE WHEN any_value(n) >= 4 THEN count_if(q3 > q1 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))) ELSE 0 END')} AS outlier_count,
 count(*) AS aligned_rows, count(value) AS aligned_non_null_rows, {r('count(value) / count(*)')} AS aligned_coverage_rate, count(*) - count(value) AS missing_interval_count FROM qa JOIN qf USING (series_id, name) GROUP BY 1, 2),
qv AS (SELECT series_id, name, {r('max(h)')} AS max_availability_lag_hours, {r('count_if(h > 0) / count(*)')} AS available_after_rate, {r('median(h)')} AS median_availability_lag_hours FROM (SELECT series_id, name, (epoch_us(available_at) - epoch_us(ts)) / 3600000000.0 AS h FROM ser WHERE ts IS NOT NULL) GROUP BY 1, 2),
qq AS (SELECT qw.*, qe.* EXCLUDE (series_id, name), qo.* EXCLUDE (series_id, name), {r('seconds')} AS modal_seconds, qv.* EXCLUDE (series_id, name), 'MW' AS unit, 'events' AS path,
 CASE name WHEN 'click' THEN 'unknown' WHEN 'view' THEN 'forecast' WHEN 'error' THEN 'observed_only' ELSE 'known_at_timestamp' END AS availability_type, name <> 'view' AS availability_present,
 {r('outlier_count / aligned_non_null_rows')} AS outlier_rate, '1h' AS expected_frequency
 FROM qw JOIN qe USING (series_id, name) JOIN qo USING (series_id, name) JOIN gr USING (series_id, name) JOIN qv USING (series_id, name) WHERE rn = 1),
qi AS (SELECT series_id, name, unnest(list_filter([
 CASE WHEN aligned_non_null_rows = 0 THEN {{'severity': 'critical', 'code': 'series_has_no_values'}} WHEN aligned_coverage_rate < 0.5 THEN {{'severity': CASE WHEN name = 'purchase' THEN 'critical' ELSE 'high' END, 'code': 'very_low_coverage'}}
  WHEN aligned_coverage_rate < 0.9 THEN {{'severity': CASE WHEN name = 'purchase' THEN 'high' ELSE 'medium' END, 'code': 'low_coverage'}} WHEN aligned_coverage_rate < 0.98 THEN {{'severity': 'medium', 'code': 'incomplete_coverage'}} END,
 CASE WHEN invalid_timestamp_rows > 0 THEN {{'severity': 'high', 'code': 'invalid_timestamps'}} END, CASE WHEN non_numeric_rows > 0 THEN {{'severity': 'high', 'code': 'non_numeric_values'}} END,
 CASE WHEN duplicate_timestamp_rows > 0 THEN {{'severity': 'medium', 'code': 'duplicate_timestamps'}} END, CASE WHEN name <> 'purchase' AND availability_type = 'unknown' THEN {{'severity': 'medium', 'code': 'availability_unknown'}} END,
 CASE WHEN name <> 'purchase' AND availability_type = 'forecast' AND NOT availability_present THEN {{'severity': 'high', 'code': 'forecast_vintage_unknown'}} END,
 CASE WHEN name <> 'purchase' AND availability_type = 'observed_only' THEN {{'severity': 'high', 'code': 'lookahead_risk'}} END], lambda x: x IS NOT NULL)) AS z FROM qq),
qz AS (SELECT series_id, name, z.severity AS severity, z.code AS code FROM qi),
qx AS (SELECT series_id, ts, count(value) = count(*) AS fl, max(value) FILTER (name = 'purchase') IS NOT NULL AS tk FROM qa GROUP BY 1, 2),
qy AS (SELECT series_id, min(ts) AS start_at, max(ts) AS end_at, count(*) AS expected_rows, {big('count_if(fl)')} AS complete_case_rows, {r('count_if(fl) / count(*)')} AS complete_case_rate, count_if(tk) >= 12 AND count_if(tk) / count(*) >= 0.5 AS usable FROM qx GROUP BY 1)"""


def quality_parts(t):
    evidence, good, aligned, specs = quality_inputs(t)
    return t.keep(ql.series_quality(evidence, good, aligned, specs, "1h")), aligned


def quality_inputs(t):
    v = versions(t)
    loaded = v.withColumn("bad_ts", F.col("ts").isNull()).withColumn("bad_value", F.lit(False))
    from ..sources.readers import load_evidence
    evidence = load_evidence(loaded)
    good = v.where(F.col("ts").isNotNull())
    aligned = t.keep(al.align(al.resample(good, "1h"), TARGET, "1h"))
    kind = F.when(F.col("name") == "click", "unknown").when(F.col("name") == "view", "forecast").when(F.col("name") == "error", "observed_only").otherwise("known_at_timestamp")
    specs = v.select(*KEYS).distinct().select(*KEYS, F.lit("events").alias("path"), F.lit("MW").alias("unit"), kind.alias("availability_type"), (F.col("name") != "view").alias("availability_present"))
    return evidence, good, aligned, specs


@query("series_quality", f"WITH {QUALITY_SQL} SELECT * FROM qq")
def _(t):
    return quality_parts(t)[0]


@query("quality_issues", f"WITH {QUALITY_SQL} SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, name, code) AS issue_rank FROM qz")
def _(t):
    return ql.quality_issues(quality_parts(t)[0], TARGET)


@query("alignment_quality", f"WITH {QUALITY_SQL} SELECT * FROM qy")
def _(t):
    return ql.alignment_quality(quality_parts(t)[1], TARGET)


@query("data_quality", f"""WITH {QUALITY_SQL} SELECT series_id, 'series' AS part, name AS item, raw_rows AS amount FROM qq UNION ALL SELECT series_id, 'issues', code, count(*) FROM qz GROUP BY series_id, code
UNION ALL SELECT series_id, 'alignment', 'complete_case_rows', complete_case_rows FROM qy""")
def _(t):
    """The three parts of a study's evidence from one call."""
    evidence, good, aligned, specs = quality_inputs(t)
    q = ql.data_quality(evidence, good, aligned, specs, "1h", TARGET, t.keep)
    row = lambda part, item, amount: ["series_id", F.lit(part).alias("part"), item.alias("item"), amount.cast("long").alias("amount")]
    issues = q["issues"].groupBy("series_id", "code").agg(F.count(F.lit(1)).alias("n"))
    return (q["series"].select(*row("series", F.col("name"), F.col("raw_rows"))).unionByName(issues.select(*row("issues", F.col("code"), F.col("n"))))
            .unionByName(q["alignment"].select(*row("alignment", F.lit("complete_case_rows"), F.col("complete_case_rows")))))


@query("study_gates", f"""WITH {QUALITY_SQL}, i AS (SELECT series_id, {big("count_if(severity = 'critical')")} AS critical_issues, {big("count_if(severity = 'high')")} AS high_issues,
 coalesce(array_to_string(list_sort(list_distinct(list(code) FILTER (severity = 'critical'))), ','), '') AS blocking_codes FROM qz GROUP BY 1)
SELECT qy.series_id, usable AS target_usable, aligned_coverage_rate >= 0.98 AS target_coverage_ok, coalesce(critical_issues, 0) AS critical_issues, coalesce(high_issues, 0) AS high_issues, coalesce(blocking_codes, '') AS blocking_codes, usable AND coalesce(critical_issues, 0) = 0 AS passed
FROM qy LEFT JOIN qq ON qq.series_id = qy.series_id AND qq.name = 'purchase' LEFT JOIN i ON i.series_id = qy.series_id""")
def _(t):
    q, a = quality_parts(t)
    return ev.study_gates(q, ql.quality_issues(q, TARGET), ql.alignment_quality(a, TARGET), TARGET)


PROFILE_SQL = CLOCK_SQL + f""",
st AS (SELECT series_id, name, ts, value FROM ser WHERE ts IS NOT NULL)""" + GAPS_SQL.replace("FROM ser", "FROM st") + f""",
pt AS (SELECT series_id, name, ts, count(*) AS k, count(value) AS kv, min(value) AS lo, max(value) AS hi, count_if(value < 0) AS ng FROM st GROUP BY 1, 2, 3),
pb AS (SELECT series_id, name, {big('sum(k)')} AS rows, count(*) AS distinct_times, min(ts) AS start_at, max(ts) AS end_at, {big('sum(k - kv)')} AS null_values, {big('sum(CASE WHEN k > 1 THEN k ELSE 0 END)')} AS duplicate_time_rows, {r('min(lo)')} AS min, {r('max(hi)')} AS max, {big('sum(ng)')} AS negative_rows FROM pt GROUP BY 1, 2),
pd AS (SELECT series_id, name, {r('count_if(n >= 20) / count(*)')} AS complete_day_rate FROM (SELECT series_id, name, CAST(ts AS DATE) AS d, count(*) AS n FROM pt GROUP BY 1, 2, 3) GROUP BY 1, 2),
pg AS (SELECT series_id, name, string_agg(CAST(floor(seconds / 60) AS BIGINT) || ':' || k, ',' ORDER BY rn) AS dominant_intervals FROM gr WHERE rn <= 5 GROUP BY 1, 2),
prof AS (SELECT * FROM pb JOIN pd USING (series_id, name) LEFT JOIN pg USING (series_id, name))"""


@query("series_profile", f"WITH {PROFILE_SQL} SELECT * FROM prof")
def _(t):
    return ql.series_profile(versions(t).where(F.col("ts").isNotNull()), 20)


@query("complete_days", f"WITH {CLOCK_SQL}, h AS (SELECT DISTINCT series_id, date_trunc('hour', ts) AS ts FROM norm) SELECT series_id, CAST(ts AS DATE) AS day, count(*) AS points FROM h WHERE ts < TIMESTAMP '2024-01-25' GROUP BY 1, 2 HAVING count(*) = 24")
def _(t):
    from ..sources.business import normalize_series
    h = al.resample(normalize_series(versions(t)), "1h", keys=["series_id"])
    return ql.complete_days(h, 24, "2024-01-25")


@query("validate_grid", f"""WITH {CLOCK_SQL}, g AS (SELECT series_id, ts, count(*) AS k, count_if(value IS NULL) AS bad FROM ser WHERE ts IS NOT NULL GROUP BY 1, 2), l AS (SELECT *, lag(ts) OVER (PARTITION BY series_id ORDER BY ts) AS p FROM g),
a AS (SELECT series_id, sum(k - 1) AS duplicate_times, count_if(minute(ts) % 30 <> 0) AS off_grid, count_if(ts - p <> INTERVAL 30 MINUTE) AS not_contiguous, sum(bad) AS not_finite FROM l GROUP BY 1)
SELECT series_id, rule, {big('rows')} AS rows FROM (UNPIVOT a ON duplicate_times, off_grid, not_contiguous, not_finite INTO NAME rule VALUE rows) WHERE rows > 0""")
def _(t):
    return ql.validate_grid(versions(t).where(F.col("ts").isNotNull()), al.MarketClock("m", "UTC", 30))


# ---- evidence rules

CAL_SQL = ALIGNED_SQL + """,
cg AS (SELECT series_id, 'hour_of_day' AS grouping, hour(ts) AS grp, value FROM aligned WHERE name = 'purchase' UNION ALL SELECT series_id, 'day_of_week', isodow(ts) - 1, value FROM aligned WHERE name = 'purchase'
 UNION ALL SELECT series_id, 'day_type', CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END, value FROM aligned WHERE name = 'purchase' UNION ALL SELECT series_id, 'month', month(ts), value FROM aligned WHERE name = 'purchase'),
cs AS (SELECT series_id, grouping, grp, count(value) AS n, round(avg(value), 6) AS m, round(stddev_samp(value), 6) AS s FROM cg WHERE value IS NOT NULL GROUP BY 1, 2, 3),
ct AS (SELECT series_id, grouping, sum(m * n) / sum(n) AS gm FROM cs GROUP BY 1, 2 HAVING count(*) >= 2)"""


@query("eta_squared", f"""WITH {CAL_SQL} SELECT series_id, grouping, {r('sum(n * (m - gm) * (m - gm)) / (sum(n * (m - gm) * (m - gm)) + coalesce(sum((n - 1) * s * s), 0))')} AS eta_squared FROM cs JOIN ct USING (series_id, grouping) GROUP BY 1, 2""")
def _(t):
    return ev.eta_squared(tg.price_calendar(t.aligned(), TARGET))


@query("drifting", f"""WITH {ALIGNED_SQL}, a AS (SELECT series_id, name, count(value) AS observations, {r('stddev_samp(value)')} AS std, {r('regr_slope(value, i)')} AS trend_slope_per_interval FROM aligned WHERE name <> 'purchase' GROUP BY 1, 2)
SELECT *, abs(trend_slope_per_interval) * observations >= std AS drifting FROM a""")
def _(t):
    d = rel.drivers_of(t.aligned(), TARGET)
    return ev.drifting(rel.driver_distribution(d), rel.driver_trend(d))


@query("monotonic", f"""WITH {QUARTILE_SQL}, s AS (SELECT *, target_mean - lag(target_mean) OVER (PARTITION BY series_id, name ORDER BY bucket) AS d FROM qr)
SELECT series_id, name, count(*) AS buckets, count(*) < 3 OR bool_and(coalesce(d >= 0, true)) OR bool_and(coalesce(d <= 0, true)) AS monotonic FROM s GROUP BY 1, 2""")
def _(t):
    return ev.monotonic(rel.quartile_response(t.pairs(), keep=t.keep))


@query("group_spread", f"""WITH {PAIR_SQL}, h AS (SELECT series_id, name, hour(ts) AS g, round(corr(x, y), 6) AS c FROM both_known GROUP BY 1, 2, 3 HAVING count(*) >= 12),
s AS (SELECT series_id, name, count(*) AS groups, {r('max(c) - min(c)')} AS spread FROM h GROUP BY 1, 2 HAVING count(*) >= 2) SELECT *, CASE WHEN spread >= 0.2 THEN 'candidate_support' ELSE 'not_supported' END AS status FROM s""")
def _(t):
    return ev.group_spread(rel.pearson_by_hour(t.pairs(), p_value=False))


@query("lag_scan_gaps", f"""WITH {scan_sql(24)}, a AS (SELECT series_id, name, {big('count(correlation)')} AS usable_lags, {big('count_if(correlation IS NULL)')} AS starved_lags, max(lag) FILTER (correlation IS NOT NULL) AS last_usable_lag FROM sc GROUP BY 1, 2)
SELECT *, usable_lags > 0 AND starved_lags > 0 AS truncated, usable_lags = 0 AS no_evidence FROM a""")
def _(t):
    return ev.lag_scan_gaps(rel.lead_scan(t.pairs(), 24))


@query("volatility_regime", f"""WITH {ALIGNED_SQL}, w AS (SELECT series_id, CASE WHEN count(value) OVER k >= 12 THEN stddev_samp(value) OVER k END AS s FROM aligned WHERE name = 'purchase' WINDOW k AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
m AS (SELECT series_id, round(min(s), 6) AS lo, round(max(s), 6) AS hi FROM w GROUP BY 1)
SELECT series_id, CASE WHEN lo > 0 THEN {r('hi / lo')} END AS ratio, CASE WHEN hi IS NULL THEN 'not_tested' WHEN lo = 0 THEN 'candidate_support' WHEN round(hi / lo, 6) >= 2 THEN 'candidate_support' ELSE 'not_supported' END AS status FROM m""")
def _(t):
    return ev.volatility_regime(tg.price_rolling(t.aligned(), TARGET, "1h"))


@query("apply_rules", f"""WITH {CAL_SQL}, {scan_sql(24).split(PAIR_SQL)[0]}{PAIR_SQL[len(ALIGNED_SQL):].lstrip(', ')},
e AS (SELECT series_id, grouping, sum(n * (m - gm) * (m - gm)) / (sum(n * (m - gm) * (m - gm)) + coalesce(sum((n - 1) * s * s), 0)) AS v FROM cs JOIN ct USING (series_id, grouping) GROUP BY 1, 2),
mt AS (SELECT series_id, 'abs_skewness' AS metric, abs(skewness(value)) AS value FROM aligned WHERE name = 'purchase' GROUP BY 1 UNION ALL SELECT series_id, 'kurtosis', kurtosis(value) FROM aligned WHERE name = 'purchase' GROUP BY 1
 UNION ALL SELECT series_id, 'max_eta_squared', max(v) FROM e GROUP BY 1 UNION ALL SELECT series_id, 'max_abs_correlation', max(abs(c)) FROM (SELECT series_id, name, corr(x, y) AS c FROM both_known GROUP BY 1, 2) GROUP BY 1
 UNION ALL SELECT series_id, 'min_driver_coverage', min(c) FROM (SELECT series_id, name, count(value) / count(*) AS c FROM aligned WHERE name <> 'purchase' GROUP BY 1, 2) GROUP BY 1),
ru AS (SELECT * FROM (VALUES ('distribution','abs_skewness','>=',0.5),('distribution','kurtosis','>=',1.0),('calendar','max_eta_squared','>=',0.06),('coverage','min_driver_coverage','<',0.9),('contemporaneous','max_abs_correlation','>=',0.1),('lead_lag','max_best_lag','>',0.0)) v(item, metric, op, threshold)),
j AS (SELECT i.series_id, ru.item, value, CASE op WHEN '>=' THEN value >= threshold WHEN '>' THEN value > threshold ELSE value < threshold END AS hit FROM ru CROSS JOIN (SELECT DISTINCT series_id FROM mt) i LEFT JOIN mt ON mt.series_id = i.series_id AND mt.metric = ru.metric)
SELECT series_id, item, count(value) AS tested_metrics, CASE WHEN count(value) = 0 THEN 'not_tested' WHEN bool_or(hit) THEN 'candidate_support' ELSE 'not_supported' END AS status FROM j GROUP BY 1, 2""")
def _(t):
    a = t.aligned()
    m = lambda df, name, e: df.groupBy("series_id").agg(e.alias("value")).select("series_id", F.lit(name).alias("metric"), "value")
    dist = tg.price_distribution(a, TARGET)
    parts = [m(dist, "abs_skewness", F.max(F.abs("skewness"))), m(dist, "kurtosis", F.max("kurtosis")), m(ev.eta_squared(tg.price_calendar(a, TARGET)), "max_eta_squared", F.max("eta_squared")),
             m(rel.pearson(t.pairs(), p_value=False), "max_abs_correlation", F.max(F.abs("correlation"))), m(al.coverage(rel.drivers_of(a, TARGET)), "min_driver_coverage", F.min("coverage"))]
    metrics = parts[0]
    for p in parts[1:]:
        metrics = metrics.unionByName(p)
    items = {"distribution", "calendar", "coverage", "contemporaneous", "lead_lag"}
    return ev.apply_rules(metrics, [x for x in ev.RULES if x[0] in items])


@query("rank_relationships", f"""WITH {scan_sql(24)}, {RANK_SQL}, {BEST_SQL},
u AS (SELECT series_id, name, 'pearson' AS method, 0::BIGINT AS lag, {r('corr(x, y)')} AS correlation FROM both_known GROUP BY 1, 2 HAVING count(*) >= 12 UNION ALL SELECT series_id, name, 'spearman', 0, {r('corr(rx, ry)')} FROM rk GROUP BY 1, 2 HAVING count(*) >= 12
 UNION ALL SELECT series_id, name, 'best_lag', lag, correlation FROM bs WHERE rn = 1)
SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY abs(correlation) DESC, name, method) AS rank FROM u WHERE correlation IS NOT NULL""")
def _(t):
    p = t.pairs()
    rels = rel.pearson(p, p_value=False).withColumn("method", F.lit("pearson")).unionByName(rel.spearman(p, p_value=False).withColumn("method", F.lit("spearman")))
    return ev.rank_relationships(rels, rel.lead_scan_best(rel.lead_scan(p, 24)))


@query("rank_contrasts", f"""WITH cp AS ({CONTRAST_SQL}), b AS (SELECT *, row_number() OVER (PARTITION BY series_id, kind ORDER BY abs(mean_difference) DESC, left_id, right_id) AS k,
 count(*) OVER (PARTITION BY series_id, kind) AS contrasts, count_if(overlap_rows > 0) OVER (PARTITION BY series_id, kind) AS over FROM cp WHERE mean_difference IS NOT NULL)
SELECT series_id, kind, left_id, right_id, mean_difference, CAST(over AS BIGINT) AS overlapping_pairs, contrasts FROM b WHERE k = 1""")
def _(t):
    """Largest segment contrast per comparison."""
    return ev.rank_contrasts(tg.compare_price_segments(t.aligned(), TARGET, SEGMENTS))


# ---- anomalies

DAILY_SQL = CLOCK_SQL + f""",
dl AS (SELECT * EXCLUDE (rn) FROM (SELECT series_id, name, ts, value - 5 AS value, row_number() OVER (PARTITION BY series_id, name, ts ORDER BY tie DESC) AS rn FROM ser WHERE ts IS NOT NULL AND value IS NOT NULL) WHERE rn = 1),
dd AS (SELECT series_id, name, CAST(ts AS DATE) AS day, count(*) AS points, {r('min(value)')} AS min, {r('max(value)')} AS max, avg(value) AS mean, count_if(value < 0)::BIGINT AS negative_intervals FROM dl GROUP BY 1, 2, 3 HAVING count(*) >= 9),
dm AS (SELECT series_id, name, median(mean) AS med FROM dd GROUP BY 1, 2), da AS (SELECT series_id, name, any_value(med) AS med, median(abs(mean - med)) AS mad FROM dd JOIN dm USING (series_id, name) GROUP BY 1, 2),
dz AS (SELECT dd.* REPLACE ({r('mean')} AS mean), CASE WHEN mad = 0 THEN 0.0 ELSE {r('(mean - med) / (1.4826 * mad)')} END AS robust_z FROM dd JOIN da USING (series_id, name)),
dk AS (SELECT *, 'high' AS kind, row_number() OVER (PARTITION BY series_id, name ORDER BY robust_z DESC, day) AS rank FROM dz UNION ALL SELECT *, 'low', row_number() OVER (PARTITION BY series_id, name ORDER BY robust_z, day) FROM dz
 UNION ALL SELECT *, 'negative', row_number() OVER (PARTITION BY series_id, name ORDER BY negative_intervals DESC, day) FROM dz WHERE negative_intervals > 0)"""
CAND_SQL = DAILY_SQL + """,
c1 AS (SELECT series_id, name, kind, CASE name WHEN 'purchase' THEN 'price_spike' WHEN 'view' THEN 'renewable_supply_change' WHEN 'click' THEN 'renewable_supply_change' END AS event_type, arg_min(day, rank) AS day FROM dk WHERE rank <= 5 AND day BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' AND name IN ('purchase', 'view', 'click') GROUP BY 1, 2, 3),
c2 AS (SELECT series_id, day, event_type, min({'n': name, 'k': kind}) AS o FROM c1 GROUP BY 1, 2, 3),
cw AS (SELECT series_id, day, event_type, o.n AS name, o.k AS kind, day - 3 AS start_date, day + 3 AS end_date, o.n || ':' || CAST(day AS VARCHAR) AS trigger, substr(sha256(series_id || '|' || event_type || '|' || o.n || ':' || CAST(day AS VARCHAR)), 1, 16) AS query_id FROM c2)"""
ETYPES = {"purchase": "price_spike", "view": "renewable_supply_change", "click": "renewable_supply_change"}


def _shifted(t):
    return versions(t).withColumn("value", F.col("value") - 5)


@query("daily_anomalies", f"WITH {DAILY_SQL} SELECT * FROM dk WHERE rank <= 5")
def _(t):
    return an.daily_anomalies(_shifted(t), 12, keep=t.keep)


def _candidates(t):
    return an.candidate_windows(an.daily_anomalies(_shifted(t), 12, keep=t.keep), "2024-01-05", "2024-01-25", ETYPES)


@query("candidate_windows", f"WITH {CAND_SQL} SELECT * FROM cw")
def _(t):
    return _candidates(t)


@query("attach_execution", f"""WITH {CAND_SQL}, lg AS (SELECT query_id, 'web' AS service, 3::BIGINT AS returned FROM cw WHERE day(day) % 2 = 0), im AS (SELECT query_id, 2::BIGINT AS imported FROM cw WHERE day(day) % 3 = 0)
SELECT cw.*, service, returned, coalesce(imported, 0) AS imported, CASE WHEN service IS NOT NULL THEN 'executed' WHEN coalesce(imported, 0) > 0 THEN 'results_imported_without_execution_log' ELSE 'not_run' END AS status FROM cw LEFT JOIN lg USING (query_id) LEFT JOIN im USING (query_id)""")
def _(t):
    w = t.keep(_candidates(t))
    log = w.where(F.day("day") % 2 == 0).select("query_id", F.lit("web").alias("service"), F.lit(3).cast("long").alias("returned"))
    imp = w.where(F.day("day") % 3 == 0).select("query_id", F.lit(2).cast("long").alias("imported"))
    return an.attach_execution(w, log, imp)


@query("change_anomalies", f"""WITH {CLOCK_SQL}, x AS (SELECT * EXCLUDE (rn) FROM (SELECT series_id, name, ts, value, row_number() OVER (PARTITION BY series_id, name, ts ORDER BY tie DESC) AS rn FROM ser WHERE ts IS NOT NULL AND value IS NOT NULL) WHERE rn = 1),
l AS (SELECT *, lag(value) OVER (PARTITION BY series_id, name ORDER BY ts) AS p FROM x), k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY abs(value - p) DESC, name, ts) AS rank FROM l WHERE p IS NOT NULL)
SELECT series_id, rank, name, ts, {r('p')} AS previous_value, {r('value')} AS value, {r('value - p')} AS change FROM k WHERE rank <= 10""")
def _(t):
    return an.change_anomalies(versions(t), ["series_id"], ["name"])


MAINT_SQL = "mt AS (SELECT 'm' || CAST(user_id % 2 AS VARCHAR) AS series_id, CASE WHEN event_id % 9 <> 0 THEN ts END AS bgn_time, CASE WHEN event_id % 11 <> 0 THEN ts + to_hours(CAST(event_id % 12 - 2 AS INTEGER)) END AS end_time, user_id AS asset FROM events WHERE event_type = 'error')"


def _maintenance(t):
    e = F.col("event_id")
    return t.events().where(F.col("name") == "error").select("series_id", F.when(e % 9 != 0, F.col("ts")).alias("bgn_time"), F.when(e % 11 != 0, shift_ts("ts", (e % 12 - 2) * 3600)).alias("end_time"), F.col("user_id").alias("asset"))


@query("interval_summary", f"""WITH {MAINT_SQL} SELECT series_id, count(*) AS rows, min(bgn_time) AS start_at, max(end_time) AS end_at, {big('count_if(bgn_time IS NULL)')} AS missing_start_rows, {big('count_if(end_time IS NULL)')} AS missing_end_rows,
 {big('count_if(end_time < bgn_time)')} AS invalid_interval_rows, count(DISTINCT asset) AS distinct_assets FROM mt GROUP BY 1""")
def _(t):
    return an.interval_summary(_maintenance(t), ["series_id"], "bgn_time", "end_time", "asset")


@query("start_clusters", f"""WITH {MAINT_SQL}, d AS (SELECT series_id, CAST(bgn_time AS DATE) AS day, count(*) AS plan_count FROM mt WHERE bgn_time IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY plan_count DESC, day) AS rank FROM d) SELECT * FROM k WHERE rank <= 10""")
def _(t):
    return an.start_clusters(_maintenance(t), ["series_id"], "bgn_time")


@query("study_summary", f"""WITH {PROFILE_SQL}, {DAILY_SQL[len(CLOCK_SQL):].lstrip(', ').replace('value - 5 AS value', 'value').replace('count(*) >= 9', 'count(*) >= 16')},
tp AS (SELECT series_id, name, max(day) FILTER (kind = 'high') AS top_high_day, max(day) FILTER (kind = 'low') AS top_low_day, max(day) FILTER (kind = 'negative') AS top_negative_day FROM dk WHERE rank = 1 GROUP BY 1, 2)
SELECT * FROM prof LEFT JOIN tp USING (series_id, name)""")
def _(t):
    return an.study_summary(versions(t).where(F.col("ts").isNotNull()), 20, t.keep)


EX_SQL = ALIGNED_SQL + ", x AS (SELECT series_id, ts, i, value FROM aligned WHERE name = 'purchase'), xv AS (SELECT * FROM x WHERE value IS NOT NULL)" + FENCE_SQL + """,
ex AS (SELECT series_id, 'high' AS side, row_number() OVER (PARTITION BY series_id ORDER BY value DESC, ts) AS rank, ts, round(value, 6) AS value FROM fx WHERE value > upper
 UNION ALL SELECT series_id, 'low', row_number() OVER (PARTITION BY series_id ORDER BY value, ts), ts, round(value, 6) FROM fx WHERE value < lower)"""


@query("anomaly_windows", f"WITH {EX_SQL} SELECT * FROM ex WHERE rank <= 5")
def _(t):
    return an.anomaly_windows(tg.extreme_examples(t.aligned(), TARGET))


@query("pair_anomalies", f"""WITH {EX_SQL} SELECT ex.series_id, side, rank, ex.ts, ex.value, o.event_id, o.ts AS start_at, {r('(epoch_us(o.ts) - epoch_us(ex.ts)) / 3600000000.0')} AS hours_apart
FROM ex JOIN obs o ON o.series_id = ex.series_id AND o.name = 'error' AND o.ts BETWEEN ex.ts - INTERVAL 6 HOUR AND ex.ts + INTERVAL 6 HOUR WHERE rank <= 5""")
def _(t):
    w = an.anomaly_windows(tg.extreme_examples(t.aligned(), TARGET))
    return an.pair_anomalies(w, t.events().where(F.col("name") == "error").select("series_id", "event_id", F.col("ts").alias("start_at")))
