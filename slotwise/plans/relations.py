"""Queries over drivers and their relationship with the target."""

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import align as al
from ..operators import relations as rel
from ..operators import stationarity as st
from .base import ALIGNED_SQL, DRIVERS, FILLED_SQL, PAIR_SQL, TARGET, big, query, r
from .target import SEGMENT_TEST, SEGMENTS, SEGMENTS_SQL

DRV_SQL = ALIGNED_SQL + ", d AS (SELECT * FROM aligned WHERE name <> 'purchase')"
DN = "', '".join(DRIVERS)


@query("driver_distribution", f"""WITH {DRV_SQL} SELECT series_id, name, count(value) AS observations, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS std, {r('min(value)')} AS min, {r('max(value)')} AS max,
 {r('skewness(value)')} AS skewness, {r('count_if(value = 0) / count(value)')} AS zero_rate, {r('count_if(value < 0) / count(value)')} AS negative_rate, {r('quantile_cont(value, 0.25)')} AS q1, {r('median(value)')} AS median,
 {r('quantile_cont(value, 0.75)')} AS q3 FROM d GROUP BY 1, 2""")
def _(t):
    return rel.driver_distribution(rel.drivers_of(t.aligned(), TARGET))


@query("driver_outliers", f"""WITH {DRV_SQL}, f AS (SELECT series_id, name, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM d GROUP BY 1, 2)
SELECT series_id, name, count(*) AS observations, count_if(q3 > q1 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)))::BIGINT AS outlier_count,
 {r('count_if(q3 > q1 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))) / count(*)')} AS outlier_rate FROM d JOIN f USING (series_id, name) WHERE value IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return rel.driver_outliers(rel.drivers_of(t.aligned(), TARGET))


@query("driver_trend", f"""WITH {DRV_SQL}, l AS (SELECT *, value - lag(value) OVER (PARTITION BY series_id, name ORDER BY i) AS dv FROM d)
SELECT series_id, name, {r('regr_slope(value, i)')} AS trend_slope_per_interval, {r('stddev_samp(dv)')} AS first_difference_std FROM l GROUP BY 1, 2""")
def _(t):
    return rel.driver_trend(rel.drivers_of(t.aligned(), TARGET))


COLLINEAR_SQL = f"""WITH {DRV_SQL}
SELECT a.series_id, a.name AS left_name, b.name AS right_name, CASE WHEN count_if(a.value IS NOT NULL AND b.value IS NOT NULL) >= 3 THEN {r('corr(a.value, b.value)')} END AS correlation,
 count_if(a.value IS NOT NULL AND b.value IS NOT NULL)::BIGINT AS observations, coalesce(abs(corr(a.value, b.value)) >= 0.05, false) AS strong FROM d a JOIN d b ON a.series_id = b.series_id AND a.ts = b.ts AND a.name < b.name GROUP BY 1, 2, 3"""


@query("collinearity", COLLINEAR_SQL)
def _(t):
    return rel.collinearity(t.aligned(), DRIVERS, 0.05)


@query("vif")
def _(t):
    """Variance inflation: a matrix inverse, so no SQL form; tested against direct regressions."""
    return rel.vif(t.aligned(), DRIVERS)


@query("pearson", f"""WITH {PAIR_SQL} SELECT series_id, name, CASE WHEN count(*) >= 12 THEN {r('corr(x, y)')} END AS correlation, count(*) AS observations FROM both_known GROUP BY 1, 2""")
def _(t):
    return rel.pearson(t.pairs(), p_value=False)


@query("pearson_with_p")
def _(t):
    """Pearson with two-sided p-values (incomplete beta; tested against tabulated values)."""
    return rel.pearson(t.pairs())


RANK_SQL = """rk AS (SELECT series_id, name, rank() OVER (PARTITION BY series_id, name ORDER BY x) + (count(*) OVER (PARTITION BY series_id, name, x) - 1) / 2.0 AS rx,
 rank() OVER (PARTITION BY series_id, name ORDER BY y) + (count(*) OVER (PARTITION BY series_id, name, y) - 1) / 2.0 AS ry FROM both_known)"""


@query("spearman", f"""WITH {PAIR_SQL}, {RANK_SQL} SELECT series_id, name, CASE WHEN count(*) >= 12 THEN {r('corr(rx, ry)')} END AS correlation, count(*) AS observations FROM rk GROUP BY 1, 2""")
def _(t):
    return rel.spearman(t.pairs(), p_value=False)


def scan_sql(max_lag):
    return f"""{PAIR_SQL},
lp AS (SELECT a.series_id, a.name, k.lag, b.x, a.y FROM pairs a CROSS JOIN (SELECT unnest(generate_series(0, {max_lag})) AS lag) k
 JOIN pairs b ON b.series_id = a.series_id AND b.name = a.name AND b.i = a.i - k.lag),
lk AS (SELECT * FROM lp WHERE x IS NOT NULL AND y IS NOT NULL),
sc AS (SELECT series_id, name, {big('lag')} AS lag, CASE WHEN count(x) FILTER (y IS NOT NULL) >= 12 THEN {r('corr(x, y)')} END AS correlation, count(x) FILTER (y IS NOT NULL) AS observations FROM lp GROUP BY 1, 2, 3)"""


BEST_SQL = """bs AS (SELECT *, row_number() OVER (PARTITION BY series_id, name ORDER BY abs(correlation) DESC, lag) AS rn FROM sc WHERE correlation IS NOT NULL)"""


@query("lead_scan", f"WITH {scan_sql(72)} SELECT * FROM sc")
def _(t):
    return rel.lead_scan(t.pairs(), 72)


@query("lead_scan_best", f"WITH {scan_sql(24)}, {BEST_SQL} SELECT series_id, name, lag, correlation, observations FROM bs WHERE rn = 1")
def _(t):
    """Flagship: hourly grid per market, lag scan of every driver, best absolute lag."""
    return rel.lead_scan_best(rel.lead_scan(t.pairs(), 24))


@query("pearson_by_hour", f"""WITH {PAIR_SQL} SELECT series_id, name, {big('hour(ts)')} AS grp, {r('corr(x, y)')} AS correlation, count(*) AS observations FROM both_known GROUP BY 1, 2, 3 HAVING count(*) >= 12""")
def _(t):
    return rel.pearson_by_hour(t.pairs(), p_value=False)


@query("pearson_by_month", f"""WITH {PAIR_SQL} SELECT series_id, name, {big('month(ts)')} AS grp, {r('corr(x, y)')} AS correlation, count(*) AS observations FROM both_known GROUP BY 1, 2, 3 HAVING count(*) >= 12""")
def _(t):
    return rel.pearson_by_month(t.pairs(), p_value=False)


QUARTILE_SQL = PAIR_SQL + f""",
qe AS (SELECT series_id, name, quantile_cont(x, 0.25) AS e1, quantile_cont(x, 0.5) AS e2, quantile_cont(x, 0.75) AS e3 FROM both_known GROUP BY 1, 2 HAVING count(*) >= 12 AND count(DISTINCT x) >= 4),
qr AS (SELECT series_id, name, {big('CASE WHEN x <= e1 THEN 1 WHEN x <= e2 THEN 2 WHEN x <= e3 THEN 3 ELSE 4 END')} AS bucket, count(*) AS observations, {r('min(x)')} AS feature_min, {r('max(x)')} AS feature_max,
 {r('avg(y)')} AS target_mean, {r('median(y)')} AS target_median FROM both_known JOIN qe USING (series_id, name) GROUP BY 1, 2, 3)"""


@query("quartile_response", f"WITH {QUARTILE_SQL} SELECT * FROM qr")
def _(t):
    return rel.quartile_response(t.pairs(), keep=t.keep)


def mi_sql(max_lag):
    return scan_sql(max_lag) + f""",
mr AS (SELECT series_id, name, lag, count(*) OVER k AS n, rank() OVER (PARTITION BY series_id, name, lag ORDER BY x) * 2 + count(*) OVER (PARTITION BY series_id, name, lag, x) - 1 AS rx,
 rank() OVER (PARTITION BY series_id, name, lag ORDER BY y) * 2 + count(*) OVER (PARTITION BY series_id, name, lag, y) - 1 AS ry FROM lk WINDOW k AS (PARTITION BY series_id, name, lag)),
mb AS (SELECT series_id, name, lag, n, least(greatest((12 * (rx - 1) + 2 * n - 1) // (2 * n) - 1, 0), 11) AS bi, least(greatest((12 * (ry - 1) + 2 * n - 1) // (2 * n) - 1, 0), 11) AS bj FROM mr),
mc AS (SELECT series_id, name, lag, any_value(n) AS n, bi, bj, count(*) AS c FROM mb GROUP BY series_id, name, lag, bi, bj),
mp AS (SELECT *, c / n AS p, sum(c) OVER (PARTITION BY series_id, name, lag, bi) / n AS px, sum(c) OVER (PARTITION BY series_id, name, lag, bj) / n AS py FROM mc),
mm AS (SELECT series_id, name, lag, any_value(n) AS n, greatest(0, sum(p * ln(p / (px * py)))) AS mi, least(-sum(p * ln(px)), -sum(p * ln(py))) AS h FROM mp GROUP BY 1, 2, 3),
md AS (SELECT series_id, name, lag FROM lk GROUP BY 1, 2, 3 HAVING count(DISTINCT x) >= 12 AND count(*) >= 12),
mi AS (SELECT series_id, name, {big('lag')} AS lag, {big('n')} AS observations, {r('mi')} AS mutual_information, CASE WHEN h > 0 THEN {r('mi / h')} END AS normalized FROM mm JOIN md USING (series_id, name, lag))"""


@query("mutual_information", f"WITH {mi_sql(12)} SELECT * FROM mi")
def _(t):
    return rel.mutual_information(t.pairs(), 12, keep=t.keep)


@query("mutual_information_summary", f"""WITH {mi_sql(6)},
b AS (SELECT *, row_number() OVER (PARTITION BY series_id, name ORDER BY coalesce(normalized, 0) DESC, lag) AS rn, count(*) OVER (PARTITION BY series_id, name) AS evaluated_lags FROM mi)
SELECT b.series_id, b.name, evaluated_lags, b.lag, normalized, abs(correlation) AS absolute_pearson, coalesce(normalized >= 0.05 AND abs(correlation) < 0.1, false) AS nonlinear FROM b LEFT JOIN sc USING (series_id, name, lag) WHERE rn = 1""")
def _(t):
    a = t.pairs()
    return rel.mutual_information_summary(rel.mutual_information(a, 6, keep=t.keep), rel.lead_scan(a, 6))


@query("granger")
def _(t):
    """Granger F tests: least squares per lag, so no SQL form; tested against direct regressions."""
    return rel.granger(t.pairs(), "1h", 24)


@query("granger_strongest")
def _(t):
    return rel.granger_strongest(rel.granger(t.pairs(), "1h", 24))


ROLL_SQL = PAIR_SQL + """,
rw AS (SELECT series_id, name, ts, i, CASE WHEN count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) OVER w >= 12 THEN corr(x, y) OVER w END AS r FROM pairs
 WINDOW w AS (PARTITION BY series_id, name ORDER BY i ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)),
rq AS (SELECT *, row_number() OVER (PARTITION BY series_id, name ORDER BY i) - 1 AS k FROM rw WHERE r IS NOT NULL),
rs AS (SELECT series_id, name, ts, k // 60 + 1 AS sample, r FROM rq WHERE k % 60 = 0)"""


@query("rolling_correlation", f"WITH {ROLL_SQL} SELECT series_id, name, ts, {big('sample')} AS sample, {r('r')} AS r FROM rs")
def _(t):
    return rel.rolling_correlation(t.pairs(), 120).withColumn("r", r6("r"))


@query("rolling_stability", f"""WITH {ROLL_SQL} SELECT series_id, name, count(*) AS windows, {r('avg(r)')} AS mean_correlation, {r('stddev_pop(r)')} AS std_correlation, {r('min(r)')} AS min_correlation, {r('max(r)')} AS max_correlation,
 {r('least(count_if(r > 0), count_if(r < 0)) / count(*)')} AS sign_flip_share, {r('count_if(abs(r) >= 0.1) / count(*)')} AS share_above_0_1,
 CASE WHEN stddev_pop(r) < 0.15 AND least(count_if(r > 0), count_if(r < 0)) = 0 THEN 'stable' WHEN least(count_if(r > 0), count_if(r < 0)) > 0 THEN 'sign_unstable' ELSE 'magnitude_unstable' END AS stability FROM rs GROUP BY 1, 2 HAVING count(*) >= 3""")
def _(t):
    return rel.rolling_stability(rel.rolling_correlation(t.pairs(), 120))


@query("compare_relationship_segments", f"""WITH {PAIR_SQL}{SEGMENTS_SQL},
mem AS (SELECT t.series_id, t.name, t.i, t.x, t.y, g.segment_id, g.kind, g.ord FROM pairs t JOIN segs g ON {SEGMENT_TEST}),
st AS (SELECT series_id, name, segment_id, kind, ord, CASE WHEN count_if(x IS NOT NULL AND y IS NOT NULL) >= 12 THEN {r('corr(x, y)')} END AS c FROM mem GROUP BY 1, 2, 3, 4, 5),
o AS (SELECT a.series_id, a.name, a.segment_id AS l, b.segment_id AS rr, count(*) AS n FROM mem a JOIN mem b ON a.series_id = b.series_id AND a.name = b.name AND a.i = b.i GROUP BY 1, 2, 3, 4)
SELECT a.series_id, a.name, a.kind, a.segment_id AS left_id, b.segment_id AS right_id, a.c AS left_r, b.c AS right_r, {big('coalesce(o.n, 0)')} AS overlap_rows, {r('a.c - b.c')} AS correlation_difference
FROM st a JOIN st b ON a.series_id = b.series_id AND a.name = b.name AND a.kind = b.kind AND a.ord < b.ord LEFT JOIN o ON o.series_id = a.series_id AND o.name = a.name AND o.l = a.segment_id AND o.rr = b.segment_id""")
def _(t):
    return rel.compare_relationship_segments(t.pairs(), SEGMENTS)


COV_SQL = f"cov AS (SELECT series_id, name, count(value) AS observations, {r('count(value) / count(*)')} AS coverage FROM aligned GROUP BY 1, 2)"


@query("eligible_drivers", f"WITH {ALIGNED_SQL}, {COV_SQL} SELECT * FROM cov WHERE name <> 'purchase' AND observations >= 12 AND coverage >= 0.5")
def _(t):
    return rel.eligible_drivers(al.coverage(rel.drivers_of(t.aligned(), TARGET)))


@query("recommend_drivers", f"""WITH {PAIR_SQL}, {RANK_SQL}, {COV_SQL},
co AS (SELECT series_id, name, {r('corr(x, y)')} AS c FROM both_known GROUP BY 1, 2 HAVING count(*) >= 12 UNION ALL SELECT series_id, name, {r('corr(rx, ry)')} FROM rk GROUP BY 1, 2 HAVING count(*) >= 12),
be AS (SELECT series_id, name, arg_max(c, abs(c)) AS best_r FROM co GROUP BY 1, 2),
sd AS (SELECT series_id, name, round(stddev_samp(value), 6) AS std FROM aligned WHERE name <> 'purchase' GROUP BY 1, 2),
b0 AS (SELECT cov.*, best_r, coalesce(abs(best_r), 0) AS score, CASE WHEN observations = 0 OR coverage < 0.5 OR coalesce(std, 0) = 0 THEN 'excluded' WHEN coalesce(abs(best_r), 0) >= 0.1 THEN 'recommended' ELSE 'exploratory' END AS t0,
 name IN ('click', 'view') OR name = 'error' AS prediction_ready FROM cov JOIN sd USING (series_id, name) LEFT JOIN be USING (series_id, name)),
pr AS (SELECT a.series_id, a.name AS l, b.name AS rr FROM aligned a JOIN aligned b ON a.series_id = b.series_id AND a.ts = b.ts AND a.name < b.name AND a.name <> 'purchase' AND b.name <> 'purchase' GROUP BY 1, 2, 3 HAVING abs(corr(a.value, b.value)) >= 0.05),
lo AS (SELECT pr.series_id, CASE WHEN x.score >= y.score THEN rr ELSE l END AS name, max(CASE WHEN x.score >= y.score THEN l ELSE rr END) AS redundant_with FROM pr JOIN b0 x ON x.series_id = pr.series_id AND x.name = l AND x.t0 <> 'excluded'
 JOIN b0 y ON y.series_id = pr.series_id AND y.name = rr AND y.t0 <> 'excluded' GROUP BY 1, 2),
b1 AS (SELECT b0.*, redundant_with, CASE WHEN t0 = 'recommended' AND redundant_with IS NOT NULL THEN 'exploratory' ELSE t0 END AS tier FROM b0 LEFT JOIN lo USING (series_id, name)),
b2 AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY CASE tier WHEN 'recommended' THEN 0 WHEN 'exploratory' THEN 1 ELSE 2 END, score DESC, coverage DESC, name) AS rank FROM b1)
SELECT series_id, name, tier, rank, tier = 'recommended' AND rank <= 2 AS selected, coverage, observations, best_r, redundant_with, prediction_ready FROM b2""")
def _(t):
    a = t.aligned()
    d = rel.drivers_of(a, TARGET)
    kind = F.when(F.col("name").isin("click", "view"), "known_at_timestamp").when(F.col("name") == "error", "forecast").otherwise("unknown")
    q = al.coverage(d).withColumn("availability_type", kind).withColumn("availability_present", F.col("name") == "error")
    rels = rel.pearson(t.pairs(), p_value=False).unionByName(rel.spearman(t.pairs(), p_value=False))
    return rel.recommend_drivers(q, rel.driver_distribution(d), rels, rel.collinearity(a, DRIVERS, 0.05).where("strong"), limit=2)


def _fe(name, cond, lag=0):
    src = f"(SELECT a.series_id, a.name, b.x, a.y, a.i, s.slots FROM pairs a JOIN pairs b ON b.series_id = a.series_id AND b.name = a.name AND b.i = a.i - {lag} JOIN sl s ON s.series_id = a.series_id AND s.name = a.name)"
    return f"{name} AS (SELECT series_id, name, CASE WHEN count(*) >= 3 AND min(x) < max(x) AND min(y) < max(y) THEN {r('corr(x, y)')} END AS v FROM {src} WHERE x IS NOT NULL AND y IS NOT NULL AND {cond} GROUP BY 1, 2)"


@query("feature_evidence", f"""WITH {PAIR_SQL}, sl AS (SELECT series_id, name, max(i) + 1 AS slots FROM pairs GROUP BY 1, 2),
{_fe('f0', 'true')}, {_fe('f1', 'true', 1)}, {_fe('f24', 'true', 24)}, {_fe('fa', 'i < slots // 2')}, {_fe('fb', 'i >= slots // 2')},
ch AS (SELECT series_id, name, count_if(x <> px)::BIGINT AS changes FROM (SELECT *, lag(x) OVER (PARTITION BY series_id, name ORDER BY i) AS px FROM pairs WHERE x IS NOT NULL) GROUP BY 1, 2),
ba AS (SELECT series_id, name, count(*) AS rows, count(x) AS valid_rows, {r('count(x) / count(*)')} AS coverage, {r('min(x)')} AS minimum, {r('max(x)')} AS maximum, {r('stddev_samp(x)')} AS std, count(DISTINCT x) AS distinct_values FROM pairs GROUP BY 1, 2)
SELECT ba.*, f0.v AS r_same_time, f1.v AS r_lag_1h, f24.v AS r_lag_24h, fa.v AS r_first_half, fb.v AS r_second_half, coalesce(changes, 0) AS changes FROM ba LEFT JOIN ch USING (series_id, name)
 LEFT JOIN f0 USING (series_id, name) LEFT JOIN f1 USING (series_id, name) LEFT JOIN f24 USING (series_id, name) LEFT JOIN fa USING (series_id, name) LEFT JOIN fb USING (series_id, name)""")
def _(t):
    return rel.feature_evidence(t.pairs(), "1h")


def _forms(t, frame):
    """Prepared level and difference series (at most 8,760 points each), kept for the two tests."""
    return t.keep(st.both_forms(t.keep(st.prepare(frame, "1h")), al.KEYS))


@query("stationarity_tests")
def _(t):
    """ADF and KPSS of the target, level and first difference; statistics tested against direct numpy fits."""
    return st.stationarity_tests(_forms(t, t.aligned().where(F.col("name") == TARGET)))


@query("stationarity")
def _(t):
    return st.stationarity(_forms(t, t.aligned().where(F.col("name") == TARGET)))


@query("driver_stationarity")
def _(t):
    return st.stationarity(_forms(t, rel.drivers_of(t.aligned(), TARGET)))


@query("kpss_statistic", f"""WITH {FILLED_SQL},
e AS (SELECT series_id, i, value - avg(value) OVER (PARTITION BY series_id) AS e, count(*) OVER (PARTITION BY series_id) AS n FROM filled),
pr AS (SELECT a.series_id, any_value(a.n) AS n, sum(CASE WHEN k.lag = 0 THEN a.e * b.e / a.n ELSE a.e * b.e / (a.n / 2) END) AS s0, sum(k.lag * a.e * b.e / (a.n / 2)) AS s1 FROM e a CROSS JOIN (SELECT unnest(generate_series(0, 8)) AS lag) k
 JOIN e b ON b.series_id = a.series_id AND b.i = a.i - k.lag WHERE k.lag <= floor(pow(a.n, 2.0 / 9) + 1e-9) GROUP BY 1),
bw AS (SELECT series_id, n, least(floor(1.1447 * pow(pow(s1 / s0, 2), 1.0 / 3) * pow(n, 1.0 / 3)), n - 1) AS l FROM pr),
cs AS (SELECT series_id, i, n, sum(e) OVER (PARTITION BY series_id ORDER BY i) AS s FROM e),
et AS (SELECT series_id, sum(s * s) / any_value(n * n) AS eta FROM cs GROUP BY 1),
lv AS (SELECT a.series_id, sum(CASE WHEN k.lag = 0 THEN 1 ELSE 2 * (1 - k.lag / (l + 1)) END * a.e * b.e) / any_value(a.n) AS v FROM e a JOIN bw USING (series_id) CROSS JOIN (SELECT unnest(generate_series(0, 200)) AS lag) k
 JOIN e b ON b.series_id = a.series_id AND b.i = a.i - k.lag WHERE k.lag <= l GROUP BY 1)
SELECT series_id, {big('l')} AS used_lag, n, {r('eta / v')} AS statistic FROM bw JOIN et USING (series_id) JOIN lv USING (series_id)""")
def _(t):
    forms = _forms(t, t.aligned().where(F.col("name") == TARGET)).where(F.col("form") == "level")
    return st.kpss(forms, ["series_id", "name"]).select("series_id", "used_lag", "n", r6("statistic").alias("statistic"))
