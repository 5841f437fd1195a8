"""Chunked windows, ranks, quantiles, scans and joins against pandas, and unchanged by chunk size and partitioning."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from slotwise.operators import align as al
from slotwise.operators import common as cm
from slotwise.operators import stationarity as st
from slotwise.operators import target as tg


@pytest.fixture(scope="module")
def long(spark):
    rng = np.random.default_rng(7)
    n = 700
    v = rng.normal(size=n).round(2)
    v[rng.random(n) < 0.2] = np.nan
    v[100:160] = np.nan
    v[:3] = np.nan
    ts = pd.date_range("2024-01-01", periods=n, freq="h")
    pdf = pd.DataFrame({"series_id": "a", "name": "x", "ts": ts, "i": np.arange(n), "value": v})
    df = spark.createDataFrame(pdf).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    return pdf, df


def sorted_pd(df, col="value"):
    return df.orderBy("i").toPandas()[col].astype(float).to_numpy()


@pytest.mark.parametrize("chunk", [16, 50, 8192])
@pytest.mark.parametrize("parts", [1, 17])
def test_lags_do_not_depend_on_chunks(long, chunk, parts):
    pdf, df = long
    out = cm.with_lags(df.repartition(parts), ["series_id"], ["value"], [1, 12], chunk=chunk).orderBy("i").toPandas()
    for k in (1, 12):
        np.testing.assert_allclose(out[f"value_lag{k}"].astype(float), pdf.value.shift(k), equal_nan=True)


@pytest.mark.parametrize("chunk", [10, 64, 8192])
def test_fill_linear_matches_pandas(long, chunk):
    pdf, df = long
    want = pdf.set_index("ts").value.interpolate(method="time", limit_direction="both").to_numpy()
    np.testing.assert_allclose(sorted_pd(al.fill_linear(df, chunk=chunk)), want, atol=1e-12)


@pytest.mark.parametrize("chunk", [10, 8192])
def test_rolling_and_prefix_sums(long, chunk):
    pdf, df = long
    out = tg.rolling(df, ["series_id"], 24, 12, chunk=chunk).orderBy("i").toPandas()
    roll = pdf.value.rolling(24, min_periods=12)
    np.testing.assert_allclose(out.roll_mean.astype(float), roll.mean(), equal_nan=True)
    np.testing.assert_allclose(out.roll_std.astype(float), roll.std(), equal_nan=True)
    run = cm.prefix_sums(df, ["series_id"], "i", {"s": F.col("value").isNotNull().cast("long")}, chunk=chunk)
    np.testing.assert_array_equal(sorted_pd(run, "s"), pdf.value.notna().cumsum())


def test_quantiles_and_ranks(long):
    pdf, df = long
    row = cm.quantiles(df, ["series_id"], "value", {"a": 0.0, "b": 0.37, "c": 0.5, "d": 1.0}).head()
    np.testing.assert_allclose([row.a, row.b, row.c, row.d], pdf.value.quantile([0, .37, .5, 1]).to_numpy())
    known = df.where("value is not null")
    r = sorted_pd(cm.average_ranks(known, ["series_id"], "value", "r"), "r")
    np.testing.assert_allclose(r, pdf.value.dropna().rank().to_numpy())


def test_one_hot_value_and_outlier(spark):
    v = np.concatenate([np.zeros(5000), np.linspace(50, 51, 2000), [1e12, -1e9]])
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "value": v}))
    row = cm.quantiles(df, ["k"], "value", {"p1": .01, "p50": .5, "p75": .75, "p90": .9}).head()
    np.testing.assert_allclose([row.p1, row.p50, row.p75, row.p90], np.quantile(v, [.01, .5, .75, .9]))


@pytest.mark.parametrize("bucket", [3600, 86400 * 30])
def test_asof_join_matches_merge_asof(spark, bucket):
    rng = np.random.default_rng(3)
    t = lambda n: pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 10**6, n), unit="s")
    left = pd.DataFrame({"k": rng.integers(0, 3, 200), "at": t(200), "l": range(200)}).sort_values("at")
    right = pd.DataFrame({"k": rng.integers(0, 3, 80), "rt": t(80), "v": range(80)}).sort_values("rt")
    want = pd.merge_asof(left, right, left_on="at", right_on="rt", by="k").sort_values("l").v.to_numpy()
    got = cm.asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "at", "rt", ["v"], ["v"]).toPandas().sort_values("l").v.to_numpy()
    np.testing.assert_allclose(got.astype(float), want)


def test_overlap_join_has_no_repeats(spark):
    p = spark.createDataFrame([(1, "2024-01-03 12:00:00"), (2, "2024-01-09 00:00:00")], "id int, t string").withColumn("t", F.col("t").cast("timestamp"))
    s = spark.createDataFrame([(7, "2024-01-01", "2024-01-09"), (8, "2024-01-03 12:00:00", "2024-01-03 13:00:00")], "sid int, a string, b string").withColumn("a", F.col("a").cast("timestamp")).withColumn("b", F.col("b").cast("timestamp"))
    got = sorted((r.id, r.sid) for r in cm.overlap_join(p, s, [], "t", "a", "b").collect())
    assert got == [(1, 7), (1, 8)]
    closed = sorted((r.id, r.sid) for r in cm.overlap_join(p, s, [], "t", "a", "b", closed_end=True).collect())
    assert closed == [(1, 7), (1, 8), (2, 7)]


def numpy_adf(x, max_lag):
    """Direct fit: lag by AIC on the common sample, then the statistic on the longest sample of that lag."""
    d = np.diff(x)

    def design(p, first):
        rows = np.arange(first, len(d))
        return np.column_stack([np.ones(len(rows)), x[rows], *[d[rows - j] for j in range(1, p + 1)]]), d[rows]
    best = None
    for p in range(max_lag + 1):
        a, y = design(p, max_lag)
        e = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
        aic = len(y) * np.log(e @ e / len(y)) + 2 * (p + 2)
        best = min(best or (aic, p), (aic, p))
    p = best[1]
    a, y = design(p, p)
    b = np.linalg.lstsq(a, y, rcond=None)[0]
    e = y - a @ b
    se = np.sqrt(e @ e / (len(y) - p - 2) * np.linalg.inv(a.T @ a)[1, 1])
    return b[1] / se, p


def numpy_kpss(x):
    n, e = len(x), x - x.mean()
    cov = int(n ** (2 / 9))
    s0, s1 = e @ e / n, 0.0
    for k in range(1, cov + 1):
        c = e[k:] @ e[:-k] / (n / 2)
        s0, s1 = s0 + c, s1 + k * c
    lag = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    v = (e @ e + 2 * sum((1 - k / (lag + 1)) * (e[k:] @ e[:-k]) for k in range(1, lag + 1))) / n
    return (np.cumsum(e) ** 2).sum() / n ** 2 / v, lag


def test_unit_root_tests_match_direct_fits(spark):
    rng = np.random.default_rng(1)
    n = 600
    walk, noise = np.cumsum(rng.normal(size=n)), 5 + rng.normal(size=n)
    pdf = pd.concat([pd.DataFrame({"series_id": "a", "name": k, "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "i": np.arange(n), "value": v}) for k, v in (("walk", walk), ("noise", noise))])
    df = spark.createDataFrame(pdf)
    forms = st.both_forms(st.prepare(df, "1h"), al.KEYS).persist()
    a = {(r["name"], r.form): r for r in st.adf(forms, al.KEYS).collect()}
    k = {(r["name"], r.form): r for r in st.kpss(forms, al.KEYS).collect()}
    for name, x in (("walk", walk), ("noise", noise)):
        for form, v in (("level", x), ("first_difference", np.diff(x))):
            tau, lag = numpy_adf(v, min(max(4, len(v) // 20), 48))
            assert a[name, form].used_lag == lag
            np.testing.assert_allclose(a[name, form].tau, tau, rtol=1e-5)
            eta, bw = numpy_kpss(v)
            assert k[name, form].used_lag == bw
            np.testing.assert_allclose(k[name, form].statistic, eta, rtol=1e-6)
    v = {r["name"]: r for r in st.stationarity(forms).collect()}
    assert v["noise"].level_verdict == "stationary" and v["noise"].recommended_transform == "none"
    assert v["walk"].level_verdict in ("unit_root", "trend_or_break_suspected", "inconclusive")


def test_pacf_matches_yule_walker(spark):
    rng = np.random.default_rng(5)
    x = np.zeros(500)
    for j in range(2, 500):
        x[j] = 0.6 * x[j - 1] - 0.3 * x[j - 2] + rng.normal()
    df = spark.createDataFrame(pd.DataFrame({"series_id": "a", "i": np.arange(500), "value": x}))
    got = tg.price_pacf(df, 6).orderBy("lag").toPandas().partial_correlation.to_numpy()
    e = x - x.mean()
    r = np.array([e[k:] @ e[:len(e) - k] for k in range(7)]) / (e @ e)
    want = [np.linalg.solve(np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)]), r[1:k + 1])[-1] for k in range(1, 7)]
    np.testing.assert_allclose(got, want, atol=1e-6)


def test_crowded_values_spread_over_ranges(spark):
    """Values near 1e9 beside a single 0: ranks are exact, and no task orders more than a few times the aim."""
    df = spark.range(40_000).selectExpr("'a' AS k", "CASE WHEN id = 0 THEN 0.0 ELSE 1e9 + (id * 7919) % 40000 / 8.0 END AS x")
    got = cm.ranked_values(df, ["k"], "x", rows=500)
    rows = sorted((r._v, r._before) for r in got.collect())
    assert [b for _, b in rows] == list(range(40_000)) and rows == sorted(rows)
    spark.conf.set("spark.sql.adaptive.enabled", "false")       # small partitions would be put together
    try:
        sizes = cm.ranked_values(df, ["k"], "x", rows=500).selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(r["count"] for r in sizes) < 40_000 / 2


def test_long_spans_have_few_copies(spark):
    """A span to the year 9999 meets its points once each, from a bounded number of copies."""
    from pyspark.sql import functions as F
    s = spark.sql("SELECT 1 AS sid, timestamp'2024-01-03 05:00:00' AS a, timestamp'9999-12-31' AS b UNION ALL SELECT 2, timestamp'1969-12-20', timestamp'2024-02-01 12:00:00'")
    copies = s.select(F.size(cm.span_buckets(F.floor(F.unix_seconds("a") / 86400), F.floor(F.unix_seconds("b") / 86400))).alias("n")).collect()
    assert max(r.n for r in copies) <= 2 * cm.SPAN_BASE * cm.SPAN_LEVELS
    p = spark.sql("SELECT id, timestamp'2023-12-30' + make_dt_interval(id % 60, id % 24) AS t FROM range(500) UNION ALL SELECT 900, timestamp'7000-05-05' UNION ALL SELECT 901, timestamp'1969-12-25'")
    got = sorted((r.id, r.sid) for r in cm.overlap_join(p, s, [], "t", "a", "b").collect())
    want = sorted((r.id, r.sid) for r in p.crossJoin(s).where("t >= a AND t < b").select("id", "sid").collect())
    assert got == want and len(got) > 700
