"""Planted signals, leak checks, identities of distributions, sources and document rules."""

import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from slotwise.functions import tails
from slotwise.operators import align as al
from slotwise.operators import documents as dc
from slotwise.operators import forecast as fc
from slotwise.operators import merging as mg
from slotwise.operators import relations as rel
from slotwise.operators import target as tg
from slotwise.sources import readers as rd
from slotwise.sources import snapshot as sn


def planted(spark):
    rng = np.random.default_rng(11)
    n = 900
    t = np.arange(n)
    load = 10 * np.sin(2 * np.pi * t / 24) + rng.normal(size=n)
    price = 250 + 9 * np.roll(load, 2) + rng.normal(size=n)
    price[:2] = np.nan
    cols = {"price": price, "load": load, "copy": 1.002 * load + 0.01 * rng.normal(size=n), "noise": rng.normal(size=n)}
    ts = pd.date_range("2025-01-01", periods=n, freq="h")
    pdf = pd.concat([pd.DataFrame({"series_id": "a", "name": k, "ts": ts, "value": v}) for k, v in cols.items()])
    df = spark.createDataFrame(pdf).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    return cols, al.align(al.resample(df, "1h"), "price", "1h").persist()


def test_lead_vif_granger_and_mi_find_the_plant(spark):
    cols, a = planted(spark)
    p = al.pair_with_target(a, "price").persist()
    best = {r["name"]: r for r in rel.lead_scan_best(rel.lead_scan(p, 12), p_value=True).collect()}
    assert best["load"].lag == 2 and best["load"].correlation > 0.98 and best["load"].p_value == 0.0
    v = {r["name"]: r for r in rel.vif(a, ["load", "copy", "noise"]).collect()}
    assert v["load"].severity == v["copy"].severity == "severe" and v["noise"].severity == "acceptable"
    x = np.column_stack([np.ones(898), cols["copy"][2:], cols["noise"][2:]])
    y = cols["load"][2:]
    e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    np.testing.assert_allclose(v["load"].vif, ((y - y.mean()) ** 2).sum() / (e @ e), rtol=1e-4)
    g = {r["name"]: r for r in rel.granger_strongest(rel.granger(p, "1h", 6)).collect()}
    assert g["load"].precedes and g["load"].p_value == 0.0
    mi = rel.mutual_information(p, 4).where("name = 'load'").orderBy(F.desc("normalized")).head()
    assert mi.lag == 2


def test_granger_statistic_matches_direct_regression(spark):
    cols, a = planted(spark)
    row = rel.granger(al.pair_with_target(a, "price"), "1h", 2).where("name = 'noise' and lag = 2").head()
    y, x = cols["price"][2:], cols["noise"][2:]
    n, p = len(y), 2
    own = [y[p - j:n - j] for j in (1, 2)]
    rss = []
    for extra in ([], [x[p - j:n - j] for j in (1, 2)]):
        d = np.column_stack([np.ones(n - p), *own, *extra])
        e = y[p:] - d @ np.linalg.lstsq(d, y[p:], rcond=None)[0]
        rss.append(e @ e)
    f = ((rss[0] - rss[1]) / p) / (rss[1] / (n - p - 2 * p - 1))
    np.testing.assert_allclose(row.f_statistic, f, rtol=1e-3)


def test_daily_cycle_is_found(spark):
    _, a = planted(spark)
    d = tg.decompose(al.fill_linear(a.where("name = 'price'")).drop("name"), "1h")
    s = tg.decomposition_summary(d).head()
    assert s.day_strength > 0.9 and s.week_strength < 0.3


def test_tails_against_tables():
    np.testing.assert_allclose(tails.t_two_sided([2.228, 1.96], [10, 1e6]), [0.05, 0.05], atol=2e-4)
    np.testing.assert_allclose(tails.f_upper([3.326, 4.965], [5, 1], [10, 10]), [0.05, 0.05], atol=2e-4)
    np.testing.assert_allclose(tails.chi2_upper([3.841, 18.307], [1, 10]), [0.05, 0.05], atol=2e-4)
    np.testing.assert_allclose(tails.adf_p([-2.86, -3.43]), [0.05, 0.01], atol=2e-3)
    np.testing.assert_allclose(tails.kpss_p([0.463, 5.0, 0.1]), [0.05, 0.01, 0.10])


def test_clock_changes_give_null(spark):
    rows = [("2024-03-31 02:30:00",), ("2024-10-27 02:30:00",), ("2024-06-01 12:00:00",), ("2024-06-01T12:00:00+05:00",), ("junk",)]
    got = [r.t for r in spark.createDataFrame(rows, "s string").select(rd.normalize_ts("s", "Europe/Berlin").cast("string").alias("t")).collect()]
    assert got == [None, None, "2024-06-01 10:00:00", "2024-06-01 07:00:00", None]


def test_csv_series_and_missing_columns(spark, tmp_path):
    f = tmp_path / "price.csv"
    f.write_text("datetime,price\n2025-01-01 00:00:00,1.5\n2025-01-01 01:00:00,bad\nnot a time,3\n2025-01-01 01:00:00,4\n")
    spec = rd.SeriesSpec("price", str(f), "datetime", "price", tz="Asia/Shanghai")
    e = rd.load_evidence(rd.read_series(spark, spec)).head()
    assert (e.raw_rows, e.invalid_timestamp_rows, e.non_numeric_rows, e.duplicate_timestamp_rows, e.duplicate_timestamp_keys) == (4, 1, 1, 2, 1)
    roles = {r["column"]: r.role for r in rd.infer_roles(rd.column_profile(rd.read_table(spark, str(f)))).collect()}
    assert roles["datetime"] == "timestamp"
    try:
        rd.load_series(rd.read_table(spark, str(f)), rd.SeriesSpec("x", str(f), "datetime", "load"))
        raise AssertionError("a missing column must be refused")
    except ValueError as err:
        assert "load" in str(err)


def test_articles_keep_bad_lines(spark, tmp_path):
    good = {"source_name": "s", "source_document_id": "1", "title": "t", "body": "b", "published_at": "2024-01-01T00:00:00Z", "collected_at": "2024-01-01T00:00:00Z"}
    f = tmp_path / "a.jsonl"
    f.write_text("\n".join([json.dumps(good), "{broken", json.dumps({**good, "title": ""})]))
    reasons = [r.reason for r in rd.read_articles(spark, str(f)).orderBy("line_no").collect()]
    assert reasons == [None, "invalid json", "missing fields: title"]


def test_freeze_restore_prune(spark, tmp_path):
    df = spark.range(100).withColumn("name", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    fp = sn.fingerprint(df).head().fingerprint
    assert fp == sn.fingerprint(df.repartition(7).orderBy(F.desc("id"))).head().fingerprint
    assert fp != sn.fingerprint(df.where("id > 0")).head().fingerprint
    root = str(tmp_path / "frozen")
    sn.freeze(df, root, fp, ["name"])
    sn.freeze(df.limit(1), root, fp, ["name"])                     # finished copies are left alone
    back = sn.restore(spark, root, fp)
    assert back.count() == 100 and sn.fingerprint(back).head().fingerprint == fp
    for j in range(3):
        sn.freeze(df, root, f"other{j}")
    assert len(sn.prune(spark, root, 2)) == 2


def test_write_result_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "a"), (2, 3.5, "b")], "fold_id int, predicted double, name string")
    rd.write_result(df, str(tmp_path / "p"), "parquet", ["fold_id"])
    rd.write_result(df, str(tmp_path / "c"), "csv")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert sorted(r.name for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()) == ["a", "b"]


def test_chunks_cover_the_whole_text(spark):
    texts = ["", "short", "alpha beta. " * 50, "line\n" * 300, "x" * 1000, "字。" * 400]
    d = spark.createDataFrame([(j, x) for j, x in enumerate(texts)], "doc_id long, text string")
    rows = dc.chunk_documents(d, 97).orderBy("doc_id", "chunk").collect()
    for j, x in enumerate(texts):
        mine = [r for r in rows if r.doc_id == j]
        assert "".join(r.text for r in mine) == x
        assert all(x[r.start_char:r.end_char] == r.text and len(r.text) <= 97 for r in mine)


def test_components_of_a_long_chain(spark):
    n = 200
    nodes = spark.range(n + 3).withColumnRenamed("id", "row_id")
    edges = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = {r.row_id: r.component for r in mg.components(nodes, edges).collect()}
    assert all(got[j] == 0 for j in range(n)) and [got[n + j] for j in range(3)] == [n, n + 1, n + 2]


def forecast_frames(spark, bump=0.0):
    ts = pd.date_range("2024-01-01", periods=20 * 24, freq="h")
    rng = np.random.default_rng(2)
    y = 50 + 10 * np.sin(2 * np.pi * np.arange(len(ts)) / 24) + rng.normal(size=len(ts))
    cut = pd.Timestamp("2024-01-15 06:00:00")
    y = np.where(ts > cut, y + bump, y)
    base = pd.DataFrame({"series_id": "a", "ts": ts, "available_at": ts + pd.Timedelta(hours=1), "tie": range(len(ts))})
    target = spark.createDataFrame(base.assign(rt_price=y))
    actual = spark.createDataFrame(base.assign(actual_load=y * 2, temperature=y / 3))
    fcst = spark.createDataFrame(base.assign(forecast_load=y[0] * 2.0, forecast_wind=1.0, forecast_solar=2.0, temperature=5.0, available_at=pd.Timestamp("2024-01-01")))
    folds = spark.createDataFrame([("a", 1, "2024-01-15 06:00:00")], "series_id string, fold_id long, as_of string").withColumn("as_of", F.col("as_of").cast("timestamp"))
    folds = folds.withColumn("target_start", F.col("as_of") + F.expr("INTERVAL 18 HOURS")).withColumn("target_end", F.col("as_of") + F.expr("INTERVAL 42 HOURS"))
    return target, actual, fcst, folds


def test_rows_after_the_cutoff_change_nothing(spark):
    out = []
    for bump in (0.0, 1000.0):
        snap = fc.snapshots(*forecast_frames(spark, bump), "1h").persist()
        feats = fc.fill_from_training(fc.raw_features(snap, 24)).persist()
        names = ["price_lag_96", "price_mean_16", "fcst_load_type_11", "hour_sin", "hour_cos"]
        pred = fc.fit_predict(fc.standardize(feats, names), names).orderBy("ts").toPandas().predicted.to_numpy()
        out.append((feats.drop("rt_price").orderBy("ts").toPandas(), pred))
    pd.testing.assert_frame_equal(out[0][0], out[1][0])
    np.testing.assert_allclose(out[0][1], out[1][1])
    assert len(out[0][1]) == 24 and np.isfinite(out[0][1]).all()
