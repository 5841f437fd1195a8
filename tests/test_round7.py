"""One small test per step mended for the findings of round 4."""

import os

import numpy as np
import oracle
import pandas as pd
import pytest
from pyspark.sql import functions as F
from slotwise import plans
from slotwise.operators import align as al
from slotwise.operators import documents as dc
from slotwise.operators import quality as ql
from slotwise.operators import study as sd
from slotwise.plans import base
from slotwise.sources import readers as rd

SMALL = "/root/testdata/sf0.001"
HALF = al.MarketClock("m", "UTC", 30)


@pytest.fixture(scope="module")
def odd_texts(spark, tmp_path_factory):
    """The tables of sf0.001 with empty, missing and blank texts among the documents."""
    root = tmp_path_factory.mktemp("odd")
    for t in oracle.TABLES:
        if t != "documents":
            os.symlink(f"{SMALL}/{t}.parquet", root / f"{t}.parquet")
    k = F.col("doc_id") % 23
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    d = d.withColumn("text", F.when(k == 1, "").when(k == 2, F.lit(None)).when(k == 3, " ").when(k == 4, "\r\n\u0001 ﻿\U0001d15e\"\\").otherwise(F.col("text")))
    d.toPandas().to_parquet(root / "documents.parquet")
    return str(root)


def differs(spark, sf_dir, name):
    queries, sql = plans.load()
    return oracle.compare(spark, oracle.duck(sf_dir), queries[name], sql[name], sf_dir)[1]


def test_articles_with_empty_texts_are_articles(spark, odd_texts):
    """as the SQL has them; the operator itself still sets a line without a body aside."""
    assert differs(spark, odd_texts, "parse_articles") is None
    line = spark.createDataFrame([(1, '{"source_name": "s", "source_document_id": "1", "title": "t", "body": "", "published_at": "p", "collected_at": "c"}')], "line_no long, value string")
    assert [r.reason for r in rd.parse_articles(line).collect()] == ["missing fields: body"]


def test_files_with_empty_texts_are_read_whole(spark, odd_texts):
    """lines and characters per reason as the SQL has them."""
    assert differs(spark, odd_texts, "read_articles") is None


def test_records_with_empty_texts_are_judged_by_the_other_fields(spark, odd_texts):
    """as the SQL has them; the operator itself still sets a record without content aside."""
    assert differs(spark, odd_texts, "validate_records") is None
    record = {c: "x" for c in dc.REQUIRED} | {"content": "", "content_scope": "excerpt"}
    raw = spark.createDataFrame([tuple(record.values())], list(record))
    assert [r.reason for r in dc.validate_records(raw, spark.createDataFrame([("x",)], "query_id string")).collect()] == ["missing fields: content"]


def known_prices(rng, n=30_000):
    rows = [(s, int(i), float(v)) for s, k in (("a", 300), ("b", 40), ("c", 1)) for i, v in zip(np.sort(rng.choice(n, k, replace=False)), rng.normal(50, 20, k))]
    return pd.DataFrame(rows, columns=["series_id", "i", "value"])


@pytest.mark.parametrize("tz, rank_rows", [("UTC", 100_000), ("Europe/Berlin", 100_000), ("UTC", 100)])
def test_windows_out_of_packed_lines(spark, monkeypatch, tz, rank_rows):
    """chunks opened in their task give the levels, thresholds and windows of the grid opened slot by slot, in long series too."""
    monkeypatch.setattr(sd, "RANK_ROWS", rank_rows)
    clock, rng = al.MarketClock("m", tz, 30), np.random.default_rng(3)
    known = known_prices(rng)
    at = lambda c: F.timestamp_seconds(F.col(c) * 1800)
    prices = spark.createDataFrame(known).select("series_id", at("i").alias("ts"), "value")
    spans = spark.createDataFrame([(s, "e", int(a), int(a + w)) for s in "ab" for a, w in zip(rng.choice(30_000, 200), rng.choice([0, 3, 9, 900], 200))], "series_id string, event_id string, a long, z long").select("series_id", "event_id", at("a").alias("s"), at("z").alias("z"))
    where = pd.DataFrame({"series_id": np.repeat(["a", "b", "c"], 100), "i": rng.choice(30_000, 300)}).drop_duplicates()
    marks = spark.createDataFrame(where).select("series_id", at("i").alias("ts"))
    lines = sd.chunk_lines(prices, spans, clock, (1, 2), marks.withColumn("m", F.lit(sd.AT_EVENT)))
    assert lines.count() < 20
    b = sd.baseline(prices, lines, clock)
    got = sd.line_windows(lines.join(b, "series_id"), clock, (1, 2), "event").toPandas().sort_values(["series_id", "hours", "start_at"], ignore_index=True)

    grid = sd.grid_slots(al.filled_grid(prices.withColumn("name", F.lit("p")), "30min", ["series_id"]), spans, clock, marks).toPandas().sort_values(["series_id", "ts"])
    local = grid.ts.dt.tz_localize("UTC").dt.tz_convert(tz)
    grid["how"] = local.dt.weekday * 24 + local.dt.hour
    free = grid[~grid.busy]
    level = free.groupby(["series_id", "how"]).value.mean()
    overall, limit = free.groupby("series_id").value.mean(), free.groupby("series_id").value.quantile(.95)
    for r in b.collect():
        assert abs(r.overall - overall[r.series_id]) < 1e-9 and abs(r.spike_threshold - limit[r.series_id]) < 1e-9
        assert [x.how for x in r.hours] == list(level[r.series_id].index) and np.allclose([x.level for x in r.hours], level[r.series_id])
        assert sum(x.slots for x in r.hours) == (free.series_id == r.series_id).sum()
    pairs = list(zip(grid.series_id, grid.how))
    grid["expected"] = level.reindex(pairs).to_numpy()
    grid["expected"] = grid.expected.fillna(grid.series_id.map(overall))
    grid["spike"] = grid.value > grid.series_id.map(limit)
    want = sd.slot_windows(spark.createDataFrame(grid.drop(columns=["how", "marked"]).assign(asked=grid.marked)), clock, (1, 2)).toPandas().sort_values(["series_id", "hours", "start_at"], ignore_index=True)
    assert len(got) > 100
    pd.testing.assert_frame_equal(got, want)


@pytest.mark.parametrize("name", ["event_study", "window_metrics"])
def test_study_keeps_fewer_rows_than_slots(spark, monkeypatch, name):
    """no frame of slots is written."""
    kept, write = [], base.Tables.write
    monkeypatch.setattr(base.Tables, "write", lambda t, df: kept.append(write(t, df)) or kept[-1])
    assert plans.load()[0][name](spark, SMALL).count() > 0
    t = base.Tables(spark, SMALL)
    half = al.resample(t.events(by_user=True).where(F.col("name") == "purchase"), "30min")
    assert sum(k.count() for k in kept) < al.filled_grid(half, "30min", ["series_id"]).count()


def test_links_are_ranked_once_for_all_windows(spark):
    """F8: documents are ranked by event, before they are copied to its windows."""
    res = spark.createDataFrame([("a", 1, h, "c") for h in (1, 2)] + [("a", 2, 1, "c")], "series_id string, event_id long, hours int, conclusion string")
    m = spark.createDataFrame([(1, "x", 2, 5), (1, "y", 1, 9), (2, "x", 0, 1)], "event_id long, document_version_id string, authority int, available_at int")
    s = spark.createDataFrame([("x", "f", "q"), ("x", "e", "q"), ("y", "f", "q")], "document_version_id string, field_name string, quote string")
    links = sd.evidence_links(res, m, s)
    assert "windowspecdefinition(event_id" in links._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.event_id, r.hours, r.link_rank, r.document_version_id, r.field_name) for r in links.collect())
    one = [(1, "y", "f"), (2, "x", "e"), (3, "x", "f")]
    assert got == [(1, h, *x) for h in (1, 2) for x in one] + [(2, 1, 1, "x", "e"), (2, 1, 2, "x", "f")]


def test_grid_rules_from_runs(spark):
    """A grid is checked as runs of rows; times that occur twice, lie off the grid or miss are counted as one by one."""
    rng = np.random.default_rng(7)
    rows = [("whole", i * 1800, 1.0) for i in range(5000)]
    rows += [("twice", i * 1800, 1.0) for i in range(500)] * 2 + [("gaps", int(i) * 1800, None if i % 7 == 0 else 1.0) for i in np.flatnonzero(rng.random(900) < .5)]
    rows += [("off", i * 1800 + 60 * (i % 3 == 0), float("inf") if i == 4 else 1.0) for i in range(300)] + [("mixed", i * 1800 + 900 * (i % 2), 1.0) for i in rng.choice(200, 400)] + [("nested", i * 1800, 1.0) for i in [*range(100), 5, 6, 50, 50]]
    rows = [(s, int(t), v) for s, t, v in rows]
    df = spark.createDataFrame(rows, "series_id string, t long, value double").select("series_id", F.timestamp_seconds("t").alias("ts"), "value")
    assert ql.grid_runs(df.where("series_id = 'whole'").coalesce(1), HALF, ["series_id"]).count() < 10
    got = {(r.series_id, r.rule): r.rows for r in ql.validate_grid(df, HALF).collect()}
    want = {}
    for s, x in pd.DataFrame(rows, columns=["s", "t", "v"]).groupby("s"):
        t = np.unique(x.t)
        want |= {(s, "duplicate_times"): len(x) - len(t), (s, "off_grid"): (t % 1800 > 0).sum(), (s, "not_contiguous"): (np.diff(t) != 1800).sum(), (s, "not_finite"): (~np.isfinite(x.v)).sum()}
    assert got == {k: n for k, n in want.items() if n}
