"""Linking and retrieval rules on small made cases."""

from pyspark.sql import functions as F
from slotwise.operators import extraction as ex
from slotwise.operators import merging as mg
from slotwise.operators import retrieval as rt
from slotwise.operators import target as tg

import pytest


def candidates(spark, rows):
    cols = "row_id long, event_id string, document_id string, document_version_id string, version long, available_at string, event_type string, asset_key string, region_key array<string>, market_key string, group_keys array<string>, cleared_fields array<string>"
    return spark.createDataFrame(rows, cols).withColumn("available_at", F.col("available_at").cast("timestamp")).withColumn("effective_start_at", F.lit(None).cast("timestamp")).withColumn("effective_end_at", F.lit(None).cast("timestamp"))


def test_versions_with_missing_keys_link(spark):
    base = lambda i, ver, region, group: (i, f"e{i}", "d", f"d_{ver}", ver, f"2024-01-0{ver}", "generation_outage", "a", region, None, group, [])
    c = candidates(spark, [base(1, 1, None, None), base(2, 2, None, None), base(3, 3, [], []), base(4, 4, ["r1"], None), base(5, 5, None, ["g"])])
    got = {r.row_id: r.component for r in mg.link_events(c).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_long_chain_of_links_settles(spark):
    nodes = spark.range(300).select(F.col("id").alias("row_id"))
    edges = spark.range(1, 300).select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst"))
    assert mg.components(nodes, edges).select("component").distinct().collect()[0].component == 0


@pytest.mark.parametrize("mention,reason,assets", [
    ("Torness Power Station Units 1 and 2", None, ["Torness Power Station Unit 1", "Torness Power Station Unit 2"]), ("Foo Plant Units 1, 2, and 3", None, ["Foo Plant Unit 1", "Foo Plant Unit 2", "Foo Plant Unit 3"]),
    ("Torness Units 1 and 2", "not_splittable", None), ("Foo Units 7", "not_splittable", None), ("Foo Plant Units 7", "not_splittable", None), ("石洞口电厂1、2号机组", None, ["石洞口电厂1号机组", "石洞口电厂2号机组"]),
    ("石洞口电厂1、2机组", "not_splittable", None), ("某电厂3号机组", "unnamed_parent", None), ("Foo Plant Generating Unit 3", None, ["Foo Plant Unit 3"])])
def test_unit_lists(spark, mention, reason, assets):
    r = ex.expand_assets(spark.createDataFrame([(mention,)], "mention string")).first()
    assert (r.reject_reason, r.assets) == (reason, assets)


def test_known_collections(spark):
    rows = spark.createDataFrame([("12 wind farms",), ("AGRs",), ("172座新型储能电站",)], "mention string")
    assert [r.group_key for r in ex.expand_assets(rows).collect()] == ["wind_generation", "AGR", "新型储能电站"]


def test_a_turn_that_does_not_fit_is_passed_over(spark):
    turns = spark.createDataFrame([(f"1:{i}", 1, i, "x" * n) for i, n in enumerate([7000, 10, 10, 5990])], "turn_id string, conv_id long, first_turn long, text string")
    gated = spark.createDataFrame([(1, f"1:{i}", 1, s, 1.0, True) for i, s in enumerate([9.0, 8.0, 7.0, 6.0])], "query_id long, turn_id string, conv_id long, score double, coverage double, relevant boolean")
    q = spark.createDataFrame([(1, 1, "q")], "query_id long, conv_id long, text string")
    got = rt.retrieve(gated, turns, q, k=3, budget=6000).orderBy("rank").collect()
    assert [(r.turn_id, r.rank, r.position) for r in got] == [("1:1", 1, 1), ("1:2", 2, 2)]


def test_turns_in_view_do_not_count(spark):
    turns = spark.createDataFrame([("1:0", 1, 0, "alpha beta"), ("1:1", 1, 1, "gamma"), ("1:2", 1, 2, "alpha alpha")], "turn_id string, conv_id long, first_turn long, text string")
    q = spark.createDataFrame([(1, 1, "alpha")], "query_id long, conv_id long, text string")
    m = rt.bm25_matches(rt.without_recent(turns, spark.createDataFrame([("1:2",)], "turn_id string")), q).collect()
    assert [(r.turn_id, r.df, r.docs) for r in m] == [("1:0", 1, 2)]


def test_lags_beyond_the_ceiling_are_refused():
    with pytest.raises(ValueError):
        tg.checked_lag(401)


def test_line_numbers_across_files_and_blocks(spark, tmp_path):
    from slotwise.sources import readers
    for f, n in (("a.jsonl", 400), ("b.jsonl", 3)):
        (tmp_path / f).write_text("".join(f'{{"title": "{f} {i}"}}\n' for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        got = [(r.file.rsplit("/", 1)[1], r.line_no, r.title) for r in readers.read_articles(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 403 and all(title == f"{f} {n}" for f, n, title in got)


def test_late_rows_are_set_aside(spark, tmp_path):
    from slotwise.streaming import sinks
    schema, out = "series_id string, ts timestamp, value double, available_at timestamp, tie long", str(tmp_path / "out")
    make = lambda *rows: spark.createDataFrame([(s, spark.sql(f"SELECT timestamp'{t}' t").first().t, v, spark.sql(f"SELECT timestamp'{a}' t").first().t, k) for s, t, v, a, k in rows], schema)
    sinks.upsert_batch(make(("a", "2024-03-01", 1.0, "2024-03-01", 1)), 0, out, ["series_id", "ts"], ["value"])
    sinks.upsert_batch(make(("a", "2024-01-01", 7.0, "2024-03-02", 2), ("a", "2024-03-02", 2.0, "2024-03-02", 3)), 1, out, ["series_id", "ts"], ["value"])
    assert [(r.value, r.batch) for r in sinks.read_rejected(spark, out).collect()] == [(7.0, 1)]
    assert sinks.read_generation(spark, out).count() == 2


def test_chunks_hold_their_own_text(spark):
    from slotwise.operators import documents as dc
    text = "One sentence here. Another one follows. " * 20
    got = dc.chunk_documents(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), 100).orderBy("chunk").collect()
    assert "".join(r.text for r in got) == text and all(r.text == text[r.start_char:r.end_char] and len(r.text) <= 100 for r in got)
