"""Streams over files: late revisions, repeats and tumbling windows."""

from pyspark.sql import functions as F
from slotwise.streaming import sinks

SCHEMA = "series_id string, name string, ts timestamp, value double, available_at timestamp, tie long"


def rows(spark, path, data):
    df = spark.createDataFrame(data, "series_id string, name string, ts string, value double, available_at string, tie long")
    df.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("available_at", F.col("available_at").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)


def run(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()


def test_upsert_publishes_whole_generations(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    rows(spark, src, [("a", "x", "2024-01-01 00:00:00", 1.0, "2024-01-01 01:00:00", 1), ("a", "x", "2024-03-01 00:00:00", 2.0, "2024-03-01 01:00:00", 2)])
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(src)
    keys = ["series_id", "name", "ts"]
    run(sinks.stream_upsert(stream(), out, ck, keys, ["value"]))
    rows(spark, src, [("a", "x", "2024-03-01 00:00:00", None, "2024-03-02 01:00:00", 3), ("a", "x", "2024-03-02 00:00:00", 9.0, "2024-03-02 02:00:00", 4), ("a", "x", "2024-01-01 00:00:00", 7.0, "2024-03-02 03:00:00", 5)])
    run(sinks.stream_upsert(stream(), out, ck, keys, ["value"]))
    got = [(str(r.ts)[:10], r.value, str(r.available_at)) for r in sinks.read_generation(spark, out).orderBy("ts").collect()]
    assert got == [("2024-01-01", 1.0, "2024-01-01 01:00:00"), ("2024-03-01", 2.0, "2024-03-02 01:00:00"), ("2024-03-02", 9.0, "2024-03-02 02:00:00")]
    batch = spark.createDataFrame([], SCHEMA)
    sinks.upsert_batch(batch, 1, out, keys, ["value"])             # the same batch id again starts from the generation before it
    assert sinks.current_generation(spark, out) == 1


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet") if "data" in str(f.relative_to(path))}


def test_a_batch_writes_the_days_it_touches(spark, tmp_path):
    """Two of 40 days: two day folders are written, all other files stay as they are."""
    out, keys = tmp_path / "out", ["series_id", "name", "ts"]
    make = lambda data: spark.createDataFrame(data, "series_id string, name string, ts string, value double, available_at string, tie long").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("available_at", F.col("available_at").cast("timestamp"))
    day = lambda d: f"2024-{1 + d // 31:02d}-{d % 31 + 1:02d}"
    sinks.upsert_batch(make([("a", "x", f"{day(d)} 0{h}:00:00", float(d), f"{day(d)} 05:00:00", 1) for d in range(31) for h in range(3)]), 0, str(out), keys, ["value"])
    before = files(out)
    assert len({f.split("/")[2] for f in before}) == 31
    sinks.upsert_batch(make([("a", "x", "2024-01-30 00:00:00", -1.0, "2024-02-01 00:00:00", 2), ("b", "x", "2024-01-20 07:00:00", -2.0, "2024-02-01 00:00:00", 3), ("a", "x", "2023-01-20 07:00:00", 9.0, "2024-02-01 00:00:00", 4),
                             ("a", "x", None, 9.0, "2024-02-01 00:00:00", 5)]), 1, str(out), keys, ["value"])
    after = files(out)
    assert {k: v for k, v in after.items() if k in before} == before
    assert {f.split("/")[1:3][1] for f in after.keys() - before.keys()} == {"_day=2024-01-30", "_day=2024-01-20"}
    now = {(r.series_id, str(r.ts)): r.value for r in sinks.read_generation(spark, str(out)).collect()}
    assert len(now) == 94 and now["a", "2024-01-30 00:00:00"] == -1.0 and now["a", "2024-01-30 01:00:00"] == 29.0 and now["b", "2024-01-20 07:00:00"] == -2.0
    assert sinks.read_generation(spark, str(out), 0).count() == 93
    assert sinks.read_rejected(spark, str(out)).count() == 2
    # a retry of the batch changes nothing
    sinks.upsert_batch(make([("b", "x", "2024-01-20 07:00:00", -3.0, "2024-02-01 00:00:00", 3)]), 1, str(out), keys, ["value"])
    now = {(r.series_id, str(r.ts)): r.value for r in sinks.read_generation(spark, str(out)).collect()}
    assert len(now) == 94 and now["a", "2024-01-30 00:00:00"] == 29.0 and now["b", "2024-01-20 07:00:00"] == -3.0
    assert sinks.vacuum(spark, str(out), keep=2) == []
    gone = sinks.vacuum(spark, str(out), keep=1)
    assert f"{out}/data/batch=0/_day=2024-01-20" in gone and len(gone) == 2
    assert sinks.read_generation(spark, str(out)).count() == 94


def test_latest_versions_come_out(spark, tmp_path):
    """Repeats, ties, older versions that arrive late, expired state and rows behind the watermark."""
    src, ck, out = (str(tmp_path / n) for n in ("src", "ck", "out"))
    at = lambda h, v, tie=1, ts="00", day="01": ("a", "x", f"2024-01-01 {ts}:00:00", v, f"2024-01-{day} {h:02d}:00:00", tie)
    stream = lambda: sinks.stream_versions(spark.readStream.schema(SCHEMA).parquet(src), ["series_id", "name"], "3 hours")
    go = lambda: run(stream().writeStream.option("checkpointLocation", ck).outputMode("append").format("parquet").option("path", out))
    shown = lambda: sorted((str(r.ts)[11:13], str(r.available_at)[8:13], r.value, r.tie) for r in spark.read.parquet(out).collect())
    rows(spark, src, [at(1, 1.0), at(1, 1.0), at(2, 2.0), at(2, 2.5, 7), at(1, 9.0, ts="05")])
    go()
    assert shown() == [("00", "01 02", 2.5, 7), ("05", "01 01", 9.0, 1)]
    rows(spark, src, [at(1, 1.5, 9), at(2, 2.5, 7), at(2, 2.4, 6)])          # older, equal, smaller tie
    go()
    assert len(shown()) == 2
    rows(spark, src, [at(4, 3.0), at(6, 5.0, ts="07")])
    go()
    assert shown() == [("00", "01 02", 2.5, 7), ("00", "01 04", 3.0, 1), ("05", "01 01", 9.0, 1), ("07", "01 06", 5.0, 1)]
    rows(spark, src, [at(1, 8.0, day="02", ts="09")])                        # the watermark passes all before; state goes
    go()
    rows(spark, src, [at(5, 4.0), at(23, 6.0, day="02")])                    # behind the watermark, and a revision after the state went
    go()
    assert ("00", "01 05", 4.0, 1) not in shown() and ("00", "02 23", 6.0, 1) in shown() and len(shown()) == 6


def test_tumbling_windows_wait_for_the_watermark(spark, tmp_path):
    src = str(tmp_path / "src")
    rows(spark, src, [("a", "x", f"2024-01-01 0{h}:{m}:00", float(h), "2024-01-01 01:00:00", h * 10 + m) for h in range(6) for m in (10, 40)])
    s = sinks.stream_resample(spark.readStream.schema(SCHEMA).parquet(src), "1 hour")
    run(s.writeStream.format("memory").queryName("resample_out").outputMode("append"))
    got = {str(r.ts): (r.value, r.observations) for r in spark.table("resample_out").collect()}
    assert got["2024-01-01 00:00:00"] == (0.0, 2) and "2024-01-01 05:00:00" not in got
