"""Structured Streaming forms: late revisions upserted by day, latest versions kept as state, tumbling resample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.common import latest
from ..sources.business import merge_incremental
from ..sources.snapshot import _fs

DAY = "_day"


# ---- upsert ---------------------------------------------------------------------------------------------------------

def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Finished batch ids under a folder, oldest first; a batch counts once its data is complete."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p(folder)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p(folder)) if s.isDirectory() and fs.exists(p(f"{folder}/{s.getPath().getName()}/_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))


def current_generation(spark: SparkSession, path: str) -> int | None:
    """Newest published batch id under `path`."""
    done = _batches(spark, f"{path}/manifest")
    return done[-1] if done else None


def manifest(spark: SparkSession, path: str, generation: int) -> list[tuple[str, int]]:
    """(day, batch that wrote it) of every day of a generation: one row a day, however many rows a day has."""
    return sorted(tuple(r) for r in spark.read.parquet(f"{path}/manifest/batch={generation}").select("day", "batch").collect())


def _read_days(spark: SparkSession, path: str, days: list[tuple[str, int]], schema: StructType) -> DataFrame:
    if not days:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/batch={b}/{DAY}={d}" for d, b in days])


def read_generation(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    """The table as the newest (or a named) batch published it: day folders are read where their last writer left them."""
    g = current_generation(spark, path) if generation is None else generation
    if g is None:
        raise ValueError(f"nothing published under {path}")
    days = manifest(spark, path, g)
    return spark.read.parquet(*[f"{path}/data/batch={b}/{DAY}={d}" for d, b in days]) if days else spark.read.parquet(f"{path}/data/batch={g}")


def upsert_batch(batch: DataFrame, batch_id: int, path: str, keys: list[str], fields: list[str], lookback_days: int = 30) -> None:
    """Merge a batch cell by cell into the days it touches and publish a manifest of all days last.

    Only days with arriving rows are read and written again, as new files; all other days keep their files, and the
    manifest points to them. Days before the lookback (counted from the newest day of the table) are closed: rows for
    them, and rows without a time, go to `path`/rejected/batch=<id> (see `read_rejected`), so none goes unseen. A retried
    batch starts from the manifest before it and replaces its own files. Days are UTC days of `ts`.
    """
    spark = batch.sparkSession
    day = F.date_from_unix_date(F.floor(F.unix_seconds("ts") / 86400).cast("int")).cast("string")
    new = latest(batch, keys, ["available_at", "tie"]).drop("tie").select(*keys, *fields, "available_at").withColumn(DAY, day)
    earlier = [b for b in _batches(spark, f"{path}/manifest") if b < batch_id]
    known = manifest(spark, path, earlier[-1]) if earlier else []
    late = F.col("ts").isNull()
    if known:
        edge = F.date_sub(F.lit(max(known)[0]).cast("date"), lookback_days).cast("string")
        late = late | (F.col(DAY) < edge)
        new.where(late).drop(DAY).write.mode("overwrite").parquet(f"{path}/rejected/batch={batch_id}")
    new = new.where(~late)
    touched = {r[0] for r in new.select(DAY).distinct().collect()}         # days inside the lookback
    schema = StructType([f for f in new.schema.fields if f.name != DAY])
    old = _read_days(spark, path, [x for x in known if x[0] in touched], schema)
    out = merge_incremental(old, new.drop(DAY), keys, fields).withColumn(DAY, day)
    # a day of many rows is split over tasks, a day of few is one file
    out.repartitionByRange(DAY, *keys).write.mode("overwrite").partitionBy(DAY).parquet(f"{path}/data/batch={batch_id}")
    rows = [(d, b) for d, b in known if d not in touched] + [(d, batch_id) for d in touched]
    spark.createDataFrame(rows, "day string, batch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={batch_id}")


def read_rejected(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows that arrived too late for their lookback, with their `batch`; None while there are none."""
    fs, p = _fs(spark, path)
    return spark.read.parquet(f"{path}/rejected") if fs.exists(p(f"{path}/rejected")) else None


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete day folders and manifests that the newest `keep` generations do not need; returns what was deleted."""
    fs, p = _fs(spark, path)
    done = _batches(spark, f"{path}/manifest")
    needed = {(b, d) for g in done[-keep:] for d, b in manifest(spark, path, g)}
    gone = []
    for b in _batches(spark, f"{path}/data"):
        if done and b > done[-1]:
            continue                                                        # written, not yet published
        folder = f"{path}/data/batch={b}"
        days = [s.getPath().getName().split("=")[1] for s in fs.listStatus(p(folder)) if s.isDirectory()]
        unused = [d for d in days if (b, d) not in needed]
        for f in [folder] if len(unused) == len(days) and b not in done[-keep:] else [f"{folder}/{DAY}={d}" for d in unused]:
            fs.delete(p(f), True)
            gone.append(f)
    for g in done[:-keep]:
        fs.delete(p(f"{path}/manifest/batch={g}"), True)
        gone.append(f"{path}/manifest/batch={g}")
    return gone


def stream_upsert(stream: DataFrame, path: str, checkpoint: str, keys: list[str], fields: list[str], lookback_days: int = 30) -> DataStreamWriter:
    """Writer that folds arriving versions (keys, ts in keys, fields, available_at, tie) into the days of `path`."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: upsert_batch(df, i, path, keys, fields, lookback_days))


# ---- latest versions ------------------------------------------------------------------------------------------------

def stream_versions(stream: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """Newest version per (keys, ts) as rows arrive: a row comes out when it is newer than all before it.

    State holds (available_at, tie) of the newest version of each timestamp, a day of timestamps together; equal times are
    decided by the larger tie, and a row equal in both is a repeat. Rows later than the watermark (`delay` behind the
    newest `available_at`) are left out by Spark, so what the watermark has passed can leave the state: whatever still
    arrives is newer. The newest row per key of the output, by (available_at, tie), is the latest visible version. Rows
    without ts, available_at or tie are left out.
    """
    columns = stream.columns
    schema = stream.select(*columns).schema

    def newest(key, frames: Iterator[pd.DataFrame], state: GroupState):
        held = dict(zip(state.get[0], zip(*state.get[1:]))) if state.exists else {}
        if not state.hasTimedOut:
            for pdf in frames:
                ts, at, tie = (pdf[c].to_numpy() for c in ("_ts", "_at", "tie"))
                order = np.lexsort((tie, at, ts))
                last = order[np.append(ts[order][1:] != ts[order][:-1], True)] if len(order) else order
                fresh = [i for i, t, v in zip(last.tolist(), ts[last].tolist(), zip(at[last].tolist(), tie[last].tolist())) if t not in held or v > tuple(held[t])]
                held.update((int(ts[i]), (int(at[i]), int(tie[i]))) for i in fresh)
                if fresh:
                    yield pdf.iloc[fresh][columns]
        mark = state.getCurrentWatermarkMs()
        held = {t: v for t, v in held.items() if v[0] // 1000 >= mark}
        if held:
            state.update((list(held), [v[0] for v in held.values()], [v[1] for v in held.values()]))
            state.setTimeoutTimestamp(min(v[0] for v in held.values()) // 1000 + 1)
        elif state.exists:
            state.remove()
    known = stream.where(F.col("ts").isNotNull() & F.col("available_at").isNotNull() & F.col("tie").isNotNull()).withWatermark("available_at", delay)
    known = known.withColumns({"_ts": F.unix_micros("ts"), "_at": F.unix_micros("available_at"), "_day": F.floor(F.unix_seconds("ts") / 86400)})
    return known.groupBy(*keys, "_day").applyInPandasWithState(newest, schema, "ts array<long>, at array<long>, tie array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def stream_resample(stream: DataFrame, freq: str, agg: str = "mean", delay: str = "1 hour") -> DataFrame:
    """Tumbling aggregate of arriving values per series; a window is emitted once the watermark has passed it."""
    fn = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[agg]
    w = stream.withWatermark("ts", delay).groupBy("series_id", "name", F.window("ts", freq).alias("_w")).agg(fn("value").alias("value"), F.count("value").alias("observations"))
    return w.select("series_id", "name", F.col("_w.start").alias("ts"), "value", "observations")
