"""Streaming queries: the tables arrive as a file stream and are drained with an available-now trigger."""

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators.common import latest
from ..sources import business as bz
from ..streaming import sinks
from .base import folder, query, r
from .sources import CLOCK_SQL, clock_table


class StreamTables:
    """The driver tables as streams: `read` gives a streaming frame with the table's schema."""

    def __init__(self, t):
        self.t, self.spark, self.sf_dir = t, t.spark, t.sf_dir

    def read(self, name):
        return self.spark.readStream.schema(self.t.read(name).schema).parquet(f"{self.sf_dir}/{name}.parquet*")


def drain(writer) -> None:
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()


def _append(df, root):
    return df.writeStream.option("checkpointLocation", f"{root}/log").outputMode("append").format("parquet").option("path", f"{root}/out")


def observations(t):
    s = StreamTables(t)
    c = bz.with_business_time(clock_table(s))
    return c.select(F.col("province").alias("series_id"), F.col("type").alias("name"), "ts", F.col("quantity").alias("value"), F.col("create_time").alias("available_at"), "tie")


@query("stream_resample", f"""WITH o AS (SELECT 'm' || (user_id % 2) AS series_id, event_type AS name, date_trunc('hour', ts) AS ts, value FROM events)
SELECT series_id, name, ts, {r('avg(value)')} AS value, count(value) AS observations FROM o WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2, 3""")
def _(t):
    """Hourly means of the windows the watermark has passed."""
    root = folder(t)
    e = StreamTables(t).read("events").select(F.concat(F.lit("m"), (F.col("user_id") % 2).cast("string")).alias("series_id"), F.col("event_type").alias("name"), F.col("ts").cast("timestamp").alias("ts"), "value")
    drain(_append(sinks.stream_resample(e, "1 hour"), root))
    return t.spark.read.parquet(f"{root}/out").withColumn("value", r6("value"))


@query("stream_versions", f"WITH {CLOCK_SQL} SELECT series_id, name, ts, available_at, {r('value')} AS value, tie FROM norm")
def _(t):
    """Latest visible version of every timestamp, although each row arrives twice."""
    root = folder(t)
    good = observations(t).where(F.col("ts").isNotNull() & F.col("value").isNotNull())
    twice = good.withColumn("_x", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_x")
    drain(_append(sinks.stream_versions(twice, ["series_id", "name"]), root))
    emitted = t.spark.read.parquet(f"{root}/out").select("series_id", "name", "ts", "available_at", "value", "tie")
    return latest(emitted, ["series_id", "name", "ts"], ["available_at", "tie"]).withColumn("value", r6("value"))


@query("stream_upsert", f"WITH {CLOCK_SQL} SELECT series_id, name, ts, {r('value')} AS value, available_at FROM norm")
def _(t):
    """Newest version per timestamp as the published generation."""
    root = folder(t)
    good = observations(t).where(F.col("ts").isNotNull() & F.col("value").isNotNull())
    drain(sinks.stream_upsert(good, f"{root}/out", f"{root}/log", ["series_id", "name", "ts"], ["value"]))
    return sinks.read_generation(t.spark, f"{root}/out").select("series_id", "name", "ts", r6("value").alias("value"), "available_at")
