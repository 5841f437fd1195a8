"""Query registry and the study frames derived from the driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import plain_times, tie_shift
from ..operators import align as al
from ..operators.common import cut, ensure_checkpoint_dir, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TARGET = "purchase"
DRIVERS = ["click", "error", "signup", "view"]
NAMES = [TARGET, *DRIVERS]


def query(name: str, sql: str | None = None):
    """Register a query (spark, tables) -> DataFrame with its oracle SQL."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain_times(fn(Tables(spark, sf_dir)))
        run.__name__, run.__doc__, run.__module__ = name, fn.__doc__, fn.__module__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return wrap


class Tables:
    """Driver tables and the study frames built from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir
        self._kept: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def events(self, by_user: bool = False) -> DataFrame:
        """Raw observations (series_id, name, ts, value, event_id): one series per event type, two markets or one per user."""
        return self.read("events").select(
            F.concat(F.lit("m"), (F.col("user_id") if by_user else F.col("user_id") % 2).cast("string")).alias("series_id"), F.col("event_type").alias("name"),
            F.col("ts").cast("timestamp").alias("ts"), "value", "event_id", "user_id")

    def hourly(self) -> DataFrame:
        return al.resample(self.events(), "1h", "mean")

    def aligned(self) -> DataFrame:
        """Hourly grid of every market with `purchase` as the target.

        Kept: a study prepares this frame once and runs all its functions over it.
        """
        return self.once("aligned", lambda: al.align(self.hourly(), TARGET, "1h"))

    def keep(self, df: DataFrame) -> DataFrame:
        """Checkpoint a frame that several steps of one study read."""
        return cut(df)

    def write(self, df: DataFrame) -> DataFrame:
        """Keep a wide frame of many rows as a table."""
        return written(df)

    def once(self, name: str, build: Callable[[], DataFrame], keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Build and keep a named frame the first time a query asks for it."""
        if name not in self._kept:
            self._kept[name] = (keep or self.keep)(build())
        return self._kept[name]

    def pairs(self) -> DataFrame:
        return self.once("pairs", lambda: al.pair_with_target(self.aligned(), TARGET))

    def filled_target(self) -> DataFrame:
        return self.once("filled_target", lambda: al.fill_linear(self.aligned().where(F.col("name") == TARGET)).drop("name"))

    def daily_orders(self) -> DataFrame:
        """Daily order value per priority, on the days that have orders."""
        return self.read("orders").groupBy(
            F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("timestamp").alias("ts")).agg(
            F.sum("o_totalprice").alias("value"))


def folder(t: Tables) -> str:
    """A fresh folder beside the checkpoints, shared by all executors."""
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/query-{uuid.uuid4().hex}"


RAW_SQL = """
obs AS (SELECT 'm' || CAST(user_id % 2 AS VARCHAR) AS series_id, event_type AS name, ts, value, event_id, user_id FROM events),
raw AS (SELECT series_id, name, date_trunc('hour', ts) AS ts, avg(value) AS value FROM obs GROUP BY 1, 2, 3)"""
ALIGNED_SQL = RAW_SQL + """,
bounds AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM raw WHERE name = 'purchase' GROUP BY 1),
slots AS (SELECT series_id, lo, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM bounds),
aligned AS (SELECT s.series_id, n.name, s.ts, CAST(date_diff('hour', s.lo, s.ts) AS BIGINT) AS i, r.value
  FROM slots s JOIN (SELECT DISTINCT series_id, name FROM raw) n ON n.series_id = s.series_id
  LEFT JOIN raw r ON r.series_id = s.series_id AND r.name = n.name AND r.ts = s.ts)"""
TARGET_SQL = ALIGNED_SQL + """,
x AS (SELECT series_id, ts, i, value FROM aligned WHERE name = 'purchase'),
xv AS (SELECT * FROM x WHERE value IS NOT NULL)"""
PAIR_SQL = ALIGNED_SQL + """,
pairs AS (SELECT d.series_id, d.name, d.ts, d.i, d.value AS x, t.value AS y
  FROM aligned d JOIN aligned t ON t.series_id = d.series_id AND t.ts = d.ts AND t.name = 'purchase' WHERE d.name <> 'purchase'),
both_known AS (SELECT * FROM pairs WHERE x IS NOT NULL AND y IS NOT NULL)"""
FILLED_SQL = TARGET_SQL + """,
near AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY i) AS pi,
  first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni FROM x),
filled AS (SELECT n.series_id, n.ts, n.i, n.value IS NULL AS filled,
  CASE WHEN n.value IS NOT NULL THEN n.value WHEN a.i IS NOT NULL AND b.i IS NOT NULL THEN a.value + (b.value - a.value) * ((n.i - a.i) / (b.i - a.i))
       ELSE coalesce(a.value, b.value) END AS value
  FROM near n LEFT JOIN x a ON a.series_id = n.series_id AND a.i = n.pi LEFT JOIN x b ON b.series_id = n.series_id AND b.i = n.ni)"""


def r(expr: str, places: int = 6) -> str:
    """Oracle rounding, as `r6` does it: ties up, never a negative zero."""
    return f"(round(CAST({expr} AS DOUBLE) + {tie_shift(places)!r}, {places}) + 0.0)"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"
