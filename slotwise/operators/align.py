"""Resampling, canonical grids, coverage, gap filling and market clocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ceil_ts, floor_ts, freq_seconds, r6, shift_ts
from .common import CHUNK, quantiles

KEYS = ["series_id", "name"]
LADDER = ("1h", "2h", "3h", "6h", "12h", "1D")


def window_filter(df: DataFrame, start=None, end=None, col: str = "ts") -> DataFrame:
    """Rows inside the closed study window; either end may be open."""
    if start is not None:
        df = df.where(F.col(col) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col(col) <= F.lit(end).cast("timestamp"))
    return df


def resample(df: DataFrame, freq: str, agg: str = "mean", keys: list[str] | None = None, tz: str = "UTC") -> DataFrame:
    """Aggregate `value` per interval start: mean, median, sum, min, max, first, last."""
    keys = KEYS if keys is None else keys
    slot = df.withColumn("ts0", F.col("ts")).withColumn("ts", floor_ts("ts", freq_seconds(freq), tz))
    if agg == "median":
        spans = slot.select(*keys, "ts").distinct()
        med = quantiles(slot, [*keys, "ts"], "value", {"value": 0.5}).drop("n")
        return spans.join(med, [*keys, "ts"], "left")
    seen = F.col("value").isNotNull()
    order = F.when(seen, F.struct("ts0", "value"))
    fn = {
        "mean": F.avg("value"), "sum": F.sum("value"), "min": F.min("value"), "max": F.max("value"),
        "first": F.min_by("value", order), "last": F.max_by("value", order),
    }[agg]
    return slot.groupBy(*keys, "ts").agg(fn.alias("value"))


def grid(bounds: DataFrame, freq: str, start: str = "lo", end: str = "hi") -> DataFrame:
    """Gap-free slots from `start` to `end` (closed): adds `ts` and position `i`.

    Built in two steps, days then slots, so no row carries a whole series.
    """
    step = freq_seconds(freq)
    lo, hi = F.unix_seconds(F.col(start)), F.unix_seconds(F.col(end))
    block = step * max(1, 86400 // step)
    b = bounds.withColumn("_lo", lo).withColumn("_hi", hi)
    b = b.withColumn("_d", F.explode(F.sequence(F.col("_lo"), F.col("_hi"), F.lit(block).cast("long"))))
    b = b.withColumn("_s", F.explode(F.sequence(
        F.col("_d"), F.least(F.col("_hi"), F.col("_d") + F.lit(block - step)), F.lit(step).cast("long"))))
    return (b.withColumn("ts", F.timestamp_seconds("_s"))
             .withColumn("i", ((F.col("_s") - F.col("_lo")) / step).cast("long"))
             .drop("_lo", "_hi", "_d", "_s"))


def align(regular: DataFrame, target: str, freq: str) -> DataFrame:
    """Put every series on the target's gap-free grid: (series_id, name, ts, i, value)."""
    known = F.when((F.col("name") == target) & F.col("value").isNotNull(), F.col("ts"))
    whole = Window.partitionBy("series_id")                   # one row per series name
    spans = (regular.groupBy("series_id", "name").agg(F.min(known).alias("_a"), F.max(known).alias("_z"))
             .select("series_id", "name", F.max("_a").over(whole).alias("lo"), F.max("_z").over(whole).alias("hi"))
             .where(F.col("lo").isNotNull()))
    slots = grid(spans, freq).select("series_id", "name", "ts", "i")
    return slots.join(regular.select("series_id", "name", "ts", "value"), ["series_id", "name", "ts"], "left")


def widen(aligned: DataFrame, names: list[str]) -> DataFrame:
    """One column per named series on the shared grid."""
    return (aligned.groupBy("series_id", "ts", "i")
            .agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names]))


def pair_with_target(aligned: DataFrame, target: str) -> DataFrame:
    """Rows (series_id, name, ts, i, x, y): each driver beside the target of its slot. One shuffle."""
    w = Window.partitionBy("series_id", "ts")
    return (aligned.withColumn("y", F.max(F.when(F.col("name") == target, F.col("value"))).over(w))
            .where(F.col("name") != target).withColumnRenamed("value", "x"))


def coverage(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("slots"), F.count("value").alias("observations"),
        (F.count(F.lit(1)) - F.count("value")).alias("missing"),
        r6(F.avg(F.col("value").isNotNull().cast("double"))).alias("coverage"))


def reduce_resolution(df: DataFrame, freq: str, max_points: int | None, keys: list[str] | None = None) -> DataFrame:
    """Mean-aggregate each series on the first ladder rung that leaves at most `max_points` slots.

    Without `max_points` every series keeps its own step. Grid slots are counted, gaps included. Adds `step` (seconds of the rung), the
    dense position `i`, the slot count `n` and the raw mean `level`.
    """
    keys = KEYS if keys is None else keys
    step = freq_seconds(freq)
    rungs = [step, *[freq_seconds(f) for f in LADDER]]
    t = F.unix_seconds("ts")
    size = df.groupBy(*keys).agg(F.min(t).alias("_a"), F.max(t).alias("_b"), F.avg("value").alias("level"))
    slots = lambda s: F.floor(F.col("_b") / s) - F.floor(F.col("_a") / s) + 1
    pick = F.coalesce(*[F.when(slots(s) <= max_points, F.lit(s)) for s in rungs], F.lit(86400)).cast("long") if max_points else F.lit(step).cast("long")
    chosen = (size.where(F.col("level").isNotNull()).withColumn("step", pick)
              .select(*keys, "step", "level", F.floor(F.col("_a") / F.col("step")).alias("_first"), slots(F.col("step")).alias("n")))
    slot = F.floor(t / F.col("step"))
    cut = df.join(chosen, keys).withColumn("i", slot - F.col("_first")).withColumn("ts", F.timestamp_seconds(slot * F.col("step")))
    return cut.groupBy(*keys, "step", "n", "level", "ts", "i").agg(F.avg("value").alias("value"))


def fill_linear(df: DataFrame, keys: list[str] | None = None, order: str = "i", chunk: int | None = None) -> DataFrame:
    """Fill gaps linearly in time; ends take the nearest value. Adds `filled` (was missing).

    The nearest known value on either side is found inside the chunk, or taken
    from one summary row per chunk when the gap crosses the chunk's edge.
    """
    keys = KEYS if keys is None else keys
    size = chunk or CHUNK
    known = F.col("value").isNotNull()
    # by chunk even if the rows lie by key already: a grid opened from few rows lies in few partitions
    base = df.withColumn("_c", F.floor(F.col(order) / size)).withColumn("_p", F.when(known, F.unix_micros("ts"))).repartition(*keys, "_c")
    # the next known value is the last one on the way back: a frame with an open end would be scanned anew for every row
    w, back = (Window.partitionBy(*keys, "_c").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col(order), F.col(order).desc()))
    rows = base.select("*", *[F.last(c, True).over(f).alias(n) for f, side in ((w, "a"), (back, "b")) for c, n in (("_p", f"_{side}t"), ("value", f"_{side}v"))])
    at = F.when(known, F.col(order))
    ends = base.groupBy(*keys, "_c").agg(F.max_by("_p", at).alias("_lt"), F.max_by("value", at).alias("_lv"), F.min_by("_p", at).alias("_ft"), F.min_by("value", at).alias("_fv"))
    cw, cback = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("_c"), F.col("_c").desc()))
    ends = ends.select(*keys, "_c", *[F.last(c, True).over(f).alias(f"_c{c}") for f, cols in ((cw, ("_lt", "_lv")), (cback, ("_ft", "_fv"))) for c in cols])
    j = rows.join(ends.hint("merge"), [*keys, "_c"])       # rows are sorted so; Spark's sizes do not see the opened grid and would broadcast it
    at, av, bt, bv = (F.coalesce(*c) for c in (("_at", "_c_lt"), ("_av", "_c_lv"), ("_bt", "_c_ft"), ("_bv", "_c_fv")))
    t = F.unix_micros("ts")
    line = av + (bv - av) * ((t - at) / (bt - at))
    value = F.coalesce(F.col("value"), F.when(at.isNotNull() & bt.isNotNull(), line), av, bv)
    return (j.withColumn("filled", F.col("value").isNull()).withColumn("value", value)
             .drop("_c", "_p", "_at", "_av", "_bt", "_bv", "_c_lt", "_c_lv", "_c_ft", "_c_fv"))


def filled_grid(known: DataFrame, freq: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, ts, value): the gap-free grid from the first to the last known value of each series, gaps filled linearly.

    What `align` and `fill_linear` give for a target alone. Each known value opens the slots up to the next one, so no slot is
    joined or sorted to be filled. Next values are looked for in time buckets, which exchange their first value only.
    """
    keys = KEYS if keys is None else keys
    step = freq_seconds(freq)
    k = known.where(F.col("value").isNotNull()).select(*keys, F.unix_seconds("ts").alias("_t"), F.col("value").alias("_v")).withColumn("_b", F.floor(F.col("_t") / (CHUNK * step)))
    inside, after = Window.partitionBy(*keys, "_b").orderBy("_t"), Window.partitionBy(*keys).orderBy("_b")
    rows = k.select("*", F.lead("_t").over(inside).alias("_nt"), F.lead("_v").over(inside).alias("_nv"))
    firsts = k.groupBy(*keys, "_b").agg(F.min("_t").alias("_ft"), F.min_by("_v", "_t").alias("_fv"))
    firsts = firsts.select(*keys, "_b", F.lead("_ft").over(after).alias("_et"), F.lead("_fv").over(after).alias("_ev"))
    j = rows.join(firsts, [*keys, "_b"]).select(*keys, "_t", "_v", F.coalesce("_nt", "_et").alias("_nt"), F.coalesce("_nv", "_ev").alias("_nv"))
    day = step * max(1, 86400 // step)
    end = F.coalesce(F.col("_nt") - step, F.col("_t"))
    d = j.withColumn("_end", end).withColumn("_d", F.explode(F.sequence(F.col("_t"), F.col("_end"), F.lit(day).cast("long"))))
    # few rows open many slots: they are dealt out first, to all tasks
    d = d.repartition(int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_d")
    s = d.withColumn("_s", F.explode(F.sequence(F.col("_d"), F.least(F.col("_end"), F.col("_d") + F.lit(day - step)), F.lit(step).cast("long"))))
    line = F.col("_v") + (F.col("_nv") - F.col("_v")) * ((F.col("_s") - F.col("_t")) / (F.col("_nt") - F.col("_t")))
    return s.select(*keys, F.timestamp_seconds("_s").alias("ts"), F.when(F.col("_s") == F.col("_t"), F.col("_v")).otherwise(line).alias("value"))


@dataclass(frozen=True)
class MarketClock:
    """Settlement intervals of one market in its own zone."""

    market: str
    tz: str = "UTC"
    minutes: int = 60

    def __post_init__(self):
        if self.minutes <= 0 or 1440 % self.minutes:
            raise ValueError("the interval must divide a day")

    @property
    def seconds(self) -> int:
        return self.minutes * 60

    @property
    def freq(self) -> str:
        return f"{self.minutes}min"

    def floor(self, c) -> Column:
        return floor_ts(c, self.seconds, self.tz)

    def ceil(self, c) -> Column:
        return ceil_ts(c, self.seconds, self.tz)

    def next(self, c, n: int = 1) -> Column:
        return shift_ts(c, self.seconds * n)

    def grid(self, df: DataFrame, start: str, end: str) -> DataFrame:
        """Interval starts in the half-open [start, end), one row each, as `ts`."""
        b = (df.withColumn("_a", self.ceil(start)).withColumn("_z", shift_ts(self.ceil(end), -self.seconds))
             .where(F.col("_a") <= F.col("_z")))
        return grid(b, self.freq, "_a", "_z").drop("_a", "_z", "i")


@dataclass(frozen=True)
class Segment:
    """A named part of the time axis: listed hours, listed months, or a closed time range."""

    segment_id: str
    kind: str
    hours: tuple[int, ...] = ()
    months: tuple[int, ...] = ()
    start: str | None = None
    end: str | None = None

    def mask(self, ts: str = "ts", tz: str = "UTC") -> Column:
        from ..functions.columns import to_local
        if self.kind == "hours":
            return F.hour(to_local(ts, tz)).isin(*self.hours)
        if self.kind == "months":
            return F.month(to_local(ts, tz)).isin(*self.months)
        if self.kind == "time_range":
            return F.col(ts).between(F.lit(self.start).cast("timestamp"), F.lit(self.end).cast("timestamp"))
        raise ValueError(f"unknown segment kind: {self.kind}")


def segment_filter(df: DataFrame, segment: Segment, tz: str = "UTC") -> DataFrame:
    return df.where(segment.mask(tz=tz))


def explode_segments(df: DataFrame, segments: list[Segment], tz: str = "UTC") -> DataFrame:
    """One copy of a row per segment that holds it: adds segment_id, kind, ord."""
    items = [F.when(s.mask(tz=tz), F.struct(F.lit(s.segment_id).alias("segment_id"), F.lit(s.kind).alias("kind"),
                                            F.lit(o).cast("long").alias("ord"))) for o, s in enumerate(segments)]
    return df.withColumn("_s", F.explode(F.array_compact(F.array(*items)))).select(
        *df.columns, "_s.segment_id", "_s.kind", "_s.ord")
