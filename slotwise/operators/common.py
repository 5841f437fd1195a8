"""Building blocks that keep every window and quantile distributed.

No helper here opens a window over a whole series: long series are cut into
chunks of consecutive slots, and what crosses a chunk edge travels either as a
halo of copied rows or as one summary row per chunk.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = 8192
RANK_BUCKETS = 65536
RANK_ROWS = 100_000      # distinct values of a range that one task orders
QUANTILE_RANGES = 256    # ranges a key in which `quantiles` counts values before it ranks any


def with_halo(df: DataFrame, keys: list[str], back: int = 0, ahead: int = 0,
              order: str = "i", chunk: int | None = None) -> DataFrame:
    """Copy the rows near a chunk edge into the neighbouring chunk.

    Adds `_c` (chunk) and `_own` (false on copies). A window over
    `(keys, _c)` ordered by `order` then sees `back` rows before and `ahead`
    rows after every owned row. `order` must be a dense integer position.
    """
    size = max(chunk or CHUNK, back, ahead, 1)
    home = F.floor(F.col(order) / size)
    off = F.col(order) - home * size
    # whole arrays by case: `array_compact` would run a lambda for every row
    copies = F.array(home)
    if back:
        copies = F.when(off >= size - back, F.array(home, home + 1)).otherwise(copies)
    if ahead:
        copies = F.when(off < ahead, F.array(home, home - 1)).otherwise(copies)
    if back and ahead and size - back < ahead:
        copies = F.when((off >= size - back) & (off < ahead), F.array(home, home + 1, home - 1)).otherwise(copies)
    return (df.withColumn("_home", home)
              .withColumn("_c", F.explode(copies))
              .withColumn("_own", F.col("_c") == F.col("_home")).drop("_home"))


def halo_window(keys: list[str], order: str = "i"):
    return Window.partitionBy(*keys, "_c").orderBy(order)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_c", "_own")


def with_lags(df: DataFrame, keys: list[str], cols: list[str], lags: list[int],
              order: str = "i", chunk: int | None = None) -> DataFrame:
    """Add `<col>_lag<k>`: the value k grid slots earlier. One shuffle for all lags."""
    h = with_halo(df, keys, back=max(lags), order=order, chunk=chunk)
    w = halo_window(keys, order)
    h = h.select("*", *[F.lag(c, k).over(w).alias(f"{c}_lag{k}") for c in cols for k in lags])
    return drop_halo(h)


def lag_table(df: DataFrame, keys: list[str], col: str, max_lag: int, order: str = "i",
              chunk: int | None = None, first: int = 0) -> DataFrame:
    """One row per (row, lag) for lag = first..max_lag with `lagged`; slots before the start are absent."""
    h = with_halo(df, keys, back=max_lag, order=order, chunk=chunk)
    w = halo_window(keys, order).rowsBetween(-max_lag, -first)
    h = drop_halo(h.withColumn("_past", F.collect_list(F.struct(F.col(col).alias("v"))).over(w)))
    return (h.select("*", F.posexplode(F.reverse("_past")).alias("_k", "_p"))
             .withColumn("lag", (F.col("_k") + first).cast("long"))
             .withColumn("lagged", F.col("_p.v")).drop("_past", "_k", "_p"))


def lag_moments(df: DataFrame, keys: list[str], x: str, y: str, max_lag: int, order: str = "i", chunk: int | None = None) -> DataFrame:
    """Moments of x[t - lag] with y[t] over complete pairs, for lag = 0..max_lag, one row per key and lag.

    Columns: rows (slots with a slot `lag` before them), n, low and high of both sides, and sums sx, sy, sxx, syy, sxy about
    the key's means mx and my. A task handles all lags of a chunk and its halo at once; only sums are shuffled.
    """
    means = df.groupBy(*keys).agg(F.coalesce(F.avg(x), F.lit(0.0)).alias("mx"), F.coalesce(F.avg(y), F.lit(0.0)).alias("my"), F.min(order).alias("_first"))
    h = with_halo(df.select(*keys, order, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")), keys, back=max_lag, order=order, chunk=chunk)
    h = h.join(means, keys)
    sums = ["rows", "n", "sx", "sy", "sxx", "syy", "sxy"]

    def moments(key, pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[order].to_numpy()
        own = pdf["_own"].to_numpy()
        if not own.any():
            return pd.DataFrame(columns=[*keys, "lag", *sums, "x0", "x1", "y0", "y1"])
        lo, size = at[own].min(), at[own].max() - at[own].min() + 1
        xs, ys = np.full(size + max_lag, np.nan), np.full(size, np.nan)
        there = np.zeros(size, bool)
        near = at >= lo - max_lag
        xs[at[near] - lo + max_lag] = pdf["_x"].to_numpy()[near] - pdf["mx"].iloc[0]
        ys[at[own] - lo], there[at[own] - lo] = pdf["_y"].to_numpy()[own] - pdf["my"].iloc[0], True
        w = np.lib.stride_tricks.sliding_window_view(xs, max_lag + 1)[:, ::-1]       # row t, column lag
        vx, vy = ~np.isnan(w), ~np.isnan(ys)
        x0, y0 = np.where(vx, w, 0.0), np.where(vy, ys, 0.0)
        both, v = vx & vy[:, None], vy.astype(float)
        yy = np.broadcast_to(y0[:, None], both.shape)
        low = lambda a, fill, f: f(np.where(both, a, fill), axis=0)
        since = lo + np.arange(size) - pdf["_first"].iloc[0]
        out = {"lag": np.arange(max_lag + 1), "rows": (there[:, None] & (since[:, None] >= np.arange(max_lag + 1))).sum(axis=0), "n": both.sum(axis=0), "sx": x0.T @ v, "sy": vx.T.astype(float) @ y0,
               "sxx": (x0 * x0).T @ v, "syy": vx.T.astype(float) @ (y0 * y0), "sxy": x0.T @ y0,
               "x0": low(w, np.inf, np.min), "x1": low(w, -np.inf, np.max), "y0": low(yy, np.inf, np.min), "y1": low(yy, -np.inf, np.max)}
        return pd.DataFrame({**dict(zip(keys, key)), **out})
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)
    schema = f"{kinds}, lag long, rows long, n long, sx double, sy double, sxx double, syy double, sxy double, x0 double, x1 double, y0 double, y1 double"
    parts = h.groupBy(*keys, "_c").applyInPandas(lambda key, pdf: moments(key[:-1], pdf), schema)
    agg = parts.groupBy(*keys, "lag").agg(*[F.sum(c).alias(c) for c in sums], F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    return agg.where("rows > 0").join(means.drop("_first"), keys)


def moment_corr() -> Column:
    """Correlation from the columns of `lag_moments`; NULL for a constant side."""
    n = F.col("n")
    part = lambda a, b, c: F.col(a) - F.col(b) * F.col(c) / n
    r = part("sxy", "sx", "sy") / F.sqrt(part("sxx", "sx", "sx") * part("syy", "sy", "sy"))
    return F.when((n > 1) & (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def prefix_sums(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column],
                chunk: int | None = None, span: int = 1) -> DataFrame:
    """Inclusive running sums along `order` without a whole-series window.

    `order` is an integer position; a chunk covers `chunk * span` of its units.
    """
    size = (chunk or CHUNK) * span
    base = df.select("*", F.floor(F.col(order) / size).alias("_c"),
                     *[e.alias(f"_in_{n}") for n, e in sums.items()])
    inside = Window.partitionBy(*keys, "_c").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = base.select("*", *[F.sum(f"_in_{n}").over(inside).alias(f"_run_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carry = (base.groupBy(*keys, "_c").agg(*[F.sum(f"_in_{n}").alias(f"_t_{n}") for n in sums])
                 .select(*keys, "_c", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}")
                                        for n in sums]))
    out = rows.join(carry.hint("merge"), [*keys, "_c"])      # rows are sorted so; by estimates from before a grid was opened they would be broadcast
    for n in sums:
        out = out.withColumn(n, F.coalesce(F.col(f"_run_{n}"), F.lit(0)) + F.col(f"_b_{n}"))
    return out.drop("_c", *[f"{p}{n}" for n in sums for p in ("_in_", "_run_", "_b_")])


def value_counts(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    return (df.where(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias("_v"))
              .agg(F.count(F.lit(1)).alias("_cnt")))


def _log(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def _place(v, lo, hi, n) -> Column:
    """Which of `n` even cuts between `lo` and `hi` holds `v`."""
    return F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * n), n - 1)).otherwise(F.lit(0)).cast("long")


def ranked_values(df: DataFrame, keys: list[str], col: str, rows: int = RANK_ROWS) -> DataFrame:
    """Distinct values per key with count `_cnt`, rows below `_before`, total `_n`.

    Equal values are counted before anything is ordered. Values are then dealt into ranges in two levels: an even cut of
    the signed log between the key's exact extremes, and, inside ranges of more than `rows` distinct values, an even cut
    between the exact extremes of the range. Only totals of ranges are summed in order per key, so values crowded far
    from their key's extremes still spread over the tasks.
    """
    vc = value_counts(df, keys, col).withColumn("_u", _log(F.col("_v").cast("double")))
    ext = vc.groupBy(*keys).agg(F.min("_u").alias("_lo"), F.max("_u").alias("_hi"), F.sum("_cnt").alias("_n"))
    on = keys or ["_one"]
    if not keys:
        vc, ext = vc.withColumn("_one", F.lit(1)), ext.withColumn("_one", F.lit(1))
    b = vc.join(ext, on).withColumn("_b", _place(F.col("_u"), F.col("_lo"), F.col("_hi"), F.lit(RANK_BUCKETS)))
    v = F.col("_v").cast("double")
    crowd = b.groupBy(*on, "_b").agg(F.min(v).alias("_vl"), F.max(v).alias("_vh"), F.ceil(F.count(F.lit(1)) / rows).alias("_parts")).where("_parts > 1")
    b = b.join(crowd, [*on, "_b"], "left").withColumn("_s", F.coalesce(_place(v, F.col("_vl"), F.col("_vh"), F.col("_parts")), F.lit(0)))
    inside = Window.partitionBy(*on, "_b", "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    rows_ = b.repartition(*on, "_b", "_s").withColumn("_in", F.coalesce(F.sum("_cnt").over(inside), F.lit(0)))
    before = Window.partitionBy(*on).orderBy("_b", "_s").rowsBetween(Window.unboundedPreceding, -1)
    base = (b.groupBy(*on, "_b", "_s").agg(F.sum("_cnt").alias("_t"))
             .select(*on, "_b", "_s", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base")))
    return (rows_.join(base.hint("merge"), [*on, "_b", "_s"])
                 .select(*keys, "_v", "_cnt", (F.col("_base") + F.col("_in")).alias("_before"), "_n"))


def _small_quantiles(df: DataFrame, keys: list[str], col: str, probs: dict[str, float]) -> DataFrame:
    """`quantiles` of keys of at most RANK_ROWS rows: one sort."""
    key = Window.partitionBy(*keys)
    x = df.where(F.col(col).isNotNull()).select(*keys, F.col(col).alias("_v"))
    n = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    x = x.withColumn("_k", F.row_number().over(key.orderBy("_v")) - 1).join(n, keys)
    pos = {name: F.lit(float(p)) * (F.col("n") - 1) for name, p in probs.items()}
    at = lambda k: F.max(F.when(F.col("_k") == k, F.col("_v")))
    agg = x.groupBy(*keys).agg(F.max("n").alias("n"), *[at(f(p)).alias(f"_{side}_{name}") for name, p in pos.items() for side, f in (("lo", F.floor), ("hi", F.ceil))])
    line = lambda name: F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (pos[name] - F.floor(pos[name]))
    return agg.select(*keys, "n", *[line(name).alias(name) for name in probs])


def quantiles(df: DataFrame, keys: list[str], col: str, probs: dict[str, float], twice: bool = False) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per name in `probs`, plus `n`.

    Values are counted in a few ranges per key, an even cut of the signed log between the key's exact extremes. Only values
    in a range that holds an asked position are ranked. `twice` says that `df` is a table, which may be read once more to count
    rows: if no key has more than a task orders at once (`RANK_ROWS`), each is put in order whole instead.
    """
    if twice and keys and (df.where(F.col(col).isNotNull()).groupBy(*keys).count().agg(F.max("count")).head()[0] or 0) <= RANK_ROWS:
        return _small_quantiles(df, keys, col, probs)
    u = _log(F.col("_v").cast("double"))
    on = keys or ["_one"]
    x = df.where(F.col(col).isNotNull()).select(*([F.lit(1).alias("_one")] if not keys else keys), F.col(col).alias("_v"))
    ext = x.groupBy(*on).agg(F.min(u).alias("_lo"), F.max(u).alias("_hi"))
    b = x.join(ext, on).select(*on, "_v", _place(u, F.col("_lo"), F.col("_hi"), F.lit(QUANTILE_RANGES)).alias("_g"))
    before = Window.partitionBy(*on).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)       # at most QUANTILE_RANGES rows a key
    ranges = (b.groupBy(*on, "_g").agg(F.count(F.lit(1)).alias("_t"))
               .select("*", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"), F.sum("_t").over(Window.partitionBy(*on)).alias("n")))
    ends = {}
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("n") - 1)
        ends |= {f"_lo_{name}": F.floor(pos), f"_hi_{name}": F.ceil(pos)}
    held = lambda first, count, at: (F.col(first) <= at) & (at < F.col(first) + F.col(count))
    asked = ranges.where(reduce(or_, [held("_base", "_t", at) for at in ends.values()])).select(*on, "_g", "_base", "n")
    near = ranked_values(b.join(asked.select(*on, "_g"), [*on, "_g"], "left_semi"), [*on, "_g"], "_v").drop("_n").join(asked, [*on, "_g"])
    near = near.withColumn("_before", F.col("_before") + F.col("_base"))
    agg = near.groupBy(*on).agg(F.max("n").alias("n"), *[F.max(F.when(held("_before", "_cnt", at), F.col("_v"))).alias(c) for c, at in ends.items()])
    out = [*keys, "n"]
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return agg.select(*out)


def average_ranks(df: DataFrame, keys: list[str], col: str, name: str) -> DataFrame:
    """Add the 1-based average rank of `col` within `keys`."""
    rv = ranked_values(df, keys, col).select(
        *keys, F.col("_v").alias(col), (F.col("_before") + (F.col("_cnt") + 1) / 2).alias(name))
    return df.join(rv, [*keys, col])


def gram(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """Sum of outer products of an array column per key: rows (keys, k, g array<double> of k*k).

    Each task adds up its own rows with numpy; only k*k partial sums per key
    and task are shuffled.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)

    def partial(batches):
        for pdf in batches:
            parts = []
            for key, g in pdf.groupby(keys, sort=False, dropna=False):
                x = np.stack(g[vec].to_numpy()).astype(float)
                parts.append((*key, x.shape[1], (x.T @ x).ravel()))
            yield pd.DataFrame(parts, columns=[*keys, "k", "g"])

    parts = df.select(*keys, vec).mapInPandas(partial, f"{schema}, k int, g array<double>")
    return (parts.select(*keys, "k", F.posexplode("g").alias("_p", "_x"))
                 .groupBy(*keys, "k", "_p").agg(F.sum("_x").alias("_x"))
                 .groupBy(*keys, "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_x"))),
                                                      lambda s: s["_x"]).alias("g")))


SPAN_BASE = 32           # buckets of one level of `span_buckets` that make a bucket of the next
SPAN_LEVELS = 5          # 32 ** 5 days are longer than all dates


def span_buckets(first: Column, last: Column) -> Column:
    """Array of (level, bucket) that cover the whole numbers first..last once: at most 2 * SPAN_BASE a level.

    Level l holds runs of SPAN_BASE ** l numbers; a long span is long runs inside and short ones at its ends.
    """
    parts, a, b, open_ = [], first, last, F.lit(True)
    for level in range(SPAN_LEVELS):
        up_a, up_b = F.ceil(a / SPAN_BASE), F.floor((b + 1) / SPAN_BASE) - 1
        goes_up = (up_a <= up_b) & F.lit(level < SPAN_LEVELS - 1)
        run = lambda lo, hi, ok: F.when(open_ & ok & (lo <= hi), F.transform(F.sequence(lo, hi), lambda x: F.struct(F.lit(level).alias("level"), x.cast("long").alias("bucket"))))
        parts += [run(a, b, ~goes_up), run(a, up_a * SPAN_BASE - 1, goes_up), run((up_b + 1) * SPAN_BASE, b, goes_up)]
        open_, a, b = open_ & goes_up, up_a, up_b
    return F.flatten(F.array_compact(F.array(*parts)))


def point_buckets(at: Column) -> Column:
    """Array of the (level, bucket) that hold a whole number."""
    return F.array(*[F.struct(F.lit(level).alias("level"), F.floor(at / SPAN_BASE ** level).alias("bucket")) for level in range(SPAN_LEVELS)])


def overlap_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str,
                 closed_end: bool = False, bucket_seconds: int = 86400) -> DataFrame:
    """Join each point to the spans of its key that hold it.

    Spans are copied into the time buckets that cover them and joined by equality on (keys, level, bucket). Buckets come in
    levels, so a span of any length has a bounded number of copies; a span holds a point in one of them, so no pair
    appears twice.
    """
    def bucket(c):
        return F.floor(F.unix_seconds(F.col(c)) / bucket_seconds)
    p = points.withColumn("_bk", F.explode(point_buckets(bucket(at))))
    s = spans.where(F.col(start) <= F.col(end)).withColumn("_bk", F.explode(span_buckets(bucket(start), bucket(end))))
    s = s.select(*[F.col(c).alias(f"_s_{c}") for c in s.columns])
    cond = (F.col("_bk.level") == F.col("_s__bk.level")) & (F.col("_bk.bucket") == F.col("_s__bk.bucket"))
    for k in keys:
        cond &= F.col(k) == F.col(f"_s_{k}")
    upper = F.col(at) <= F.col(f"_s_{end}") if closed_end else F.col(at) < F.col(f"_s_{end}")
    cond &= (F.col(at) >= F.col(f"_s_{start}")) & upper
    return p.join(s, cond).select(*points.columns, *[F.col(f"_s_{c}").alias(c) for c in spans.columns if c not in keys])


def over_holding(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, value: str, fn) -> DataFrame:
    """(keys, at, value): an aggregate (such as F.max) of `value` over the spans of whole numbers that hold each point.

    Spans leave their value in the buckets that cover them, points look up the buckets they lie in, so a span costs a
    bounded number of rows however many points it holds. Points without a span are absent.
    """
    node = lambda: [F.col("_n.level").alias("_level"), F.col("_n.bucket").alias("_bucket")]
    s = spans.where(F.col(start) <= F.col(end)).withColumn("_n", F.explode(span_buckets(F.col(start), F.col(end)))).select(*keys, *node(), value)
    s = s.groupBy(*keys, "_level", "_bucket").agg(fn(value).alias(value))
    p = points.select(*keys, at).distinct().withColumn("_n", F.explode(point_buckets(F.col(at)))).select(*keys, at, *node())
    return p.join(s, [*keys, "_level", "_bucket"]).groupBy(*keys, at).agg(fn(value).alias(value))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key: largest `order` struct wins. Combined map-side, never sorted."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def top_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key; Spark cuts each task to k rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= k)


def running(df: DataFrame, keys: list[str], at: str, tie: list[str], last: list[str] = (), max_before: dict[str, str] | None = None,
            bucket_seconds: int = 30 * 86400) -> DataFrame:
    """Running last known value (inclusive) and running maximum of earlier rows, scanned in time buckets.

    `last` columns are replaced by their newest non-NULL value up to the row; `max_before` adds name -> maximum
    of a column over strictly earlier rows. Buckets exchange one summary row each, so no key is scanned whole.
    """
    mb = max_before or {}
    base = df.withColumn("_b", F.floor(F.unix_seconds(at) / bucket_seconds))
    order = F.struct(at, *tie)
    w = Window.partitionBy(*keys, "_b").orderBy(at, *tie)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    rows = base.select("*", *[F.last(c, True).over(upto).alias(f"_l_{c}") for c in last], *[F.max(c).over(before).alias(f"_m_{n}") for n, c in mb.items()])
    ends = base.groupBy(*keys, "_b").agg(F.lit(1).alias("_one"), *[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"_e_{c}") for c in last], *[F.max(c).alias(f"_x_{n}") for n, c in mb.items()])
    cw = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "_b", *[F.last(f"_e_{c}", True).over(cw).alias(f"_c_{c}") for c in last], *[F.max(f"_x_{n}").over(cw).alias(f"_y_{n}") for n in mb])
    j = rows.join(ends, [*keys, "_b"])
    keep = [c for c in df.columns if c not in last]
    return j.select(*keep, *[F.coalesce(f"_l_{c}", f"_c_{c}").alias(c) for c in last], *[F.greatest(f"_m_{n}", f"_y_{n}").alias(n) for n in mb])


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, cols: list[str], tie: list[str]) -> DataFrame:
    """Each left row with the newest right row of its key whose `right_at` is not after `at` (NULLs when there is none).

    Both sides are put on one time line and scanned once, so the cost is linear and no pairs are built.
    """
    row = F.struct(*[F.col(c) for c in cols]).alias("_r")
    r = right.select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.struct(*tie).alias("_tie"), row)
    l = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))
    u = r.unionByName(l, allowMissingColumns=True)
    s = running(u, keys, "_at", ["_side", "_tie"], last=["_r"]).where(F.col("_side") == 1)
    return s.select("_left.*", *[F.col(f"_r.{c}").alias(c) for c in cols])


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in spark.checkpoint.dir; make one only for a local master without it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Write a frame that several later steps read to the checkpoint folder and go on from there.

    The plan behind it ends here, so later steps neither repeat its work nor carry its plan, and a lost
    executor costs a re-read.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """`cut` for wide frames of many rows: a Parquet table beside the checkpoints, of which a step reads the columns it needs."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
