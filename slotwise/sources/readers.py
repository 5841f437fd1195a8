"""Readers and writers: series files, article lines, result tables, and schema inference."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import count_if, r6, to_utc
from ..operators.align import KEYS


@dataclass(frozen=True)
class SeriesSpec:
    """Where one series lives and how its columns are named."""

    name: str
    path: str
    timestamp_column: str
    value_column: str
    series_id: str = "default"
    tz: str = "UTC"
    aggregation: str = "mean"
    available_at_column: str | None = None
    availability_type: str = "unknown"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Format from the suffix. CSV columns stay strings; coercion is a counted step of its own."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix == ".csv":
        return spark.read.csv(path, header=True)
    if suffix in (".parquet", ".pq"):
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file format: {path}")


def require_columns(df: DataFrame, columns: list[str], what: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {', '.join(missing)}")


def normalize_ts(col: Column | str, tz: str) -> Column:
    """Timestamp text or column to an instant.

    A value with its own offset keeps it. A local value is read in `tz`; a wall
    time that does not exist or exists twice there becomes NULL.
    """
    c = F.col(col) if isinstance(col, str) else col
    text = F.trim(c.cast("string"))
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & text.rlike(r":\d{2}")
    return F.when(zoned, F.try_to_timestamp(text)).otherwise(local_instant(text.try_cast("timestamp_ntz"), tz))


def local_instant(wall: Column, tz: str) -> Column:
    """Instant of a zone-free wall time in `tz`; NULL in a clock-change gap or overlap."""
    if tz == "UTC":
        return wall.cast("timestamp")
    w = wall.cast("timestamp")                     # wall digits held as UTC
    u = to_utc(w, tz)
    back = lambda x: F.from_utc_timestamp(x, tz)
    twice = F.lit(False)
    for m in (30, 60):
        for s in (-m, m):
            twice = twice | (back(F.timestamp_micros(F.unix_micros(u) + s * 60_000_000)) == w)
    return F.when((back(u) == w) & ~twice, u)


def load_series(raw: DataFrame, spec: SeriesSpec, extra: list[str] | None = None) -> DataFrame:
    """Rows (series_id, name, ts, value[, available_at], bad_ts, bad_value) with coercion evidence per row."""
    need = [spec.timestamp_column, spec.value_column, *([spec.available_at_column] if spec.available_at_column else [])]
    require_columns(raw, need, spec.name)
    ts = normalize_ts(spec.timestamp_column, spec.tz)
    v = F.col(spec.value_column).try_cast("double")
    v = F.when(~F.isnan(v), v)
    cols = [F.lit(spec.series_id).alias("series_id"), F.lit(spec.name).alias("name"), ts.alias("ts"), v.alias("value")]
    if spec.available_at_column:
        cols.append(normalize_ts(spec.available_at_column, spec.tz).alias("available_at"))
    return raw.select(*cols, ts.isNull().alias("bad_ts"), (F.col(spec.value_column).isNotNull() & v.isNull()).alias("bad_value"),
                      *[F.col(c) for c in (extra or [])])


def read_series(spark: SparkSession, spec: SeriesSpec) -> DataFrame:
    return load_series(read_table(spark, spec.path), spec)


def load_evidence(loaded: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Raw, invalid, non-numeric and duplicate row counts per series."""
    keys = KEYS if keys is None else keys
    per_ts = loaded.where(~F.col("bad_ts")).groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("_k"), F.count("value").alias("_v"))
    dup = per_ts.groupBy(*keys).agg(
        F.sum("_k").alias("valid_timestamp_rows"), F.sum("_v").alias("valid_value_rows"),
        F.sum(F.when(F.col("_k") > 1, F.col("_k")).otherwise(0)).alias("duplicate_timestamp_rows"),
        count_if(F.col("_k") > 1).alias("duplicate_timestamp_keys"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    raw = loaded.groupBy(*keys).agg(F.count(F.lit(1)).alias("raw_rows"), count_if(F.col("bad_ts")).alias("invalid_timestamp_rows"),
                                    count_if(F.col("bad_value")).alias("non_numeric_rows"))
    return raw.join(dup, keys, "left")


# Names that mark a column's role, in order of preference.
TIME_NAMES = ("datetime", "timestamp", "time", "date", "日期", "时间")
AVAILABLE_NAMES = ("available_at", "availability_time", "published_at", "publication_time", "issued_at", "issue_time", "forecast_created_at")
TARGET_NAMES = ("rt_node_price_2b", "rt_price", "real_time_price", "price", "电价")


def column_profile(df: DataFrame) -> DataFrame:
    """Share of non-null values per column that parse as a time and as a number, in one pass."""
    aggs = []
    for j, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        numeric = isinstance(f.dataType, T.NumericType)
        timeish = isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
        text = c.cast("string")
        as_num = F.lit(1.0) if numeric else F.lit(0.0) if timeish else F.avg(F.when(c.isNotNull(), text.try_cast("double").isNotNull().cast("double")))
        as_time = F.lit(1.0) if timeish else F.lit(0.0) if numeric else F.avg(F.when(c.isNotNull(), text.try_cast("timestamp").isNotNull().cast("double")))
        aggs += [F.count(c).alias(f"n{j}"), as_num.alias(f"v{j}"), as_time.alias(f"t{j}")]
    rows = F.array(*[F.struct(F.lit(j).cast("long").alias("position"), F.lit(f.name).alias("column"), F.col(f"n{j}").alias("values"),
                              r6(f"v{j}").alias("numeric_share"), r6(f"t{j}").alias("time_share")) for j, f in enumerate(df.schema.fields)])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def infer_roles(profile: DataFrame) -> DataFrame:
    """Role of each column: timestamp, available_at, target, numeric or other.

    One row per column, so the window here is as small as the schema.
    """
    low = F.lower("column")
    by_name = lambda names: F.coalesce(*[F.when(low == n, F.lit(j)) for j, n in enumerate(names)])
    whole = Window.partitionBy(F.lit(1))
    p = profile.withColumn("_t", F.coalesce(by_name(TIME_NAMES), F.when((F.col("values") > 0) & (F.col("time_share") >= 0.9), F.lit(100) + F.col("position"))))
    p = p.withColumn("_is_t", F.coalesce(F.col("_t") == F.min("_t").over(whole), F.lit(False)))
    p = p.withColumn("_a", F.when(~F.col("_is_t"), by_name(AVAILABLE_NAMES)))
    p = p.withColumn("_is_a", F.coalesce(F.col("_a") == F.min("_a").over(whole), F.lit(False)))
    p = p.withColumn("_num", ~F.col("_is_t") & ~F.col("_is_a") & (F.col("numeric_share") >= 0.9))
    price = low.contains("price") | low.contains("电价")
    p = p.withColumn("_y", F.when(F.col("_num"), F.coalesce(by_name(TARGET_NAMES), F.when(price, F.lit(100) + F.col("position")), F.lit(10_000) + F.col("position"))))
    role = (F.when(F.col("_is_t"), "timestamp").when(F.col("_is_a"), "available_at")
             .when(F.col("_num") & (F.col("_y") == F.min("_y").over(whole)), "target").when(F.col("_num"), "numeric").otherwise("other"))
    return p.select("position", "column", "values", "numeric_share", "time_share", role.alias("role"))


ARTICLE_SCHEMA = T.StructType([
    T.StructField("source_name", T.StringType()), T.StructField("source_document_id", T.StringType()), T.StructField("source_ref", T.StringType()),
    T.StructField("version", T.LongType()), T.StructField("title", T.StringType()), T.StructField("body", T.StringType()),
    T.StructField("published_at", T.StringType()), T.StructField("collected_at", T.StringType()), T.StructField("updated_at", T.StringType()),
    T.StructField("language", T.StringType()), T.StructField("market_tags", T.ArrayType(T.StringType())),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("_bad", T.StringType())])
REQUIRED_ARTICLE_FIELDS = ("source_name", "source_document_id", "title", "body", "published_at", "collected_at")


def parse_articles(lines: DataFrame, required: tuple[str, ...] = REQUIRED_ARTICLE_FIELDS) -> DataFrame:
    """Lines (line_no, value, and file if known) to articles; `reason` is NULL on good lines, else why the line was set aside.

    A line without one of the `required` fields, or with an empty one, is set aside.
    """
    a = lines.withColumn("_j", F.from_json("value", ARTICLE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.col(f"_j.{c}"), F.lit("")) == "", F.lit(c)) for c in required]))
    reason = (F.when(F.trim("value") == "", "blank line").when(F.col("_j._bad").isNotNull() | F.col("_j").isNull(), "invalid json")
               .when(F.size(missing) > 0, F.concat(F.lit("missing fields: "), F.array_join(missing, ", "))))
    return a.select(*[c for c in ("file",) if c in lines.columns], "line_no", reason.alias("reason"), *[F.col(f"_j.{f.name}") for f in ARTICLE_SCHEMA.fields if f.name != "_bad"])


def read_articles(spark: SparkSession, path: str, required: tuple[str, ...] = REQUIRED_ARTICLE_FIELDS) -> DataFrame:
    """JSON-lines articles with `file` and their line number in it, from 1."""
    return parse_articles(numbered_lines(spark, path), required)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of text files, however they are split: lines are counted per block and blocks added up."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"))
    blocks = raw.groupBy("file", "_at").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)          # one row per block
    blocks = blocks.select("file", "_at", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return raw.join(blocks, ["file", "_at"]).select("file", (F.col("_base") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "value")


def write_result(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unsupported result format: {fmt}")
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))
