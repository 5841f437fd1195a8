"""Dataset fingerprints and frozen copies addressed by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def row_text(df: DataFrame, columns: list[str] | None = None):
    cols = sorted(columns or df.columns)
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols]), {"ignoreNullFields": "false"})


def fingerprint(df: DataFrame, keys: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Order-insensitive content hash per key: row count, xor and wrapped sum of 64-bit row hashes, digested.

    Every task folds its rows into three numbers, so nothing is sorted or collected.
    """
    keys = keys or []
    cols = sorted(c for c in (columns or df.columns) if c not in keys)
    h = F.xxhash64(row_text(df, cols))
    a = df.select(*keys, h.alias("_h")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor("_h").alias("_x"), F.sum(F.shiftright("_h", 32)).alias("_s"), F.sum(F.col("_h").bitwiseAND(0xFFFFFFFF)).alias("_l"))
    body = F.concat_ws("|", F.lit(",".join(cols)), F.col("rows").cast("string"), F.col("_x").cast("string"), F.col("_s").cast("string"), F.col("_l").cast("string"))
    return a.select(*keys, "rows", F.sha2(body, 256).alias("fingerprint"))


def verify_fingerprints(stored: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    """Stored against recomputed fingerprint per key; a missing side counts as changed."""
    now = fingerprint(df, keys).select(*keys, F.col("fingerprint").alias("actual"))
    return stored.select(*keys, F.col("fingerprint").alias("expected")).join(now, keys, "full").withColumn(
        "intact", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def freeze(df: DataFrame, root: str, fp: str, partition_by: list[str] | None = None) -> str:
    """Write a dataset once under its fingerprint. A copy that finished (it has a manifest) is left alone."""
    spark = df.sparkSession
    fs, path = _fs(spark, root)
    target = f"{root}/{fp}"
    if fs.exists(path(f"{target}/manifest/_SUCCESS")):
        return target
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{target}/data")
    spark.range(1).select(F.lit(fp).alias("fingerprint"), F.lit(",".join(df.columns)).alias("columns"), F.current_timestamp().alias("frozen_at")).coalesce(1).write.mode(
        "overwrite").parquet(f"{target}/manifest")
    return target


def restore(spark: SparkSession, root: str, fp: str) -> DataFrame:
    """Read a frozen copy back; its columns must be the manifest's."""
    m = spark.read.parquet(f"{root}/{fp}/manifest").head()
    df = spark.read.parquet(f"{root}/{fp}/data")
    cols = m["columns"].split(",")
    if m["fingerprint"] != fp or sorted(cols) != sorted(df.columns):
        raise ValueError(f"frozen copy {fp} does not match its manifest")
    return df.select(*cols)


def prune(spark: SparkSession, root: str, keep: int = 8) -> list[str]:
    """Delete all but the newest `keep` frozen copies; returns what was deleted."""
    fs, path = _fs(spark, root)
    dirs = [s for s in fs.listStatus(path(root)) if s.isDirectory()]
    dirs.sort(key=lambda s: (s.getModificationTime(), s.getPath().getName()), reverse=True)
    gone = []
    for s in dirs[keep:]:
        fs.delete(s.getPath(), True)
        gone.append(s.getPath().getName())
    return gone
