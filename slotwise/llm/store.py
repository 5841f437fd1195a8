"""Tables written between the steps of an operator, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}     # folders of local masters without the setting, by application


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local master without it gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-")
    return _OWN[app]


def keep(df: DataFrame) -> DataFrame:
    """Write a frame that several steps read and go on from the written rows: a lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FILTER_BITS = 24


def split_by_keys(df: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among `keys`, rows whose key surely is not).

    The keys set bits of a bitmap of 2 ** FILTER_BITS bits, which is a broadcast table of at most 2 ** (FILTER_BITS - 6)
    rows however many keys there are. Rows without a bit need no shuffle to meet the keys. With very many keys the bitmap
    fills up and all rows take the first way; results never depend on it.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))
    bit = F.expr("shiftleft(1L, cast(_slot & 63 AS int))")
    words = keep(keys.select(slot(column).alias("_slot")).groupBy(F.shiftright("_slot", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits")))
    marked = df.withColumn("_slot", slot(column)).withColumn("_word", F.shiftright("_slot", 6)).join(F.broadcast(words), "_word", "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    return tuple(marked.where(c).select(*df.columns) for c in (hit, ~hit))


HEAVY = 1000             # a key with more than 1 / HEAVY of all rows is heavy; there are fewer than HEAVY such keys


def with_values(df: DataFrame, values: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """Rows of `df` with the columns of `values`, a table of one row per key; left join.

    `sizes` is (key, n) with the rows of `df` by key. Heavy keys meet their rows by a broadcast of fewer than HEAVY rows, so
    that no task gets all rows of a key; the others are shuffled.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    new = [c for c in values.columns if c != key]
    heavy = keep(values.join(sizes.where(F.col("n") > total // HEAVY).select(key), key))
    marked = df.join(F.broadcast(heavy.select(key, F.struct(*new).alias("_heavy"))), key, "left")
    light = marked.where(F.col("_heavy").isNull()).select(*df.columns).join(values, key, "left").select(*df.columns, *new)
    return marked.where(F.col("_heavy").isNotNull()).select(*df.columns, *[F.col(f"_heavy.{c}").alias(c) for c in new]).unionByName(light)
