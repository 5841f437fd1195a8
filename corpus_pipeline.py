"""The training-data pipeline over `documents`: classifier, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's
docs; all but the last return the columns of documents.

Defined results: null and empty texts are judged by the classifier like a text without words; rows without doc_id go
through all stages and are duplicates of no other row; rows that share an id with different texts are judged each for
itself, rows equal in id and text are one document from the near-duplicate stage on; an empty table gives no rows; other
columns than those of documents are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm import decontamination, line_dedup, near_dup, packing, weak_labels
from slotwise.llm.store import keep, split_by_keys, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents whose key is not in `gone`; most rows need no shuffle to know."""
    possible, rest = split_by_keys(docs, key, gone)
    gone = gone.select(F.col(key).alias("_gone"))
    return possible.join(gone, F.col(key).eqNullSafe(F.col("_gone")), "left_anti").unionByName(rest)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps."""
    verdicts = weak_labels.classify(docs, with_columns=COLUMNS)
    return verdicts.where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without line chunks that an earlier document has; those with nothing left go."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))
    return out.where((F.col("_removed") == 0) | (F.trim("text") != "")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest id, the smaller text key of equal ids.

    Rows are judged by id and text: rows that share an id with different texts stay or go each for itself, rows equal in
    both are one document, of which one row stays. Rows without doc_id stay.
    """
    classes = keep(near_dup.near_duplicates(docs)[0].select("row_key", "kept"))
    keyed = docs.select(*COLUMNS, F.when(F.col("doc_id").isNotNull(), near_dup.row_key("doc_id", "text")).alias("_row"))
    gone = classes.where(~F.col("kept")).select(F.col("row_key").alias("_row")).distinct()
    kept = without(keyed, keep(gone), "_row")
    repeated = keep(classes.where("kept").groupBy(F.col("row_key").alias("_row")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_row"))
    possible, rest = split_by_keys(kept, "_row", repeated)
    once = possible.join(repeated, "_row").groupBy("_row").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")
    return possible.join(repeated, "_row", "left_anti").unionByName(rest).select(*COLUMNS).unionByName(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that copy no benchmark item; rows that share an id are judged each by its own text."""
    row = F.xxhash64("doc_id", "text")
    leaks = decontamination.find_leaks(docs.select(row.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(docs.select(*COLUMNS, row.alias("_row")), keep(leaks.select(F.col("doc_id").alias("_row")).distinct()), "_row").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents that are left."""
    return packing.pack_documents(docs)


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", decontaminate), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
