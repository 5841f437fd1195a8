"""Importance resampling towards a target distribution, with exact ranks by parallel sorting by regular sampling.

Hashed word counts of all documents and of the target texts give every bucket a gain; a document's weight is the sum of
the gains of its words, read from an array, and Gumbel noise fixed by its id turns the highest scores into a draw without
replacement. Ranks: each task sorts its run, regular samples of the runs give splitters, every row finds its segment,
counts of segments give the rank before each, and only segments that reach into the draw are exchanged and merged.

Defined results: a null or empty text has no features and weight 0; a row without doc_id takes its noise from an empty id
and comes last among equal scores; rows that repeat score and doc_id are ordered by n_features; repeated rows are ranked
one after the other; an empty target gives gains from the documents alone; an empty table gives no rows; other columns
are never read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import extend, slices
from .store import keep, table

BUCKETS = 10_000
MAX_RUN = 1              # longest run of words that is a feature
SEED = 2024
MIN_WORDS, PERCENT = 20, 10
SEGMENT_ROWS, MAX_SEGMENTS = 1_000_000, 20_000    # rows aimed at in a segment, and most segments
MIN_SEGMENTS = 512
SAMPLES, MIN_SAMPLES = 32, 4                      # regular samples of all runs for a segment, and least of one run
CACHE = 50_000           # words a task remembers
ORDER = ("neg", "no_id", "doc_id", "n_features", "row")
#: A-Z to a-z; bytes that end a word to a space.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Buckets(dict):
    """word bytes -> bucket, computed when first met."""

    def __missing__(self, word):
        if len(self) >= CACHE:
            self.clear()
        self[word] = b = zlib.crc32(word) % BUCKETS
        return b

    def of(self, text: str | None, max_run: int = MAX_RUN) -> tuple[int, np.ndarray]:
        """(words, bucket of every feature) of a whole text."""
        words = text.encode("utf-8", "surrogatepass").translate(TO_WORDS).split() if text else []
        out = [np.fromiter(map(self.__getitem__, words), np.int64, len(words))]
        for n in range(2, max_run + 1):
            runs = list(map(b" ".join, zip(*(words[i:] for i in range(n)))))
            out.append(np.fromiter((zlib.crc32(r) % BUCKETS for r in runs), np.int64, len(runs)))
        return len(words), np.concatenate(out)


def bucket_counts(texts: DataFrame, max_run: int = MAX_RUN) -> np.ndarray:
    """Features of all texts by bucket: BUCKETS numbers, added up in the tasks and then in Spark."""
    def run(batches):
        known, total = Buckets(), np.zeros(BUCKETS, np.int64)
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                total += np.bincount(known.of(text, max_run)[1], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])
    out = np.zeros(BUCKETS, np.int64)
    for b, n in texts.where(F.col("text").isNotNull()).select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[b] = n
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of every bucket in thousandths, rounded down."""
    S, T = float(documents.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (S + BUCKETS) / ((s + 1.0) * (T + BUCKETS)))) for s, t in zip(documents.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None) -> int:
    """Gumbel noise of a document in thousandths, fixed by its id."""
    h = int(hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, target: DataFrame, max_run: int = MAX_RUN) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document row."""
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs, max_run), bucket_counts(target, max_run)))

    def make():
        known, of_bucket = Buckets(), gain.value

        def one(doc_id, text):
            n, buckets = known.of(text, max_run)
            weight = int(of_bucket[buckets].sum())
            return n, len(buckets), weight, weight + noise(doc_id)
        return one
    return extend(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, ["doc_id", "text"], "n_words long, n_features long, weight long, score long", drop=("text",))


# ---- ranks ----------------------------------------------------------------------------------------------------------

def regular_samples(runs: DataFrame, per_run: int) -> DataFrame:
    """Rows of each sorted run at a regular distance, with the rows each stands for; at most 2 * per_run of a run."""
    def run(batches):
        stride, place, picked = 1, 0, []
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ORDER)))
            first = -place % stride
            for i in range(first, len(rows), stride):
                picked.append(rows[i])
            place += len(rows)
            while len(picked) > 2 * per_run:      # half as many at twice the distance
                picked, stride = picked[::2], 2 * stride
        columns = list(zip(*picked)) or [()] * len(ORDER)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)] + [pa.array([stride] * len(picked), type=pa.int64())], names=[*ORDER, "stands_for"])
    return runs.select(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(run, "neg long, no_id int, doc_id long, n_features long, row long, stands_for long")


def place(neg, no_id, doc_id, n_features, row):
    return neg, no_id, doc_id or 0, n_features, row


def splitters(samples: list[tuple], segments: int) -> list[tuple]:
    """Places that cut the rows the samples stand for into about equal segments."""
    samples = sorted((place(*s[:-1]), s[-1]) for s in samples)
    total, seen, out = sum(n for _, n in samples), 0, []
    for at, n in samples:
        if seen >= total * (len(out) + 1) / segments:
            out.append(at)
        seen += n
    return out


def rank_drawn(rows: DataFrame, percent: int = PERCENT, segment_rows: int = SEGMENT_ROWS, min_segments: int = MIN_SEGMENTS) -> DataFrame:
    """Add `rank` to rows with score, doc_id and n_features: 1, 2, 3... by falling score for the highest `percent` of
    them, ties to the smaller doc_id, null for the others. No task sorts more than a run or a segment.
    """
    spark = rows.sparkSession
    named = rows.withColumns({"neg": -F.col("score"), "no_id": F.col("doc_id").isNull().cast("int"), "row": F.monotonically_increasing_id()})
    runs = keep(named.sortWithinPartitions(*ORDER))
    total, n_runs = runs.select(F.spark_partition_id().alias("run")).agg(F.count(F.lit(1)), F.max("run") + 1).first()
    drawn = percent * total // 100
    segments = max(min_segments, min(MAX_SEGMENTS, -(-total // segment_rows)))
    cuts = spark.sparkContext.broadcast(splitters([tuple(r) for r in regular_samples(runs, max(MIN_SAMPLES, SAMPLES * segments // (n_runs or 1))).collect()], segments))

    def find():
        own = cuts.value
        return lambda *key: (bisect_right(own, place(*key)),)
    placed = keep(extend(runs, find, list(ORDER), "segment int"))
    before, last, seen = {}, -1, 0
    for segment, n in sorted(tuple(r) for r in placed.groupBy("segment").count().collect()):      # at most MAX_SEGMENTS rows
        if seen < drawn:
            before[segment], last = seen, segment
        seen += n
    start = spark.sparkContext.broadcast(before)

    def number():
        current, rank = None, 0

        def one(segment):
            nonlocal current, rank
            if segment != current:
                current, rank = segment, start.value[segment]
            rank += 1
            return (rank if rank <= drawn else None,)
        return one
    columns = [*rows.columns, "rank"]
    merged = placed.where(F.col("segment") <= last).repartition("segment").sortWithinPartitions("segment", *ORDER)
    ranked = extend(merged, number, "segment", "rank long").select(*columns)
    return ranked.unionByName(placed.where(F.col("segment") > last).withColumn("rank", F.lit(None).cast("long")).select(*columns))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, max_run: int = MAX_RUN) -> DataFrame:
    """Per document row: doc_id, n_features, weight, score and rank in the draw; null for rows that are not drawn."""
    scored = keep(score(docs, target, max_run))
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = rank_drawn(scored.where(F.col("n_words") >= min_words).select(*columns), percent)
    return ranked.unionByName(scored.where(F.col("n_words") < min_words).select(*columns, F.lit(None).cast("long").alias("rank")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH steps AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_of),
texts AS (SELECT 'd' AS side, doc_id, row_number() OVER () AS row_no, text FROM documents UNION ALL SELECT 'b', NULL, NULL, text FROM benchmark),
lowered AS (SELECT side, doc_id, row_no, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM texts),
listed AS (SELECT side, doc_id, row_no, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM lowered),
w AS (SELECT side, row_no, unnest(words) AS word FROM listed),
h AS (SELECT word, hex(encode(word)) AS hex FROM (SELECT DISTINCT word FROM w)),
k AS (
  SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length(hex), 2), lambda i: ('0x' || hex[i + 1:i + 2])::BIGINT)), lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
  FROM h, steps),
c AS (SELECT bucket, count(*) FILTER (side = 'd')::DOUBLE AS s, count(*) FILTER (side = 'b')::DOUBLE AS t FROM w JOIN k USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM c) + 10000) / ((s + 1) * ((SELECT sum(t) FROM c) + 10000))))::BIGINT AS gain FROM c),
sums AS (SELECT row_no, sum(gain)::BIGINT AS weight FROM w JOIN k USING (word) JOIN g USING (bucket) WHERE side = 'd' GROUP BY row_no),
scored AS (
  SELECT doc_id, row_no, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256(concat('2024:', doc_id))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM listed LEFT JOIN sums USING (row_no) WHERE side = 'd'),
ranked AS (SELECT row_no, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END::BIGINT AS rank FROM scored LEFT JOIN ranked USING (row_no)
"""
