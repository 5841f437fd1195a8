"""Importance resampling against one sort of all rows."""

import random

import brute
import pytest
from conftest import prose
from pyspark.sql import functions as F
from slotwise.llm import resampling

key = lambda r: tuple((x is None, x or 0) for x in r)


def test_against_one_sort(spark, edge_docs, no_docs):
    r = random.Random(2)
    rows = [(d.doc_id, d.text) for d in edge_docs.collect()]
    rows += [(1000 + i, prose(r.randrange(1, 60), 3000 + i) + " Ärger NASA x-y_z 42") for i in range(300)]
    rows += [(77, prose(40, 1))] * 25 + [(None, prose(40, 1))] * 5 + [(78, prose(40, 1)), (78, prose(40, 1) + " " + prose(20, 2))]
    target = [prose(50, 3000), None, "", "NASA nasa 42"]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, score int, segment int")
    bench = spark.createDataFrame([(i, t, 9) for i, t in enumerate(target)], "item_id long, text string, doc_id int")
    got = [tuple(x) for x in resampling.resample(docs, bench).collect()]
    assert sorted(got, key=key) == sorted(brute.importance_draw(rows, target), key=key)
    assert resampling.resample(no_docs, bench).count() == 0
    empty = [tuple(x) for x in resampling.resample(docs, bench.where("false")).collect()]
    assert sorted(empty, key=key) == sorted(brute.importance_draw(rows, []), key=key)


@pytest.mark.parametrize("segments", [1, 7, 64])
def test_ranks_are_exact_and_segments_even(spark, segments):
    """Ties, one row that makes a third of all, runs of different sizes."""
    r = random.Random(4)
    rows = [(i, r.randrange(5), 0, r.randrange(-40, 40)) for i in range(2000)] + [(5000, 3, 0, 7)] * 1000
    df = spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long").repartition(5)
    got = resampling.rank_drawn(df, 50, segment_rows=100, min_segments=segments)
    want = [(*x, i) for i, x in enumerate(sorted(rows, key=lambda x: (-x[3], x[0], x[1])), 1)]
    assert sorted((tuple(x) for x in got.where("rank IS NOT NULL").collect()), key=lambda x: x[4]) == want[:1500]
    assert got.count() == 3000


def test_splitters_cut_evenly(spark):
    df = spark.range(50_000).select(F.xxhash64("id").alias("neg"), F.lit(0).alias("no_id"), F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("n_features"), F.col("id").alias("row")).repartition(6)
    samples = [tuple(x) for x in resampling.regular_samples(df, 100).collect()]
    assert len(samples) <= 6 * 200
    cuts = resampling.splitters(samples, 20)
    assert len(cuts) == 19 and cuts == sorted(cuts)
    from bisect import bisect_right
    from collections import Counter
    sizes = Counter(bisect_right(cuts, resampling.place(*x)) for x in map(tuple, df.collect()))
    assert len(sizes) == 20 and max(sizes.values()) < 2 * 50_000 / 20
