"""Near-duplicates by improved consistent weighted sampling of TF-IDF word shingles.

A shingle is five words in a row; its weight is its count in the text times the mean damped inverse document frequency
of its words. Document frequencies of words are counted over all documents into a table of fixed size. Each text gives SAMPLES
consistent weighted samples in bands of ROWS; texts that agree in a band are candidates, and the weighted Jaccard
similarity of the full shingle sets decides.

Texts are compared once per distinct text. Within a band bucket every text meets the bucket's head first; only texts that
end in another class than the head meet the bucket's other classes, so a large group of copies costs one comparison a
member.

Defined results: a null text counts as empty; texts of fewer than five words are only equal to the same text; a row
without doc_id gets no class; rows that share a doc_id are compared each by its own text, and only equal rows are one
document; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import WordHashes, hashed, mix, words
from .batches import emit, extend, slices
from .components import components
from .store import keep, split_by_keys, table, with_values

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 10, 3
SAMPLES = BANDS * ROWS
AGREE = 12               # samples of SAMPLES that a pair must share to be compared; at 0.8 fewer has odds of 3 in 10 million
BLOCK_TEXTS, BLOCK_BYTES = 256, 4 << 20   # texts, and bytes of shingle sets, of a block
DF_BITS = 18             # document frequencies are counted in 2 ** DF_BITS buckets of word hashes
TABLE_BITS = 16          # stored random draws; every sample picks from them by its own multiplier
_rng = np.random.Generator(np.random.PCG64(20240229))
DRAW_R = _rng.gamma(2.0, 1.0, 1 << TABLE_BITS).astype(np.float32)
DRAW_LOG_C = np.log(_rng.gamma(2.0, 1.0, 1 << TABLE_BITS)).astype(np.float32)
DRAW_B = _rng.random(1 << TABLE_BITS).astype(np.float32)
MULTIPLIERS = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
COEFS = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def damped(n, df):
    """Inverse document frequency, damped by a second logarithm: a rare word weighs about twice a common one.

    Undamped, the new words of an edited copy would outweigh the words it shares with its source.
    """
    return 1.0 + np.log1p(np.log((n + 1) / (df + 1)))


def word_buckets(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - DF_BITS)).astype(np.int64)


def shingles(text: str | None, cache: WordHashes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, weights)."""
    x = hashed(words(text), cache)
    n = len(x) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.float32)
    h = mix(sum(x[j:j + n] * COEFS[j] for j in range(SHINGLE)))
    # in whole steps, so that the sum of a shingle is the same wherever it stands
    run = np.concatenate(([0], np.cumsum(idf[word_buckets(x)])))
    h, first, count = np.unique(h, return_index=True, return_counts=True)
    return h, (count * (run[first + SHINGLE] - run[first]) / (1024.0 * SHINGLE)).astype(np.float32)


def samples(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """SAMPLES consistent weighted samples of a weighted set, as hashes of (shingle, level)."""
    best, out = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64)
    for lo in range(0, len(h), 4096):
        hs, lw = h[lo:lo + 4096], np.log(w[lo:lo + 4096])[:, None]
        at = ((hs[:, None] * MULTIPLIERS) >> np.uint64(64 - TABLE_BITS)).astype(np.intp)
        r, b = DRAW_R[at], DRAW_B[at]
        t = np.floor(lw / r + b)
        a = DRAW_LOG_C[at] - r * (t - b) - r
        i = a.argmin(axis=0)                       # the smallest hash of equal ones, as h is sorted
        k = np.arange(SAMPLES)
        better = a[i, k] < best
        best = np.where(better, a[i, k], best)
        out = np.where(better, mix(hs[i] + (t[i, k].astype(np.int64) * np.int64(0x9E3779B97F4A7C1)).view(np.uint64)), out)
    return out


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Inverse document frequencies by word bucket in steps of 1/1024, from all documents; 2 ** DF_BITS whole numbers."""
    size = 1 << DF_BITS
    block = 1 << 12

    def run(batches):
        cache, total, n = WordHashes(), np.zeros(size, dtype=np.int64), 0
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                total[np.unique(word_buckets(hashed(words(text), cache)))] += 1
                n += 1
        rows = [(i, total[i * block:(i + 1) * block].tobytes(), n if i == 0 else 0) for i in range(size // block)]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.int64()))], names=["block", "counts", "n"])

    def add(pdf):
        return pd.DataFrame({"block": [pdf["block"][0]], "counts": [np.sum([np.frombuffer(c, np.int64) for c in pdf["counts"]], axis=0).tobytes()], "n": [int(pdf["n"].sum())]})
    schema = "block int, counts binary, n long"
    # one block of each task meets in a group: as many short rows as there are tasks
    rows = docs.where(F.col("text").isNotNull()).select("text").mapInArrow(run, schema).groupBy("block").applyInPandas(add, schema).collect()
    total, n = np.zeros(size), 1
    for b, counts, m in rows:
        total[b * block:(b + 1) * block] = np.frombuffer(counts, np.int64)
        n += m
    return np.round(1024 * damped(n, total)).astype(np.int64)


def text_key(text) -> Column:
    """Key of a text: 128 bits of its SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def row_key(doc_id, text) -> Column:
    """Key of a document: 128 bits of the SHA-256 of its id and text; the same for rows equal in both."""
    return text_key(F.concat_ws(":", F.col(doc_id).cast("string"), F.coalesce(text, F.lit(""))))


def signatures(docs: DataFrame, idf) -> DataFrame:
    """(doc_id, row_key, text_key, samples) of every row with a doc_id; samples are null for texts without shingles."""
    def sign():
        cache = WordHashes()

        def one(text):
            h, w = shingles(text, cache, idf.value)
            return (samples(h, w).view(np.int64) if len(h) else None,)
        return one
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("row_key"), F.coalesce("text", F.lit("")).alias("text"))
    return extend(rows.select("doc_id", "row_key", text_key("text").alias("text_key"), "text"), sign, "text", "samples array<long>", drop=("text",))


def agreeing(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose samples agree often enough."""
    a = texts.select(F.col("node").alias("a"), F.col("samples").alias("_sa"))
    b = texts.select(F.col("node").alias("b"), F.col("samples").alias("_sb"))
    same = F.aggregate(F.zip_with("_sa", "_sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return pairs.join(a, "a").join(b, "b").where(same >= AGREE).select("a", "b")


def bags(docs: DataFrame, nodes: DataFrame, idf) -> DataFrame:
    """(node, bag): the full shingle set of the texts of `nodes`, as sorted hashes and weights in one binary."""
    def sets():
        cache = WordHashes()

        def one(node, text):
            h, w = shingles(text, cache, idf.value)
            yield node, h.tobytes() + w.tobytes()
        return one
    nodes = keep(nodes.distinct())
    possible, _ = split_by_keys(docs.where(F.col("text").isNotNull()).select(text_key("text").alias("node"), "text"), "node", nodes)
    return emit(possible.dropDuplicates(["node"]).join(nodes, "node"), sets, "node binary, bag binary")


def split_bag(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(bag) // 12
    return np.frombuffer(bag, np.uint64, n), np.frombuffer(bag, np.float32, n, 8 * n)


def weighted_jaccard(x, y) -> float:
    (h, w), (g, v) = x, y
    if not len(h) or not len(g):
        return 0.0
    at = np.searchsorted(g, h)
    at[at == len(g)] = 0
    hit = g[at] == h
    shared = float(np.minimum(w[hit], v[at[hit]]).sum(dtype=np.float64))
    return shared / (float(w.sum(dtype=np.float64) + v.sum(dtype=np.float64)) - shared)


def verified(pairs: DataFrame, docs: DataFrame, idf, similarity: float) -> DataFrame:
    """Links (a, b, similarity) among `pairs`, by the weighted Jaccard similarity of the full shingle sets."""
    sets = keep(bags(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")), idf))

    def compare():
        def one(a, b, x, y):
            s = weighted_jaccard(split_bag(x), split_bag(y))
            if s >= similarity:
                yield a, b, s
        return one
    side = lambda n: sets.select(F.col("node").alias(n), F.col("bag").alias(f"bag_{n}"))
    return emit(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "bag_a", "bag_b"), compare, "a binary, b binary, similarity double")


def remaining_links(star: DataFrame, first: DataFrame, texts: DataFrame, docs: DataFrame, idf, similarity: float) -> DataFrame:
    """Links between classes of texts that share a band, beyond the links with heads.

    Texts are grouped by the connected groups of `star`, which hold every pair that shares a band. Texts outside a
    group's largest class meet the texts of other classes, block by block: a task gets two blocks of bounded size,
    compares samples as matrices, and reads the full sets only for pairs that share a band and agree often enough. Only
    links that join two classes come out, so a group never becomes a table of its pairs.
    """
    groups = keep(components(star).select("node", F.col("root").alias("grp")))
    own = components(first.select("a", "b"))
    placed = keep(groups.join(own, "node", "left").select("node", "grp", F.coalesce("root", "node").alias("own")))
    main = (placed.groupBy("grp", "own").agg(F.count(F.lit(1)).alias("n")).groupBy("grp").agg(F.max_by("own", F.struct("n", "own")).alias("main"), F.count(F.lit(1)).alias("classes"))
                  .where("classes > 1").select("grp", "main"))
    todo = keep(placed.join(main, "grp"))
    full = keep(todo.join(texts.select("node", "samples"), "node").join(bags(docs, todo.select("node"), idf), "node"))
    row = F.struct("node", "own", "samples", "bag")

    def blocks(side: DataFrame, name: str) -> DataFrame:
        size = side.groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum(F.length("bag")) / BLOCK_BYTES)).alias("n"))
        return (side.join(size, "grp").withColumn("blk", F.pmod(F.xxhash64("node"), F.col("n"))).groupBy("grp", "blk")
                    .agg(F.collect_list(row).alias(name), F.first("main").alias("main")))
    apart = blocks(full.where(F.col("own") != F.col("main")), "left").select("grp", "main", "left", F.col("blk").alias("left_blk"))
    # the pairs of blocks of one group are dealt over the tasks
    met = apart.join(blocks(full, "right").select("grp", "right", "blk"), "grp").repartition("grp", "left_blk", "blk")

    def compare():
        def one(main, left, right):
            a, b = (np.array([r["samples"] for r in side]) for side in (left, right))
            # keys as numbers in the order of the keys
            number = {k: i for i, k in enumerate(sorted({k for side in (left, right) for r in side for k in (r["node"], r["own"])} | {main}))}
            na, nb = (np.array([number[r["node"]] for r in side]) for side in (left, right))
            oa, ob = (np.array([number[r["own"]] for r in side]) for side in (left, right))
            same = a[:, None, :] == b[None, :, :]
            # two texts outside the main class meet in one order only
            ok = (oa[:, None] != ob[None, :]) & ((ob == number[main])[None, :] | (na[:, None] < nb[None, :])) & same.reshape(len(a), len(b), BANDS, ROWS).all(axis=3).any(axis=2)
            agree = same.sum(axis=2)
            ok &= agree >= AGREE
            at = np.argwhere(ok)
            at = at[np.argsort(-agree[ok], kind="stable")]
            root: dict[int, int] = {}

            def find(x):
                while root.get(x, x) != x:
                    x = root[x]
                return x
            sets: dict[int, tuple] = {}
            for i, j in at.tolist():
                x, y = find(int(oa[i])), find(int(ob[j]))
                if x == y:
                    continue
                s = weighted_jaccard(*(sets.setdefault(r["node"], split_bag(r["bag"])) for r in (left[i], right[j])))
                if s >= similarity:
                    root[max(x, y)] = min(x, y)
                    yield *sorted((left[i]["node"], right[j]["node"])), s
        return one
    return emit(met.select("main", "left", "right"), compare, "a binary, b binary, similarity double")


def buckets(texts: DataFrame) -> DataFrame:
    """(bucket, node, head) of every text that shares a band with another.

    The head of a bucket is the text that shares bands with most others, the smallest of equal ones. In a group of copies
    that is the text they were made from, or the one closest to it.
    """
    bands = F.array(*[F.xxhash64(F.lit(i), *[F.col("samples")[ROWS * i + j] for j in range(ROWS)]) for i in range(BANDS)])
    members = keep(texts.select("node", F.explode(bands).alias("bucket")))
    shared = keep(members.join(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket"))
    known = shared.groupBy("node").agg(F.sum("n").alias("known"))
    heads = shared.join(known, "node").groupBy("bucket").agg(F.min_by("node", F.struct(-F.col("known"), "node")).alias("head"))
    return shared.join(heads, "bucket").select("bucket", "node", "head")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(classes, links): links the verified pairs of text keys; classes has per document row

    doc_id, row_key, text_id (smallest document of the same text), class_id (smallest document of the class), n_links (links
    of its text), kept (true for one document of each class: equal rows are one document).
    Links connect every class; pairs that are connected already are not compared again.
    """
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(document_frequencies(docs))
    rows = keep(signatures(docs, idf))
    texts = keep(rows.groupBy("text_key").agg(F.min("doc_id").alias("text_id"), F.count(F.lit(1)).alias("n"), F.first("samples").alias("samples")).withColumnRenamed("text_key", "node"))
    usable = texts.where(F.col("samples").isNotNull())
    star = keep(buckets(usable).where(F.col("node") != F.col("head")).select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct())
    first = keep(verified(agreeing(star, usable), docs, idf, similarity))
    links = keep(first.unionByName(remaining_links(star, first, usable, docs, idf, similarity)))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    placed = (texts.select("node", "text_id", "n").join(components(links.select("a", "b")), "node", "left").join(degree, "node", "left")
                   .select("node", "text_id", "n", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "node").alias("root")))
    placed = keep(placed)
    of_class = placed.groupBy("root").agg(F.min(F.struct("text_id", "node")).alias("least"), F.count(F.lit(1)).alias("texts"))
    of_text = keep(with_values(placed, of_class.select("root", "least"), "root", of_class.select("root", F.col("texts").alias("n")))
                   .select(F.col("node").alias("text_key"), "text_id", "n_links", F.col("least.text_id").alias("class_id"), (F.col("node") == F.col("least.node")).alias("chosen")))
    out = with_values(rows.select("doc_id", "row_key", "text_key"), of_text, "text_key", texts.select(F.col("node").alias("text_key"), "n"))
    return out.select("doc_id", "row_key", "text_id", "class_id", "n_links", (F.col("chosen") & (F.col("doc_id") == F.col("class_id"))).alias("kept")), links


def op7_weighted_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))[0].select("doc_id", "text_id", "class_id", "n_links")
