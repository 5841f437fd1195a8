"""Quality classifier from weak labels: EM weighs overlapping heuristic labellers, posteriors train a hashed linear scorer.

Labellers vote good, bad or nothing on every document. Their class-conditional vote rates and the share of good
documents are estimated by expectation-maximisation over the counts of vote patterns, which Spark adds up over all
documents. The posterior of a pattern is the soft label of its documents; a logistic scorer on hashed word shapes and
statistics is trained on a bounded sample of them and scores every document.

Defined results: a null or empty text gets the votes of a text without words and is scored like any other; repeated rows
give repeated result rows; an empty table gives no rows; other columns of `documents` are never read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import WordHashes, hashed, remember
from .batches import emit, extend
from .store import keep, table
from .textstats import SPACES, SYMBOLS, case_counts, repeated_words

SAMPLE_DOCS = 6000       # documents that train the scorer
BUCKETS = 1 << 12        # hashed features of the scorer
KEEP_SCORE = 0.5
EM_ROUNDS, STEPS, RATE, RIDGE = 60, 300, 0.5, 1e-4
#: Labellers: statistic, sign, bad from (sign 1) or up to (sign -1) this value, good beyond the other; None never votes good.
LABELLERS = (("symbols", 1, 0.02, None), ("upper", 1, 0.5, None), ("pipes", 1, 0.02, None), ("repeats", 1, 0.5, None), ("dup_lines", 1, 0.4, None),
             ("marks", 1, 0.3, None), ("runs", 1, 0.2, None), ("sentence_ends", -1, 0.1, 0.5), ("distinct", -1, 0.12, 0.3), ("words", -1, 2, 20))
STATS = tuple(x[0] for x in LABELLERS)


class Shapes(dict):
    """word bytes -> bucket of its shape: letters as x, X or é, digits as 0, runs collapsed, marks as they are."""

    def __missing__(self, word):
        w = word.decode("utf-8", "replace")
        w = re.sub(r"[^\W\d_]+", lambda m: "X" if m[0].isupper() and len(m[0]) > 1 else "Xx" if m[0][0].isupper() else "x", w)
        w = re.sub(r"\d+", "0", w)
        return remember(self, word, zlib.crc32(w.encode()) % BUCKETS)


def statistics(text: str, hashes: WordHashes) -> tuple[dict[str, float], list[bytes]]:
    tokens = text.encode("utf-8", "surrogatepass").split()
    n, chars = len(tokens), max(1, len(text))
    x = hashed(tokens, hashes)
    lines = [l for l in text.split("\n") if l.strip(SPACES)]
    upper, letters = case_counts(text)
    marks = sum(map(text.count, "!?*#$%&|<>{}[]()=+~^_\\/"))
    return {
        "symbols": sum(map(text.count, SYMBOLS)) / chars, "upper": upper / max(1, letters), "pipes": text.count("|") / max(1, n),
        "repeats": max(0, repeated_words(x) - 30) / max(1, n), "dup_lines": max(0, len(lines) - len(set(lines)) - 1) / max(1, len(lines)),
        "sentence_ends": sum(l.rstrip()[-1:] in ".?!…»\"'" for l in lines) / max(1, len(lines)),
        "distinct": len(np.unique(x)) / max(1.0, min(n, 10.0 + 6 * n ** 0.6)), "marks": marks / max(1, n), "runs": float((x[1:] == x[:-1]).mean()) if n > 1 else 0.0, "words": n,
    }, tokens


def votes(stats: dict[str, float]) -> str:
    """One character a labeller: 1 good, 0 bad, - none."""
    out = []
    for name, sign, bad, good in LABELLERS:
        v = stats[name] * sign
        out.append("0" if v >= bad * sign else "1" if good is not None and v <= good * sign else "-")
    return "".join(out)


def estimate(counts: dict[str, int]) -> tuple[dict[str, float], np.ndarray, float]:
    """EM over vote patterns: (posterior of good by pattern, vote rates [labeller, class, vote], share of good).

    Starts from labellers that are right more often than not, which names the classes; a labeller that never votes good
    starts with silence as its usual answer. Rates are smoothed by about one vote.
    """
    pats = sorted(counts)
    if not pats:
        return {}, np.zeros((len(LABELLERS), 2, 3)), 0.5
    n = np.array([counts[p] for p in pats], dtype=float)
    v = np.array([[{"0": 0, "1": 1, "-": 2}[c] for c in p] for p in pats])
    onehot = np.eye(3)[v]                                        # pattern, labeller, vote
    one_sided, two_sided = [[0.3, 0.001, 0.699], [0.02, 0.001, 0.979]], [[0.3, 0.4, 0.3], [0.05, 0.75, 0.2]]
    rates = np.array([one_sided if x[3] is None else two_sided for x in LABELLERS])
    good = 0.8
    for _ in range(EM_ROUNDS):
        like = np.einsum("plv,lcv->pc", onehot, np.log(rates)) + np.log([1 - good, good])
        post = np.exp(like - like.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        mass = post * n[:, None]
        good = float(np.clip(mass[:, 1].sum() / n.sum(), 0.02, 0.98))
        rates = np.einsum("pc,plv->lcv", mass, onehot) + np.array([[1.0, 0.3, 0.3], [0.3, 1.0, 0.3]])
        rates /= rates.sum(axis=2, keepdims=True)
    return dict(zip(pats, post[:, 1].tolist())), rates, good


def features(stats: dict[str, float], tokens: list[bytes], shapes: Shapes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features (buckets, values): shares of word shapes, and the statistics in steps."""
    b = np.bincount(np.fromiter(map(shapes.__getitem__, tokens), dtype=np.int64, count=len(tokens)), minlength=1) if tokens else np.zeros(0, int)
    at = np.flatnonzero(b)
    steps = [zlib.crc32(f"{k}={min(12, int(np.log1p(100 * v) * 2))}".encode()) % BUCKETS for k, v in stats.items()]
    return np.concatenate((at, np.array(steps))), np.concatenate((np.sqrt(b[at] / max(1, len(tokens))), np.ones(len(steps))))


def fit_scorer(rows: list[tuple[list[int], list[float], float]]) -> np.ndarray:
    """Logistic weights over the buckets by full-batch Adagrad on soft labels."""
    w = np.zeros(BUCKETS + 1)
    if not rows:
        return w
    who = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    at, val = np.concatenate([r[0] for r in rows]).astype(int), np.concatenate([r[1] for r in rows])
    y, g2 = np.array([r[2] for r in rows]), np.full(BUCKETS + 1, 1e-8)
    # both classes weigh alike: junk is rarer than prose
    weight = y / max(1e-9, y.sum()) + (1 - y) / max(1e-9, (1 - y).sum())
    for _ in range(STEPS):
        z = np.bincount(who, val * w[at], len(rows)) + w[-1]
        d = weight * (y - 1 / (1 + np.exp(-z)))
        g = np.append(np.bincount(at, val * d[who], BUCKETS), d.sum()) - RIDGE * w
        g2 += g ** 2
        w += RATE * g / np.sqrt(g2)
    return w


def weak_model(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[dict[str, float], np.ndarray]:
    """(posterior of good by vote pattern, scorer weights) learned from the documents."""
    def vote():
        hashes = WordHashes()
        return lambda text: (votes(statistics(text, hashes)[0]),)

    def describe():
        hashes, shapes = WordHashes(), Shapes()

        def one(text):
            stats, tokens = statistics(text, hashes)
            yield votes(stats), *features(stats, tokens, shapes)
        return one
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    voted = keep(extend(rows, vote, "text", "votes string", drop=("text",)))
    counts = dict(voted.groupBy("votes").count().collect())            # at most 3 ** labellers rows
    post, _, _ = estimate(counts)
    last = voted.select("h").orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    if last is None:
        return post, fit_scorer([])
    sample = emit(rows.where(F.col("h") <= last).dropDuplicates(["h"]).select("text"), describe, "votes string, at array<int>, val array<float>").collect()
    return post, fit_scorer([(r[1], r[2], post[r[0]]) for r in sample])


def classify(docs: DataFrame, keep_score: float = KEEP_SCORE, sample_docs: int = SAMPLE_DOCS, with_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document row: the columns asked for, votes, posterior of the weak labels, score, kept."""
    post, weights = weak_model(docs, sample_docs)
    def make():
        hashes, shapes = WordHashes(), Shapes()

        def one(text):
            stats, tokens = statistics(text, hashes)
            at, val = features(stats, tokens, shapes)
            v = votes(stats)
            s = 1 / (1 + np.exp(-(float(weights[at] @ val) + weights[-1])))
            return v, post[v], s, bool(s >= keep_score)
        return one

    return extend(docs.select(*with_columns, F.coalesce("text", F.lit("")).alias("_text")), make, "_text", "votes string, posterior double, score double, kept boolean", drop=("_text",))


def op9_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "votes", F.round("posterior", 6).alias("posterior"), F.round("score", 6).alias("score"), "kept")
