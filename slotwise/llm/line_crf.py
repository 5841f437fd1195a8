"""Line labelling with a linear-chain conditional random field: content or boilerplate.

The field is trained here on a bounded sample of line sequences. Simple rules label the clear lines; the others stay
unobserved, so training maximizes the likelihood of the clear labels with the rest summed out. Viterbi decoding then
labels every line of every whole text, and the share of words on content lines decides whether a document stays.

Defined results: a null or empty text has no words, no lines, fails the base counts and is not kept; repeated rows give
repeated result rows; an empty table trains nothing and gives no rows; other columns of `documents` are never read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import WordHashes
from .batches import extend
from .store import table
from .textstats import SPACES, SYMBOLS, base_counts, base_failed, case_counts

SAMPLE_DOCS = 1500       # documents of the training sample
SAMPLE_LINES = 48        # consecutive lines that a document gives to the sample
KEEP_SHARE = 0.5         # share of words on content lines from which a document is kept
STEPS, RATE, RIDGE = 100, 0.3, 1e-3
#: Binary features of a line, in the order of the bits.
FEATURES = ("always", "words<3", "words<8", "words>=15", "ends a sentence", "symbols>0", "symbols>=2%", "pipes", "upper>=60%", "upper<20%", "digits>=20%",
            "repeats an earlier line", "link or address", "legal or navigation words", "one word repeats", "first", "last", "exclamations", "starts upper", "few distinct words")
LEGAL = re.compile(r"licensed under|copyright|all rights reserved|privacy policy|terms of (?:use|service)|cookie|subscribe|sign in|log in|click here|read more", re.I)
LINK = re.compile(r"https?://|www\.|\S@\S+\.\S")


def line_bits(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(feature bits, words) of every line that has a word, in order."""
    seen: set[str] = set()
    bits, sizes = [], []
    for line in text.split("\n"):
        ws = line.split()
        if not line.strip(SPACES):
            continue
        n, chars = len(ws), len(line)
        letters_up, letters = case_counts(line)
        symbols = sum(map(line.count, SYMBOLS))
        distinct = len(set(ws))
        digits = sum(map(line.count, "0123456789"))
        up = letters_up / max(1, letters)
        b = 1 | (n < 3) << 1 | (n < 8) << 2 | (n >= 15) << 3 | (line.rstrip()[-1:] in ".?!…»\"'") << 4
        b |= (symbols > 0) << 5 | (symbols >= 0.02 * chars) << 6 | (line.count("|") > 1) << 7 | (up >= 0.6 and letters >= 8) << 8 | (up < 0.2) << 9
        b |= (digits >= 0.2 * chars) << 10 | (line in seen) << 11 | bool(LINK.search(line)) << 12 | bool(LEGAL.search(line)) << 13
        b |= (n >= 4 and distinct <= n / 3) << 14 | (not bits) << 15 | (line.count("!!") > 1) << 17 | line.lstrip()[:1].isupper() << 18 | (n >= 12 and distinct < 0.4 * n) << 19
        seen.add(line)
        bits.append(b)
        sizes.append(n)
    if bits:
        bits[-1] |= 1 << 16
    return np.array(bits, dtype=np.int64), np.array(sizes, dtype=np.int64)


def clear_labels(bits: np.ndarray) -> np.ndarray:
    """1 clear content, 0 clear boilerplate, -1 unobserved."""
    on = lambda name: (bits >> FEATURES.index(name)) & 1 == 1
    bad = on("symbols>=2%") | on("pipes") | on("upper>=60%") | on("digits>=20%") | on("repeats an earlier line") | on("legal or navigation words") | on("exclamations") | on("few distinct words") | on("one word repeats")
    good = ~bad & ~on("words<8") & on("ends a sentence") & on("upper<20%")
    return np.where(bad, 0, np.where(good, 1, -1))


def matrix(bits: np.ndarray) -> np.ndarray:
    return ((bits[..., None] >> np.arange(len(FEATURES))) & 1).astype(float)


def _forward_backward(emit: np.ndarray, trans: np.ndarray, length: np.ndarray):
    """(log normalizer, state marginals, summed pair marginals) of padded sequences emit[n, t, 2]."""
    n, t, _ = emit.shape
    alive = np.arange(t)[None, :] < length[:, None]
    lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True), np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis)))[1]
    alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
    alpha[:, 0] = emit[:, 0]
    for i in range(1, t):
        new = lse(alpha[:, i - 1, :, None] + trans, 1) + emit[:, i]
        alpha[:, i] = np.where(alive[:, i, None], new, alpha[:, i - 1])
    for i in range(t - 2, -1, -1):
        new = lse(trans + (emit[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
        beta[:, i] = np.where(alive[:, i + 1, None], new, 0)
    z = lse(alpha[:, -1], 1)
    state = np.exp(alpha + beta - z[:, None, None]) * alive[..., None]
    pair = np.zeros((2, 2))
    for i in range(1, t):
        q = np.exp(alpha[:, i - 1, :, None] + trans + (emit[:, i] + beta[:, i])[:, None, :] - z[:, None, None])
        pair += (q * alive[:, i, None, None]).sum(axis=0)
    return z, state, pair


def train(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(line weights [features, 2], transitions [2, 2]) of the field, by Adagrad on the likelihood of the clear labels."""
    w, trans = np.zeros((len(FEATURES), 2)), np.zeros((2, 2))
    sequences = [s for s in sequences if len(s)]
    if not sequences:
        w[0, 1] = 1.0
        return w, trans
    t = max(map(len, sequences))
    bits = np.zeros((len(sequences), t), dtype=np.int64)
    for i, s in enumerate(sequences):
        bits[i, :len(s)] = s
    length = np.array([len(s) for s in sequences])
    x, clear = matrix(bits), clear_labels(bits)
    barred = np.zeros((*bits.shape, 2))
    barred[..., 0][clear == 1] = -1e9
    barred[..., 1][clear == 0] = -1e9
    total, gw, gt = max(1, length.sum()), np.full_like(w, 1e-6), np.full_like(trans, 1e-6)
    for _ in range(STEPS):
        emit = x @ w
        _, free, free_pair = _forward_backward(emit, trans, length)
        _, held, held_pair = _forward_backward(emit + barred, trans, length)
        dw = np.einsum("ntf,nts->fs", x, held - free) / total - RIDGE * w
        dt = (held_pair - free_pair) / total - RIDGE * trans
        gw += dw ** 2
        gt += dt ** 2
        w += RATE * dw / np.sqrt(gw)
        trans += RATE * dt / np.sqrt(gt)
    return w, trans


def viterbi(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best state of every line."""
    (a, b), (c, d) = trans.tolist()
    rows = emit.tolist()
    lo, hi = rows[0]
    back = []
    for e0, e1 in rows[1:]:
        to0, to1 = (lo + a, hi + c), (lo + b, hi + d)
        back.append((to0[1] > to0[0], to1[1] > to1[0]))
        lo, hi = max(to0) + e0, max(to1) + e1
    state = int(hi > lo)
    out = [state]
    for step in reversed(back):
        state = int(step[state])
        out.append(state)
    return np.array(out[::-1])


def sample_sequences(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> list[np.ndarray]:
    """Feature bits of at most sample_lines lines of sample_docs documents, chosen by hash."""
    def run(batches):
        for pdf in batches:
            out = []
            for text, h in zip(pdf["text"], pdf["h"]):
                bits, _ = line_bits(text)
                at = int(h) % max(1, len(bits) - sample_lines + 1)
                out.append(bits[at:at + sample_lines])
            yield pd.DataFrame({"bits": out})
    ranked = docs.where(F.col("text").isNotNull()).select("text", F.xxhash64("doc_id", "text").alias("h"))
    chosen = ranked.select("h").orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    if chosen is None:
        return []
    rows = ranked.where(F.col("h") <= chosen).dropDuplicates(["h"]).mapInPandas(run, "bits array<long>").collect()
    return [np.array(r[0], dtype=np.int64) for r in rows]


def label_lines(docs: DataFrame, keep_share: float = KEEP_SHARE, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Per document row: base counts, labels (one digit a line, 1 content), content_share, base_failed, kept."""
    weights, trans = train(sample_sequences(docs, sample_docs))

    def make():
        cache = WordHashes()

        def one(text):
            c = base_counts(text, cache)
            bits, sizes = line_bits(text or "")
            share, labels = 0.0, ""
            if len(bits):
                state = viterbi(matrix(bits) @ weights, trans)
                share, labels = float((state * sizes).sum() / max(1, sizes.sum())), "".join(map(str, state.tolist()))
            failed = base_failed(c)
            return (*c, failed, not failed and share >= keep_share, share, labels)
        return one

    return extend(docs.select("doc_id", "text"), make, "text", "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, labels string", drop=("text",))


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_lines(table(spark, sf_dir, "documents")).withColumn("content_share", F.round("content_share", 6)).drop("labels")
