"""Toxicity of deobfuscated text: a noisy-channel decoder restores disguised words, then learned word odds score the text.

Disguised tokens (look-alike digits and marks, letters set apart by spaces or marks, repeated letters) become character
lattices; Viterbi decoding under a character trigram model of the corpus picks the word. A token with one path, which is
what a plain word is, needs no decoding. A token with a doubled character is read twice, with both kept and with one
offered, and both readings count, as plain words have doubles too. A word broken into pieces is read from at least three
pieces of one or two characters; two longer pieces in a row are two words. Words and their beginnings are scored by how surely they mark labelled toxic
documents, and a logistic curve over a document's surest words gives the score.

Defined results: a null or empty text has no words and gets the score of a text without marked words; a null doc_id is
not held out and has no label; repeated rows give repeated result rows; without labels every score is the curve's start
value of about 0.05; other columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import remember
from .batches import emit, extend, slices
from .store import keep, table

SAMPLE_DOCS = 20_000     # labelled documents that teach the scorer; chosen by hash
COUNTED = 200_000        # distinct tokens a task counts before it passes them on
THRESHOLD = 0.7
SURE = 0.5               # word scores below it carry no evidence
Z = 1.64                 # width of the confidence bound of a word's share of toxic documents
PREFIXES = range(4, 9)   # lengths of word beginnings that are scored beside the word
SYMBOLS = 64             # character classes of the language model: boundary, a-z, and 37 shared by all other letters
#: Look-alikes of letters, with the letters they may stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "¡": "i"}
APART = ".-_*~'`^,/\\"   # marks that may set letters apart
LOOK_COST, DROP_COST, SAME_COST, SPLIT_COST = 0.7, 0.4, 0.7, 3.0
STRIP = re.compile(r"^[\W_]*[\"'.,;:?()\[\]{}<>*_~-]+(?=\w)|[.,;:?\"')\]}>]+$|([%&$#*!|+])\1+$")
ENDS = ".,;:?\"')]}>"      # what STRIP takes from the end of a word of letters
TRIPLE = re.compile(r"(.)\1\1")
TWICE = re.compile(r"(.)\1")
PIECES = re.compile(b"\1{3,}")          # at least three tokens in a row of one or two characters


def code(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else 27 + ord(ch) % (SYMBOLS - 27)


def bare(token: str) -> str:
    """Lower-cased token without outer punctuation and trailing runs of marks."""
    plain = token.rstrip(ENDS)
    if plain.isalpha():
        return plain.lower()
    prev = None
    while prev != token:
        prev, token = token, STRIP.sub("", token)
    return token.lower()


# ---- language model -------------------------------------------------------------------------------------------------

def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): lower-cased words of letters over all documents, added up in the tasks first."""
    def run(batches):
        seen: Counter = Counter()

        def out():
            words: Counter = Counter()
            for token, n in seen.items():
                w = bare(token)
                if w.isalpha():
                    words[w] += n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], names=["word", "n"])
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                seen.update(text.split())
                if len(seen) > COUNTED:
                    yield out()
        yield out()
    return docs.where(F.col("text").isNotNull()).select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def trigram_counts(words: DataFrame) -> np.ndarray:
    """Counts of character triples of all words, boundaries included; SYMBOLS ** 3 numbers."""
    def run(batches):
        total = np.zeros(SYMBOLS ** 3)
        for b in slices(batches):
            text = b.column("word").to_pylist()
            c = np.frombuffer("".join(f"\0\0{w}\0" for w in text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            c = np.where((c >= 97) & (c <= 122), c - 96, np.where(c == 0, 0, 27 + c % (SYMBOLS - 27)))
            size = np.fromiter(map(len, text), np.int64, len(text)) + 1                # triples of each word
            first = np.repeat(np.concatenate(([0], np.cumsum(size + 2)[:-1])), size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            total += np.bincount((c[first] * SYMBOLS + c[first + 1]) * SYMBOLS + c[first + 2], np.repeat(b.column("n").to_numpy(zero_copy_only=False), size), SYMBOLS ** 3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])
    out = np.zeros(SYMBOLS ** 3)
    for at, n in words.select("word", "n").mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n")).collect():
        out[at] = n
    return out


def log_probabilities(counts: np.ndarray, k: float = 5.0) -> np.ndarray:
    """log P(third | first, second), smoothed with the shorter contexts."""
    c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    c2 = c3.sum(axis=0)
    p1 = (c2.sum(axis=0) + 0.5) / (c2.sum() + 0.5 * SYMBOLS)
    p2 = (c2 + k * p1) / (c2.sum(axis=1, keepdims=True) + k)
    return np.log((c3 + k * p2) / (c3.sum(axis=2, keepdims=True) + k)).astype(np.float32)


# ---- decoding -------------------------------------------------------------------------------------------------------

def lattice(token: str, undouble: bool = False) -> list[list[tuple[str, float]]]:
    """Per place of a token, the strings it may stand for with their channel costs; `undouble` offers one beside two equal."""
    places, i = [], 0
    while i < len(token):
        ch, j = token[i], i + 1
        while j < len(token) and token[j] == ch:
            j += 1
        run = j - i
        if ch == " ":
            places.append([("", 0.0), (" ", SPLIT_COST)])
        elif ch.isalpha():
            places.append([(ch, SAME_COST), (ch * 2, SAME_COST)] if run > 2 else [(ch * run, 0.0), (ch, SAME_COST)] if run == 2 and undouble else [(ch * run, 0.0)])
        else:
            options = [(x * m, LOOK_COST) for x in LOOKS.get(ch, "") for m in ((1, 2) if run > 2 or run == 2 and undouble else (run,))]
            if ch in APART or not options:
                options.append(("", DROP_COST))
            places.append(options)
        i = j
    return places


def decode(token: str, logp: np.ndarray, undouble: bool = False) -> str:
    """Cheapest reading of a token under channel and language model; spaces in it split words."""
    best = {(0, 0): (0.0, "")}
    for options in [*lattice(token, undouble), [(" ", 0.0)]]:
        new: dict = {}
        for (a, b), (cost, text) in best.items():
            for string, extra in options:
                x, y, c = a, b, cost + extra
                for ch in string:
                    z = 0 if ch == " " else code(ch)
                    c -= float(logp[x, y, z])
                    x, y = (0, 0) if z == 0 else (y, z)
                if (x, y) not in new or c < new[x, y][0]:
                    new[x, y] = (c, text + string)
        best = new
    return min(best.values())[1].strip()


class Restored(dict):
    """token -> its restored words, decoded when first met."""

    def __init__(self, logp: np.ndarray):
        self.logp = logp

    def read(self, token: str) -> tuple[str, ...]:
        w = bare(token)
        if not any(map(str.isalpha, w)):
            return ()
        plain = w.isalpha() and not TRIPLE.search(w)
        out = (w,) if plain else tuple(decode(w, self.logp).split())
        return tuple(dict.fromkeys((*out, *decode(w, self.logp, True).split()))) if TWICE.search(w) else out

    def __missing__(self, token):
        return remember(self, token, self.read(token))


def spaced_stretches(tokens: list[str]):
    """Stretches of at least three tokens of one or two characters, lower-cased, with single spaces; bars end a stretch."""
    for m in PIECES.finditer(bytes([n < 3 for n in map(len, tokens)])):
        for part in "\n".join("" if "|" in t else t for t in tokens[m.start():m.end()]).split("\n\n"):
            pieces = part.split()
            if len(pieces) > 2 and sum(map(str.isalpha, part)) >= 2:
                yield " ".join(pieces).lower()


def stretch_words(stretch: str, logp: np.ndarray) -> set[str]:
    out = set(decode(stretch, logp).split())
    return out | set(decode(stretch, logp, True).split()) if TWICE.search(stretch) else out


def restored_words(text: str, restored: Restored) -> set[str]:
    """Distinct words of a text after restoring."""
    tokens, out = text.split(), set()
    for token in set(tokens):
        out.update(restored[token])
    for stretch in spaced_stretches(tokens):
        out |= stretch_words(stretch, restored.logp)
    return out


# ---- scoring --------------------------------------------------------------------------------------------------------

def evidence(pos: float, neg: float) -> float:
    """Lower confidence bound of the share of toxic documents among those with a word."""
    n = pos + neg
    p = pos / n
    return (p + Z * Z / (2 * n) - Z * np.sqrt((p * (1 - p) + Z * Z / (4 * n)) / n)) / (1 + Z * Z / n)


class Lexicon:
    """Surely toxic words and word beginnings with their evidence."""

    def __init__(self, counts: list[tuple[str, int, int]]):
        sums: dict[str, list[int]] = {}
        for word, pos, neg in counts:
            for key in self.keys(word):
                s = sums.setdefault(key, [0, 0])
                s[0] += pos
                s[1] += neg
        self.sure = {k: v for k, (p, q) in sums.items() if p and (v := evidence(p, q)) >= SURE}

    @staticmethod
    def keys(word: str):
        yield "=" + word
        for n in PREFIXES:
            if len(word) >= n:
                yield word[:n]

    def score(self, word: str) -> float:
        return max((self.sure.get(k, 0.0) for k in self.keys(word)), default=0.0)

    def summary(self, words: set[str]) -> list[float]:
        """Features of a document: surest word, second surest, log count of sure words."""
        s = sorted((v for w in words if (v := self.score(w))), reverse=True)
        return [s[0] if s else 0.0, s[1] if len(s) > 1 else 0.0, float(np.log1p(len(s)))]


#: What `skeleton` makes of a character: look-alikes and l, which 1 and | are read as beside i, as one letter.
FOLD = str.maketrans({ch: letters[0] for ch, letters in LOOKS.items()} | {"l": "i"})
RUN = re.compile(r"(.)\1+")


def skeleton(token: str) -> str:
    """What all readings of a lower-cased token share: letters and look-alikes as one letter each, runs as one, no marks."""
    folded = token.translate(FOLD)
    return RUN.sub(r"\1", folded if folded.isalpha() else "".join(filter(str.isalpha, folded)))


class Marked(dict):
    """lower-cased token -> its surely toxic words.

    Only tokens that can be read as a sure word or beginning are decoded: skeletons of all readings are alike. Longer
    tokens whose first letters no sure word has are not stored, as they come once or twice.
    """

    def __init__(self, restored: Restored, lexicon: Lexicon):
        self.restored, self.lexicon = restored, lexicon
        whole = {k[1:] for k in lexicon.sure if k[0] == "="}
        begin = {k for k in lexicon.sure if k[0] != "="}
        self.heads = {k[:4] for k in whole | begin}
        self.words, self.beginnings = set(map(skeleton, whole)), set(map(skeleton, begin))
        self.parts = self.words | self.beginnings
        self.part_heads = {k[:3] for k in self.parts}
        self.lengths, self.part_lengths = (sorted({len(k) for k in x}) for x in (self.beginnings, self.parts))

    def reachable(self, token: str) -> bool:
        s = skeleton(token)
        return s[:3] in self.part_heads and (s in self.words or any(s[:n] in self.beginnings for n in self.lengths))

    def __missing__(self, token):
        w, score = bare(token), self.lexicon.score
        if w.isalpha() and not TWICE.search(w):
            if w[:4] not in self.heads:
                return remember(self, token, ()) if len(token) < 7 else ()
            out = (w,) if score(w) else ()
        elif self.reachable(w):
            out = tuple(filter(score, self.restored.read(token)))
        else:
            return ()
        return remember(self, token, out)

    def of(self, text: str) -> set[str]:
        """Surely toxic words of a text, disguised ones restored."""
        tokens = text.lower().split()
        found = {w for ws in filter(None, map(self.__getitem__, set(tokens))) for w in ws}
        for stretch in spaced_stretches(tokens):
            s = skeleton(stretch)
            # a word may begin and end at any piece
            if any(s[i:i + 3] in self.part_heads and any(s[i:i + n] in self.parts for n in self.part_lengths) for i in range(len(s))):
                found.update(filter(self.lexicon.score, stretch_words(stretch, self.restored.logp)))
        return found


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 400) -> np.ndarray:
    """Weights of a logistic curve that rises in every feature, last one the constant."""
    w = np.zeros(x.shape[1] + 1)
    w[-1] = -3.0
    if not len(x):
        return w
    a, g2 = np.hstack((x, np.ones((len(x), 1)))), np.full(len(w), 1e-8)
    for _ in range(steps):
        g = a.T @ (y - 1 / (1 + np.exp(-a @ w))) / len(y) - 1e-4 * w
        g2 += g ** 2
        w += 0.5 * g / np.sqrt(g2)
        w[:-1] = np.maximum(w[:-1], 0)
    return w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """Per document row: doc_id, held_out, score, predicted. Only labels of documents that are not held out are used."""
    spark = docs.sparkSession
    logp = log_probabilities(trigram_counts(keep(word_counts(docs))))
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
                   .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs))
    model = spark.sparkContext.broadcast(logp)

    def learn():
        restored = Restored(model.value)
        return lambda text, toxic: [(sorted(restored_words(text, restored)), toxic)]
    labelled = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(known), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))
    sample = keep(emit(labelled, learn, "words array<string>, toxic int"))
    toxic = (F.col("toxic") == 1).cast("long")
    per_word = sample.select(F.explode("words").alias("word"), "toxic").groupBy("word").agg(F.sum(toxic).alias("pos"), F.sum(1 - toxic).alias("neg"))
    # beginnings are added up in Spark as well; only the sure ones come back
    lexicon = Lexicon([])
    keys = F.array(F.concat(F.lit("="), "word"), *[F.when(F.length("word") >= n, F.substring("word", 1, n)) for n in PREFIXES])
    sums = per_word.select(F.explode(F.array_compact(keys)).alias("key"), "pos", "neg").groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # a share of SURE at the bound needs at least that share in the counts
    for key, pos, neg in sums.where((F.col("pos") > 1) & (F.col("pos") >= SURE * (F.col("pos") + F.col("neg")))).collect():
        if (v := evidence(pos, neg)) >= SURE:
            lexicon.sure[key] = v
    shared = spark.sparkContext.broadcast(lexicon)

    def summarize():
        return lambda words, toxic: [(shared.value.summary(set(words)), toxic)]
    rows = emit(sample, summarize, "x array<double>, toxic int").collect()
    curve = fit_curve(np.array([r[0] for r in rows]).reshape(-1, 3), np.array([float(r[1] == 1) for r in rows]))

    def make():
        own = shared.value
        marked = Marked(Restored(model.value), own)

        def one(text):
            s = float(1 / (1 + np.exp(-(np.dot(own.summary(marked.of(text or "")), curve[:-1]) + curve[-1]))))
            return s, int(s >= threshold)
        return one

    return extend(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), make, "text", "score double, predicted int", drop=("text",))


def op2_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
