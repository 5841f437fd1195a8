"""Benchmark decontamination: n-gram seeds join passages of training documents to test items, Smith-Waterman scores them.

Words are compared lower-cased and without leading or trailing marks, so that edits of case and punctuation cost nothing.
Seeds are three or four words within five places, some with a gap, so that a copy with every third word changed has seeds.
How often a seed occurs in all documents is counted; passages with a seed that is rare for its item are aligned first, the
others only where their words in common could still give a better alignment. Rarity saves work and decides nothing: a
passage is left out only if its longest common subsequence with the item shows that it cannot reach the score.
The benchmark goes to the tasks in blocks of a bounded number of words, each block against all documents.

Defined results: null and empty texts and items match nothing; items of one or two words hold no seed and match nothing;
items under MIN_WORDS words match only whole, as a part of them may be chance; repeated document rows give repeated result
rows; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import CACHE, LONG, mix
from .batches import emit, slices
from .store import keep, table

#: Places of the words of a seed.
PATTERNS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 3, 4))
SPAN = 5                 # places of the longest seed
MIN_WORDS = 8            # shortest item of which a part counts as a copy
MIN_SCORE = 0.4          # share of the best possible alignment score from which a passage counts as a copy
MATCH, MISS, GAP = 2, -1, -1
BLOCK_WORDS = 1_000_000  # benchmark words per broadcast block
BITS = 22
MEMO_PASSAGES, MEMO_WORDS = 4096, 4096    # alignments a task remembers, and the longest passage among them
COEF = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def normal(word: bytes) -> str:
    w = word.decode("utf-8", "replace").lower()
    if w.isalnum():
        return w
    lo, hi = 0, len(w)
    while lo < hi and not w[lo].isalnum():
        lo += 1
    while hi > lo and not w[hi - 1].isalnum():
        hi -= 1
    return w[lo:hi]


#: ASCII bytes that `normal` takes from both ends of a word.
MARKS = bytes(b for b in range(128) if not chr(b).isalnum())


class WordIds(dict):
    """Lower-cased word without ASCII marks at its ends -> number of its normal form in the block's vocabulary.

    0 for other words, -1 for bare marks. Only words that may have other marks at their ends are brought into normal form.
    """

    def __init__(self, vocabulary: dict[str, int]):
        self.fixed = {w.encode("utf-8", "surrogatepass"): n for w, n in vocabulary.items()}
        super().__init__(self.fixed)
        self.vocabulary = vocabulary

    def __missing__(self, word):
        if word.isascii():
            return 0 if word else -1
        w = normal(word)
        n = self.vocabulary.get(w, 0) if w else -1
        if len(word) <= LONG:
            if len(self) >= len(self.fixed) + CACHE:
                self.clear()
                self.update(self.fixed)         # the vocabulary stays whatever is forgotten
            self[word] = n
        return n

    def of(self, text: str) -> np.ndarray:
        tokens = text.lower().encode("utf-8", "surrogatepass").split()
        ids = np.fromiter(map(self.__getitem__, [t.strip(MARKS) for t in tokens]), dtype=np.int32, count=len(tokens))
        return ids[ids >= 0] if len(ids) and ids.min() < 0 else ids


def seeds_of(ids: np.ndarray):
    """(place, seed hash) arrays of all seeds of a sequence of word numbers; unknown words (0) are in no seed."""
    x, known = ids.astype(np.uint64), ids > 0
    for i, pattern in enumerate(PATTERNS):
        n = len(x) - pattern[-1]
        if n > 0:
            at = np.flatnonzero(np.logical_and.reduce([known[j:j + n] for j in pattern]))
            yield at, mix(sum(x[at + j] * COEF[k] for k, j in enumerate(pattern)) + np.uint64(i))


class Block:
    """A bounded part of the benchmark: vocabulary, items as word numbers, seeds with the items that hold them."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.items: dict[int, np.ndarray] = {}
        self.rare: dict[int, set[int]] = {}
        holders: dict[int, set[int]] = {}
        for item, text in rows:
            ws = [w for w in map(normal, (text or "").encode("utf-8", "surrogatepass").split()) if w]
            if len(ws) < 3:
                continue
            self.items[item] = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], dtype=np.int32)
            for _, h in seeds_of(self.items[item]):
                for g in h.tolist():
                    holders.setdefault(g, set()).add(item)
        self.seeds = np.array(sorted(holders), dtype=np.uint64)
        self.holders = [sorted(holders[g]) for g in self.seeds.tolist()]
        self.bits = np.zeros(1 << BITS, dtype=bool)
        self.bits[(self.seeds >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, seed number) of every seed in a document, by place."""
        places, numbers = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for place, h in seeds_of(ids) if len(self.seeds) else ():
            at = np.flatnonzero(self.bits[(h >> np.uint64(64 - BITS)).astype(np.int64)])
            k = np.searchsorted(self.seeds, h[at])
            k[k == len(self.seeds)] = 0
            ok = self.seeds[k] == h[at]
            places.append(place[at[ok]])
            numbers.append(k[ok])
        place, number = np.concatenate(places), np.concatenate(numbers)
        order = np.argsort(place, kind="stable")
        return place[order], number[order]

    def set_counts(self, counts: np.ndarray) -> None:
        """Call seeds rare that occur no more often than half of the occurring seeds of their item."""
        of_item: dict[int, list[int]] = {}
        for k in np.flatnonzero(counts).tolist():
            for item in self.holders[k]:
                of_item.setdefault(item, []).append(k)
        self.rare = {item: set(np.array(ks)[counts[ks] <= np.median(counts[ks])].tolist()) for item, ks in of_item.items()}

    def passages(self, ids: np.ndarray, places: np.ndarray, numbers: np.ndarray):
        """(item, passages) for every item with seeds in a document; a passage is (no rare seed?, start, word numbers)."""
        by_item: dict[int, list[tuple[int, int]]] = {}
        for p, k in zip(places.tolist(), numbers.tolist()):
            for item in self.holders[k]:
                by_item.setdefault(item, []).append((p, k))
        for item, found in by_item.items():
            reach, rare, out = 2 * len(self.items[item]), self.rare.get(item, ()), []
            first = last = found[0][0]
            common = True
            for p, k in [*found, (None, None)]:
                if p is None or p - last > reach:
                    lo = max(0, first - reach)
                    out.append((common, lo, ids[lo:last + SPAN + reach]))
                    first, common = p, True
                last, common = p, common and k not in rare
            yield item, out


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """(best local alignment score, end of the aligned part in the passage). One numpy row per item word."""
    step = np.arange(len(passage) + 1) * -GAP
    row = np.zeros(len(passage) + 1, dtype=np.int64)
    best, end = 0, 0
    for w in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(passage == w, MATCH, MISS), row[1:] + GAP)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + step) - step      # gaps along the passage
        j = int(row.argmax())
        if row[j] > best:
            best, end = int(row[j]), j
    return best, end


class Aligned:
    """Alignments of passages with items; equal passages, as in copies, are aligned once while they are remembered."""

    def __init__(self, block: Block, min_score: float):
        self.items, self.min_score, self.memo, self.places = block.items, min_score, {}, {}

    def needed(self, item: int) -> float:
        return self.min_score if len(self.items[item]) >= MIN_WORDS else 1.0

    def bound(self, item: int, passage: np.ndarray) -> float:
        """No alignment scores higher: every match is a step of a common subsequence. One big-integer step a known word."""
        if item not in self.places:
            if len(self.places) >= MEMO_PASSAGES:
                self.places.clear()
            at: dict[int, int] = {}
            for i, w in enumerate(self.items[item].tolist()):
                at[w] = at.get(w, 0) | 1 << i
            self.places[item] = at
        at, n = self.places[item], len(self.items[item])
        full = (1 << n) - 1
        free = full
        for m in filter(None, map(at.get, passage.tolist())):
            used = free & m
            free = ((free + used) | (free - used)) & full
        return (n - free.bit_count()) / n

    def best(self, item: int, passages) -> tuple[float, int, int] | None:
        """(score, start, end) of the best copy among the passages of an item, the first of equal ones; None if there is none."""
        best = None
        for _, at, ids in sorted(passages, key=lambda p: p[:2]):
            bound = self.bound(item, ids)
            if bound < self.needed(item) or best is not None and bound < best[0]:
                continue
            score, start, end = self.of(item, ids)
            if score >= self.needed(item) and (best is None or (score, -at - start) > (best[0], -best[1])):
                best = score, at + start, at + end
        return best

    def of(self, item: int, passage: np.ndarray) -> tuple[float, int, int]:
        """(score, start, end in the passage) of the best alignment."""
        if len(passage) > MEMO_WORDS:
            return self.align(item, passage)
        key = item, passage.tobytes()
        if key not in self.memo:
            if len(self.memo) >= MEMO_PASSAGES:
                self.memo.clear()
            self.memo[key] = self.align(item, passage)
        return self.memo[key]

    def align(self, item: int, passage: np.ndarray) -> tuple[float, int, int]:
        x = self.items[item]
        score, end = smith_waterman(x, passage)
        _, back = smith_waterman(x[::-1], passage[:end][::-1])
        return score / (MATCH * len(x)), end - back, end


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS):
    """Items in blocks of about `block_words` words; a block is all that the driver holds at once."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = max(1, -(-total // block_words))
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).orderBy("item_id", "text").collect()
        yield Block([(r[0], r[1]) for r in rows])


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows (doc_id, item_id, score, start, end): passages of documents that copy a benchmark item, best passage per document row and item.

    score is the alignment score over that of a full copy; start and end are positions among the document's words.
    """
    found = None
    for block in benchmark_blocks(benchmark, block_words):
        part = _block_leaks(docs, block, min_score)
        found = part if found is None else found.unionByName(part)
    return found


def seed_hits(docs: DataFrame, block: Block) -> DataFrame:
    """(doc_id, ids, places, numbers) of the documents with a seed: word numbers, and places and numbers of the seeds, as bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def find(batches):
        own = shared.value
        ids_of, gap = WordIds(own.vocabulary), np.zeros(SPAN, np.int32)
        for b in slices(batches):
            # all documents of a slice in one row of words, apart by unknown ones
            docs_, words = b.column(0).to_pylist(), [ids_of.of(t) for t in b.column(1).to_pylist()]
            start = np.cumsum([0] + [len(w) + SPAN for w in words])
            places, numbers = own.hits(np.concatenate([x for w in words for x in (w, gap)] or [gap]))
            cut, rows = np.searchsorted(places, start), []
            for i in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                lo, hi = cut[i], cut[i + 1]
                rows.append((docs_[i], words[i].astype("<i4").tobytes(), (places[lo:hi] - start[i]).astype("<i8").tobytes(), numbers[lo:hi].astype("<i4").tobytes()))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["doc_id", "ids", "places", "numbers"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    return rows.mapInArrow(find, "doc_id long, ids binary, places binary, numbers binary")


def seed_counts(hits: DataFrame, seeds: int) -> np.ndarray:
    """How often each seed of a block occurs in all documents."""
    def run(batches):
        total = np.zeros(seeds, np.int64)
        for b in slices(batches):
            for numbers in b.column(0).to_pylist():
                np.add.at(total, np.frombuffer(numbers, "<i4"), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["seed", "n"])
    out = np.zeros(seeds, np.int64)
    for k, n in hits.select("numbers").mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n")).collect():
        out[k] = n
    return out


def _block_leaks(docs: DataFrame, block: Block, min_score: float) -> DataFrame:
    hits = keep(seed_hits(docs, block))
    block.set_counts(seed_counts(hits, len(block.seeds)))
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def align():
        own = shared.value
        known = Aligned(own, min_score)

        def one(doc, ids, places, numbers):
            for item, passages in own.passages(np.frombuffer(ids, "<i4"), np.frombuffer(places, "<i8"), np.frombuffer(numbers, "<i4")):
                if (found := known.best(item, passages)) is not None:
                    yield doc, item, *found
        return one
    return emit(hits, align, "doc_id long, item_id long, score double, start long, end long")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that it copies."""
    rows = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return (rows.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("score", "start", "end"), F.struct("score", -F.col("start"))).alias("r"))
                .select("doc_id", "item_id", F.round("r.score", 6).alias("score"), "r.start", "r.end"))
