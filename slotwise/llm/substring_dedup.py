"""Substring dedup with suffix automata: words covered by a repeated window of words are removed.

Reference shards are the distinct cells (see `repeats`) of a set of anchors. A task builds the suffix automaton of a
shard, which knows how often every word sequence of the shard occurs, streams the cells through it for their matching
statistics (the longest repeated sequence that ends at each word), and marks spans at or above the threshold. Shards are
sent to the tasks by anchor rather than broadcast whole, since reference text grows with the corpus.

Defined results: a null or empty text has no words and the hash of no bytes; repeated rows count as occurrences of each
other; a null doc_id is a document like others; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import extend
from .repeats import Words, covered, keyed, repeated_windows, with_marks
from .store import table

SHARD_WORDS = 30_000     # words of an automaton; a shard ends at the next anchor


class SuffixAutomaton:
    """Suffix automaton of several sequences with the number of occurrences of every state."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size, self.count = [-1], [0], [0]

    def _clone(self, p: int, q: int, w) -> int:
        """Split off the part of state q that is one longer than p."""
        c = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.size.append(self.size[p] + 1)
        self.count.append(0)
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def add(self, sequence, weight: int) -> list[int]:
        """Add a sequence that occurs `weight` times; the states of its prefixes."""
        last, states = 0, []
        nxt, link, size, count = self.next, self.link, self.size, self.count
        for w in sequence:
            q = nxt[last].get(w)
            if q is not None:
                last = q if size[q] == size[last] + 1 else self._clone(last, q, w)
            else:
                new = len(nxt)
                nxt.append({})
                size.append(size[last] + 1)
                count.append(0)
                link.append(0)
                p = last
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][w]
                    link[new] = q if size[q] == size[p] + 1 else self._clone(p, q, w)
                last = new
            count[last] += weight
            states.append(last)
        return states

    def repeated(self) -> list[int]:
        """Per state, the length of its longest suffix that occurs twice. Counts are final after this."""
        order = sorted(range(1, len(self.next)), key=self.size.__getitem__)
        for v in reversed(order):
            self.count[self.link[v]] += self.count[v]
        best = [0] * len(self.next)
        for v in order:
            best[v] = self.size[v] if self.count[v] > 1 else best[self.link[v]]
        return best

    def matching_statistics(self, sequence, best: list[int]):
        """Stream a sequence: per symbol, the length of the longest repeated sequence that ends there."""
        v, length = 0, 0
        for w in sequence:
            while v and w not in self.next[v]:
                v = self.link[v]
                length = self.size[v]
            if w in self.next[v]:
                v, length = self.next[v][w], length + 1
            yield min(length, best[v])


def shard_masks(cells: list[tuple], own: Words) -> list[tuple]:
    """(h, c, mask) of the cells of one shard that hold repeated windows."""
    automaton = SuffixAutomaton()
    sequences = [own.unpack(content) for *_, content in cells]
    for (_, _, m, _), seq in zip(cells, sequences):
        automaton.add(seq, min(m, 2))
    best, out = automaton.repeated(), []
    for (h, c, _, _), seq in zip(cells, sequences):
        mask = 0
        for end, n in enumerate(automaton.matching_statistics(seq, best)):
            if n >= own.length:
                mask |= 1 << (end - own.length + 1)
        if mask:
            out.append((h, c, mask.to_bytes((mask.bit_length() + 7) // 8, "little")))
    return out


def automaton_masks(contents: DataFrame) -> DataFrame:
    """The method: cells are grouped by anchor, streamed in anchor order, and compared shard by shard."""
    def run(batches):
        own, shard, size, last = Words(), [], 0, None
        for pdf in batches:
            out = []
            for h, c, m, n, content in zip(pdf["h"], pdf["c"], pdf["m"], pdf["windows"], pdf["content"]):
                if size >= SHARD_WORDS and h != last:
                    out += shard_masks(shard, own)
                    shard, size = [], 0
                shard.append((h, c, m, content))
                size += n + own.length
                last = h
            yield pd.DataFrame(out, columns=["h", "c", "mask"])
        yield pd.DataFrame(shard_masks(shard, own), columns=["h", "c", "mask"])
    return contents.repartition("h").sortWithinPartitions("h", "c").mapInPandas(run, "h long, c long, mask binary")


def remove_repeated_words(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_words, n_removed, spans (first word, end), kept (text of the words that stay)."""
    rows = keyed(docs)
    marks = repeated_windows(rows, Words, automaton_masks)

    def cut():
        own = Words()

        def one(text, marked):
            units = own.units(text)
            gone = covered(len(units), marked, own.length)
            edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
            return len(units), int(gone.sum()), edge.tolist(), b" ".join([u for u, g in zip(units, gone.tolist()) if not g])
        return one
    joined = with_marks(rows, marks).select("doc_id", "text", "marks")
    return extend(joined, cut, ["text", "marks"], "n_words long, n_removed long, spans array<int>, kept binary", drop=("text", "marks"))


def op4_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_words(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
