"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

Each task sorts the suffixes at its anchors (see `repeats`) and writes them as front-coded runs: the length of the prefix
shared with the suffix before, and the rest. Runs are exchanged by anchor and merged with a loser tree that compares
known common prefixes first and reads bytes only behind them. The merged order with its common prefix lengths tells, per
anchor, how far two suffixes agree to the right; the bytes before the anchor tell how far they agree to the left, and a
string of the wanted length is repeated where both together reach it.

Defined results: a null or empty text has no bytes and the hash of no bytes; repeated rows count as occurrences of each
other; a null doc_id is a document like others; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import extend
from .repeats import Bytes, covered, keyed, repeated_windows, with_marks
from .store import table

RUN_CELLS = 8192         # suffixes of a sorted run
SHARD_CELLS = 50_000     # suffixes that meet in a merging task, about


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, known to be `at` or more."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    x = int.from_bytes(a[at:n], "big") ^ int.from_bytes(b[at:n], "big")
    return n - (x.bit_length() + 7) // 8


class Run:
    """A front-coded sorted run that is read one suffix at a time."""

    def __init__(self, row):
        self.shared, self.sizes, self.rest, self.items = row["shared"], row["sizes"], row["rest"], row["items"]
        self.i, self.at, self.now, self.lcp = -1, 0, b"", 0
        self.step()

    def step(self) -> None:
        self.i += 1
        if self.i >= len(self.shared):
            self.now = None
            return
        n = int(self.sizes[self.i])
        self.lcp = int(self.shared[self.i])
        self.now = self.now[:self.lcp] + self.rest[self.at:self.at + n]
        self.at += n


def encode_run(entries: list[tuple[bytes, int]]) -> tuple[list[int], list[int], bytes, list[int]]:
    """(shared prefix lengths, rest lengths, rests, item numbers) of sorted (suffix, item)."""
    shared, sizes, rest, items, last = [], [], [], [], b""
    for s, item in entries:
        n = common(last, s)
        shared.append(n), sizes.append(len(s) - n), rest.append(s[n:]), items.append(item)
        last = s
    return shared, sizes, b"".join(rest), items


def merge(runs: list[Run]):
    """(run, suffix, common prefix with the suffix before) in order, by a loser tree.

    Every loser holds its common prefix with the winner that passed it. Of two, the one that shares more with the last
    output is smaller; only a tie is settled by bytes, from the shared prefix on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    tree: list = [None] * size                 # losers as run numbers
    lcp = [0] * size                           # common prefix of each run's head with the last output

    def play(a: int | None, b: int | None):
        """(winner, loser)."""
        if a is None or a >= len(runs) or runs[a].now is None:
            return b, a
        if b is None or b >= len(runs) or runs[b].now is None:
            return a, b
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        x, y = runs[a].now, runs[b].now
        n = common(x, y, lcp[a])
        a_first = n == len(x) or (n < len(y) and x[n] < y[n])
        if a_first and n == len(x) == len(y):
            a_first = a < b
        lcp[b if a_first else a] = n
        return (a, b) if a_first else (b, a)

    level = list(range(size))
    node = size // 2
    while node >= 1:
        nxt = []
        for i in range(0, len(level), 2):
            w, l = play(level[i], level[i + 1])
            tree[node + i // 2] = l
            nxt.append(w)
        level, node = nxt, node // 2
    winner = level[0]
    while winner is not None and winner < len(runs) and runs[winner].now is not None:
        run = runs[winner]
        yield winner, run.now, lcp[winner]
        run.step()
        lcp[winner] = run.lcp
        node = (winner + size) // 2
        while node >= 1:
            winner, tree[node] = play(winner, tree[node])
            node //= 2


def group_masks(lefts: list[bytes], rights: list[int], length: int) -> list[int]:
    """Repeated windows of the cells of one anchor, as bit sets over the distance d of the anchor from the window's start.

    `lefts` are the bytes before the anchor, last byte first, in the order of the suffixes at the anchor; rights[i] is the
    common prefix of suffixes i - 1 and i. Suffixes are joined into sets from the longest common prefix down. When a
    suffix joins a set, the cells next to it in the order of lefts agree longest to the left, so only those are looked at.
    """
    n = len(lefts)
    masks, root, sets = [0] * n, list(range(n)), [[i] for i in range(n)]
    rank = [0] * n
    for r, i in enumerate(sorted(range(n), key=lefts.__getitem__)):
        rank[i] = r

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for i in sorted(range(1, n), key=lambda i: -rights[i]):
        r = rights[i]
        a, b = find(i - 1), find(i)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        big, low = sets[a], length - r
        for x in sets[b]:
            at = bisect_left(big, rank[x], key=rank.__getitem__)
            for y in big[max(0, at - 1):at + 1]:
                high = common(lefts[x], lefts[y])
                if high >= low:
                    bits = (1 << (high + 1)) - (1 << max(0, low))
                    masks[x] |= bits
                    masks[y] |= bits
            big.insert(at, x)
        root[b], sets[b] = a, []
    return masks


def merge_masks(contents: DataFrame) -> DataFrame:
    """The method: front-coded runs per shard, exchanged and merged; (h, c, mask)."""
    shards = max(1, -(-contents.count() // SHARD_CELLS))

    def runs(batches):
        waiting = []

        def flush():
            out = []
            by_shard: dict[int, list] = {}
            for e in waiting:
                by_shard.setdefault(e[0] % shards, []).append(e)
            for shard, es in by_shard.items():
                # the hash in front keeps the suffixes of an anchor together
                es = sorted((((h + (1 << 63)).to_bytes(8, "big") + content[off:], h, c, m, n, content[:off][::-1]) for h, c, m, n, off, content in es), key=lambda e: e[0])
                shared, sizes, rest, items = encode_run([(e[0], i) for i, e in enumerate(es)])
                out.append((shard, shared, sizes, rest, items, [e[2] for e in es], [min(e[3], 2) for e in es], [e[4] for e in es], [e[5] for e in es]))
            waiting.clear()
            return pd.DataFrame(out, columns=["shard", "shared", "sizes", "rest", "items", "c", "m", "windows", "lefts"])
        for pdf in batches:
            for entry in zip(pdf["h"].tolist(), pdf["c"].tolist(), pdf["m"].tolist(), pdf["windows"].tolist(), pdf["offset"].tolist(), pdf["content"]):
                waiting.append(entry)
                if len(waiting) >= RUN_CELLS:
                    yield flush()
        yield flush()

    def join(pdf):
        table_rows = pdf.to_dict("records")
        heads = [Run(r) for r in table_rows]
        out: list[tuple] = []
        group: list[tuple] = []

        def close():
            if not group:
                return
            masks = group_masks([g[2] for g in group], [g[1] for g in group], Bytes.length)
            for (h, _, left, c, m, n), bits in zip(group, masks):
                off = len(left)
                # distance d from the anchor is window off - d of the cell, so the bits are turned around
                mask = (1 << n) - 1 if m > 1 else int(f"{bits >> (off - n + 1) & ((1 << n) - 1):0{n}b}"[::-1], 2)
                if mask:
                    out.append((h, c, mask.to_bytes((mask.bit_length() + 7) // 8, "little")))
            group.clear()
        for k, suffix, lcp in merge(heads):
            if lcp < 8:
                close()
            r, i = table_rows[k], heads[k].i
            group.append((int.from_bytes(suffix[:8], "big") - (1 << 63), lcp - 8, r["lefts"][i], int(r["c"][i]), int(r["m"][i]), int(r["windows"][i])))
        close()
        return pd.DataFrame(out, columns=["h", "c", "mask"])

    schema = "shard int, shared array<int>, sizes array<int>, rest binary, items array<int>, c array<long>, m array<int>, windows array<int>, lefts array<binary>"
    return contents.mapInPandas(runs, schema).groupBy("shard").applyInPandas(join, "h long, c long, mask binary")


def remove_repeated_bytes(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_bytes, n_removed, spans (first byte, end), kept (bytes that stay)."""
    rows = keyed(docs)
    marks = repeated_windows(rows, Bytes, merge_masks)

    def cut():
        own = Bytes()

        def one(text, marked):
            units = own.units(text)
            gone = covered(len(units), marked, own.length)
            edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
            return len(units), int(gone.sum()), edge.tolist(), np.frombuffer(units, np.uint8)[~gone].tobytes()
        return one
    joined = with_marks(rows, marks).select("doc_id", "text", "marks")
    return extend(joined, cut, ["text", "marks"], "n_bytes long, n_removed long, spans array<int>, kept binary", drop=("text", "marks"))


def op5_suffix_merge_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
