"""SimHash near-duplicates by the generalised pigeonhole principle.

A document's fingerprint has a bit where more than half of its word shingles' hashes have it. The 64 bits are grouped into
partitions of bits that go together. Two fingerprints within a distance d agree in some partition i up to a threshold t_i
whenever the t_i + 1 add up to d + 1; t_i is -1 for partitions that are not probed. Every distinct fingerprint gets the
thresholds that dynamic programming finds cheapest for it, by the candidates and probes it is expected to cost, probes the
partition values within them, and candidates are verified by counting differing bits.

A bucket of more than DENSE_ROWS rows is not compared pair by pair. Fingerprints within 2r of each other have a value
within r of both, so its members and probes meet at the values within r = d / 2 of them, where all who meet are links.

Defined results: null and empty texts and texts without words have fingerprint zero and are linked like any other; texts
of one or two words are one shingle; a row without doc_id takes part and its component is the smallest doc_id reachable,
null if there is none; repeated rows give repeated result rows; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import emit, extend, slices
from .components import components
from .store import keep, table, with_values

BITS, SHINGLE, SEED = 64, 3, 42
DISTANCE = 2             # differing bits of a link
PARTITIONS = (2, 3)      # numbers of partitions to choose from
SUB_BITS = 11            # widest part of a partition whose values are counted
SAMPLE = 4096            # fingerprints whose expected costs choose the number of partitions
PROBE_COST = 20.0        # a probe is a row to shuffle; it costs as much as verifying this many candidates
DENSE_ROWS = 4096        # rows of a bucket, index entries and probes, that are still compared pair by pair
BLOCK = 1 << 15          # shingles whose bits are counted at once
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


# ---- fingerprints ---------------------------------------------------------------------------------------------------

def fingerprint(text: str | None) -> int:
    """Fingerprint as a signed 64-bit number."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(SHINGLE))) if len(words) >= SHINGLE else [words]
    n = max(1, len(words) - SHINGLE + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(SEED)), "<u8", n)
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, n, BLOCK):
        ones += np.unpackbits(h[lo:lo + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def bit_matrix(fps: np.ndarray) -> np.ndarray:
    """Fingerprints as rows of BITS zeros and ones, lowest bit first."""
    return np.unpackbits(np.ascontiguousarray(fps, dtype="<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def summed(nodes: DataFrame, count, size: int) -> np.ndarray:
    """Sum of count(bit matrix), `size` numbers, over all fingerprints: added up in the tasks and then in Spark."""
    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            total += count(bit_matrix(b.column(0).to_numpy(zero_copy_only=False)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])
    out = np.zeros(size, np.int64)
    for at, n in nodes.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        out[at] = n
    return out


# ---- partitions and thresholds --------------------------------------------------------------------------------------

def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of about equal size, correlated bits together.

    `together` counts the fingerprints that have both bits of a pair. A group starts with the most correlated pair of
    free bits and takes the free bit that goes best with it until it is full.
    """
    p = together / max(1, n)
    one = np.diag(p)
    spread = np.sqrt(np.maximum(np.outer(one * (1 - one), one * (1 - one)), 1e-12))
    tied = np.abs(p - np.outer(one, one)) / spread
    np.fill_diagonal(tied, 0)
    free, out = set(range(BITS)), []
    for i in range(parts):
        size = BITS // parts + (i < BITS % parts)
        a, b = max(combinations(sorted(free), 2), key=lambda ab: tied[ab])
        group = [a, b]
        while len(group) < size:
            group.append(max(sorted(free - set(group)), key=lambda c: tied[c, group].sum()))
        out.append(group[:size])
        free -= set(out[-1])
    return out


def cut(group: list[int]) -> list[list[int]]:
    n = -(-len(group) // SUB_BITS)
    return [group[len(group) * i // n:len(group) * (i + 1) // n] for i in range(n)]


def values(bits: np.ndarray, group: list[int]) -> np.ndarray:
    return bits[:, group].astype(np.int64) @ (1 << np.arange(len(group), dtype=np.int64))


class Plan:
    """A partition of the bits with what is needed to expect the candidates of a fingerprint."""

    def __init__(self, groups: list[list[int]], counts: list[list[np.ndarray]], n: int, distance: int):
        self.groups, self.n, self.distance = groups, n, distance
        self.near = [[self.shares(c / max(1, n)) for c in cs] for cs in counts]
        self.flips = [[np.array([sum(1 << b for b in c) for t in range(d + 1) for c in combinations(range(len(g)), t)], np.int64) for d in range(distance + 1)] for g in groups]

    def shares(self, share: np.ndarray) -> np.ndarray:
        """Share of fingerprints at each distance up to the limit from every value of a sub-partition."""
        width = len(share).bit_length() - 1
        at = np.arange(len(share))
        return np.array([sum((share[at ^ sum(1 << b for b in c)] for c in combinations(range(width), d)), np.zeros(len(share))) for d in range(self.distance + 1)])

    def candidates(self, bits: np.ndarray) -> np.ndarray:
        """Expected candidates [fingerprint, partition, threshold], taking sub-partitions as independent."""
        out = np.zeros((len(bits), len(self.groups), self.distance + 1))
        for i, (group, near) in enumerate(zip(self.groups, self.near)):
            at = None
            for sub, shares in zip(cut(group), near):
                s = shares[:, values(bits, sub)]
                at = s if at is None else np.array([sum(at[k] * s[d - k] for k in range(d + 1)) for d in range(self.distance + 1)])
            out[:, i] = self.n * np.cumsum(at, axis=0).T
        return out

    def thresholds(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(threshold of every partition, expected cost) of each fingerprint: cheapest with sum of t + 1 = distance + 1."""
        probes = np.array([[len(f) for f in fs] for fs in self.flips])
        cost = self.candidates(bits) + PROBE_COST * probes
        goal = self.distance + 1
        best = np.full((len(bits), goal + 1), np.inf)
        best[:, 0] = 0
        choice = np.zeros((len(self.groups), len(bits), goal + 1), np.int64)
        for i in range(len(self.groups)):
            # spending k on a partition gives it the threshold k - 1; 0 skips it
            ways = np.stack([np.concatenate((np.full((len(bits), k), np.inf), best[:, :goal + 1 - k]), axis=1) + (cost[:, i, k - 1, None] if k else 0) for k in range(goal + 1)])
            choice[i], best = ways.argmin(axis=0), ways.min(axis=0)
        left, out = np.full(len(bits), goal), np.zeros((len(bits), len(self.groups)), np.int64)
        for i in reversed(range(len(self.groups))):
            spent = choice[i][np.arange(len(bits)), left]
            out[:, i], left = spent - 1, left - spent
        return out, best[:, goal]

    def rows(self, fps: np.ndarray):
        """(bucket, fingerprint, probe?) arrays: an index entry for every partition, and the probes of every fingerprint."""
        bits = bit_matrix(fps)
        chosen, _ = self.thresholds(bits)
        for i, group in enumerate(self.groups):
            bucket = (i << 56) | values(bits, group)
            yield bucket, fps, np.zeros(len(fps), bool)
            for t in range(self.distance + 1):
                at = np.flatnonzero(chosen[:, i] == t)
                flips = self.flips[i][t]
                yield (bucket[at, None] ^ flips).ravel(), np.repeat(fps[at], len(flips)), np.ones(len(at) * len(flips), bool)


def make_plan(nodes: DataFrame, distance: int = DISTANCE) -> Plan:
    """The plan of least expected cost, from counts over all fingerprints; a fixed sample weighs the numbers of partitions."""
    n = nodes.count()

    def pairs(bits):
        x = bits.astype(np.float64)
        return (x.T @ x).astype(np.int64).ravel()
    together = summed(nodes, pairs, BITS * BITS).reshape(BITS, BITS)
    split = [group_bits(together, n, parts) for parts in PARTITIONS]
    subs = [sub for groups in split for g in groups for sub in cut(g)]

    def histograms(bits):
        return np.concatenate([np.bincount(values(bits, sub), minlength=1 << SUB_BITS) for sub in subs])
    counts = iter(summed(nodes, histograms, len(subs) << SUB_BITS).reshape(len(subs), -1))
    plans = [Plan(groups, [[next(counts)[:1 << len(sub)] for sub in cut(g)] for g in groups], n, distance) for groups in split]
    sample = np.array([r[0] for r in nodes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("fp").collect()], np.int64)
    if not len(sample):
        return plans[0]
    bits = bit_matrix(sample)
    return min(plans, key=lambda p: p.thresholds(bits)[1].mean() + PROBE_COST * len(p.groups))


# ---- links ----------------------------------------------------------------------------------------------------------

def bucket_rows(nodes: DataFrame, plan: Plan) -> DataFrame:
    """(bucket, fp, probe): index entries and probes of all distinct fingerprints."""
    shared = nodes.sparkSession.sparkContext.broadcast(plan)

    def run(batches):
        for b in slices(batches):
            for bucket, fps, probe in shared.value.rows(b.column(0).to_numpy(zero_copy_only=False)):
                for lo in range(0, len(fps), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[lo:lo + (1 << 16)]) for c in (bucket, fps, probe)], names=["bucket", "fp", "probe"])
    return nodes.select("fp").mapInArrow(run, "bucket long, fp long, probe boolean")


def midpoint_links(fps: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) that connect all given fingerprints within the (even) distance of each other, directly or through others.

    All who meet at a value differ by at most the distance, and no more than the values around it can meet there.
    """
    flips = [sum(1 << b for b in c) for t in range(distance // 2 + 1) for c in combinations(range(BITS), t)]
    at = F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(f - (1 << 64) if f >> 63 else f).cast("long")) for f in flips]))
    met = fps.select("fp", at.alias("at")).groupBy("at").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()


def links(nodes: DataFrame, distance: int = DISTANCE, dense_rows: int = DENSE_ROWS) -> DataFrame:
    """Links (a, b) among distinct fingerprints: every pair within the distance outside dense buckets, and enough pairs
    within the distance to connect what is in them."""
    if distance % 2:
        raise ValueError("the distance must be even")
    rows = keep(bucket_rows(nodes, make_plan(nodes, distance)))
    tally = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("probe").alias("probes"), F.min("fp").alias("low"), F.max("fp").alias("high"))
    met = tally.where("probes > 0 AND probes < n AND low <> high").select("bucket", (F.col("n") > dense_rows).alias("dense"))
    met = keep(rows.join(met, "bucket"))
    sparse = met.where("NOT dense")
    probes, index = sparse.where("probe").select("bucket", F.col("fp").alias("a")), sparse.where("NOT probe").select("bucket", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    # each pair within the distance is found by the probes of both
    found = probes.join(index, "bucket").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    return found.unionByName(midpoint_links(met.where("dense").select("fp").distinct(), distance))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Per document row: doc_id, fp (signed), component_id."""
    rows = keep(extend(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lambda: lambda text: (fingerprint(text),), "text", "fp long", drop=("text",)))
    nodes = keep(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    roots = keep(components(links(nodes, distance)).select(F.col("node").alias("fp"), "root"))
    placed = keep(nodes.join(roots, "fp", "left").select("fp", "n", "first_id", F.coalesce("root", "fp").alias("root")))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = placed.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    ids = keep(with_values(placed.select("fp", "root"), least, "root", members).select("fp", "component_id"))
    return with_values(rows, ids, "fp", nodes.select("fp", "n"))


def op12_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
