"""SimHash near-duplicates against all pairs of fingerprints."""

import random
from collections import Counter
from itertools import combinations

import brute
import numpy as np
import pytest
from conftest import prose
from slotwise.llm import simhash

key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))


def shown(df):
    out = df.selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0')) AS fingerprint", "component_id")
    return sorted((tuple(r) for r in out.collect()), key=key)


def test_documents_against_all_pairs(spark, edge_docs, no_docs):
    r = random.Random(3)
    rows = [(d.doc_id, d.text) for d in edge_docs.collect()]
    for g in range(12):
        base = prose(300, 700 + g).split()
        for k in range(8):
            words = list(base)
            for _ in range(k % 4):
                words[r.randrange(len(words))] = "other"
            rows.append((1000 + 10 * g + k, " ".join(words).upper() if k == 5 else " ".join(words)))
    rows += [(2000, "Two Words"), (2001, "two\twords"), (2002, "\x1ctwo words"), (2003, "Ä ä Ä"), (None, "   ")]
    docs = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], "doc_id long, text string, fp int, n int, root int")
    want = brute.simhash(rows)
    assert shown(simhash.near_duplicates(docs)) == sorted(want, key=key)
    assert max(Counter(c for *_, c in want).values()) > 4
    assert simhash.near_duplicates(no_docs).count() == 0


def test_rows_without_ids_only(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, None)], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(docs).collect()] == [None, None]


@pytest.fixture(scope="module")
def clustered():
    """Random fingerprints, a dense ball, chains, skewed bits and the two extremes."""
    r = random.Random(11)
    out = {0, (1 << 64) - 1, *(r.getrandbits(64) for _ in range(300)), *(r.getrandbits(20) for _ in range(300))}
    center = r.getrandbits(64)
    out.update(center ^ sum(1 << b for b in r.sample(range(64), r.randrange(5))) for _ in range(500))
    at = r.getrandbits(64)
    for _ in range(60):
        at ^= (1 << r.randrange(64)) | (1 << r.randrange(64))
        out.add(at)
    return sorted(f - (1 << 64) if f >> 63 else f for f in out)


@pytest.mark.parametrize("dense_rows", [simhash.DENSE_ROWS, 40, 1])
def test_links_join_what_is_near(spark, clustered, dense_rows):
    """With all buckets compared pair by pair, with few of them, and with none."""
    nodes = spark.createDataFrame([(f,) for f in clustered], "fp long")
    got = {tuple(sorted(r)) for r in simhash.links(nodes, dense_rows=dense_rows).collect()}
    bits = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    want = {p for p in combinations(clustered, 2) if bits(*p) <= 2}
    assert got <= want
    if dense_rows == simhash.DENSE_ROWS:
        assert got == want

    def classes(links):
        root = {f: f for f in clustered}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in links:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
        return {f: find(f) for f in clustered}
    assert classes(got) == classes(want)


def test_thresholds_obey_the_pigeonhole(spark, clustered):
    fps = np.array(clustered, np.int64)
    plan = simhash.make_plan(spark.createDataFrame([(f,) for f in clustered], "fp long"))
    assert sorted(b for g in plan.groups for b in g) == list(range(64))
    chosen, cost = plan.thresholds(simhash.bit_matrix(fps))
    assert ((chosen + 1).sum(axis=1) == simhash.DISTANCE + 1).all() and (chosen >= -1).all()
    # no other allocation is cheaper
    from itertools import product
    each = plan.candidates(simhash.bit_matrix(fps)) + simhash.PROBE_COST * np.array([[len(f) for f in fs] for fs in plan.flips])
    for t in product(range(-1, 3), repeat=len(plan.groups)):
        if sum(t) + len(t) == simhash.DISTANCE + 1:
            assert (cost <= sum(each[:, i, x] for i, x in enumerate(t) if x >= 0) + 1e-9).all()


def test_correlated_bits_share_a_group():
    x = np.random.default_rng(1).integers(0, 2, (2000, 64))
    for a, b in ((0, 40), (5, 63), (17, 18)):
        x[:, b] = x[:, a]
    groups = simhash.group_bits(x.T @ x, len(x), 3)
    assert all(any(a in g and b in g for g in groups) for a, b in ((0, 40), (5, 63), (17, 18)))
