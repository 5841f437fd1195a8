"""The filter audit against applying every order to the documents."""

import math
import random
from fractions import Fraction
from itertools import permutations

import brute
from conftest import prose
from slotwise.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int, source string, mask string"


def test_against_every_order(spark, edge_docs, no_docs):
    r = random.Random(5)
    rows = [(d.doc_id, d.text, d.source) for d in edge_docs.collect()]
    for i in range(150):
        text = prose(r.choice((30, 220)), 9000 + i // 3) + r.choice(("", " #", " AB CD EF" * 20, " the" * 400))
        rows.append((100 + i % 140, text, r.choice((None, "", "web", "news"))))
    rows += [(7, "x y  z\u0085" * 90, "wide"), (6, "x y  z\u0085" * 90, "wide"), (None, "", "wide"), (500, "", "web"), (501, None, "web")]
    labels = [(i, r.choice((0, 1, None)), r.choice((0, 1, None)), "x", "y") for i in range(100, 200)] + [(101, 1, 1, "x", "y")] * 3 + [(None, 1, 1, "x", "y")]
    docs = spark.createDataFrame([(*x, 1, 2.0, "k") for x in rows], "doc_id long, text string, source string, mask int, n double, key string")
    table = spark.createDataFrame(labels, LABELS)
    got = filter_audit.audit_filters(docs, table).collect()
    assert sorted(map(tuple, got)) == brute.filter_audit(rows, [x[:3] for x in labels])
    assert len(got) == 600 * len({x[2] or "" for x in rows})
    assert filter_audit.audit_filters(no_docs, table).count() == 0
    assert {r.good_lost + r.toxic_lost for r in filter_audit.audit_filters(docs, table.where("false")).collect()} == {0}


def test_equations_give_shapley_values():
    """Against the average over all orders, for games that no filters make."""
    r = random.Random(1)
    for n in (2, 3, 4, 5):
        v = [0] + [r.randrange(-50, 50) for _ in range((1 << n) - 1)]
        want = [Fraction(0)] * n
        for order in permutations(range(n)):
            s = 0
            for i in order:
                want[i] += Fraction(v[s | 1 << i] - v[s], math.factorial(n))
                s |= 1 << i
        assert filter_audit.KernelEquations(n).shares(v) == want
