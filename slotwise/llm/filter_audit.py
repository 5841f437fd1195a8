"""Audit of how text filters interact: what each removes in every order, and its exact Shapley share.

Every document gets the set of filters it fails as a mask. Only the counts of masks per part leave the documents; from
them the removals of all coalitions of filters are tabulated. A filter's share is the solution of the least squares
problem whose weights are the Shapley kernel, constrained to add up to what all filters remove; its normal equations are
solved in rationals, so shares are exact. Counts of a step are differences of two coalitions.

Defined results: a null or empty text has no words and is equal to every other empty text; a null source is the part "";
a row without doc_id has no smaller doc_id, is no smaller doc_id itself and has no labels; rows that repeat a doc_id with
the same text do not fail E through each other; a document is good or toxic if any of its label rows says so; an empty
table gives no rows; other columns are never read.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import emit
from .store import table

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
FIELDS = "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


# ---- failures -------------------------------------------------------------------------------------------------------

def text_failures(text: Column) -> Column:
    """Mask of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]", ""))
    fails = (F.size(words) < 200,
             F.lit(100) * F.size(F.array_distinct(words)) < F.lit(50) * F.size(words),
             F.lit(100).cast("long") * capitals > F.lit(2).cast("long") * F.length(text),
             text.rlike("[#$%&*|]"))
    return sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(fails)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the filters they fail.

    Documents are counted by (text, doc_id) before texts meet, and by text before first ids are looked up, so that a text
    with very many copies is one row a task. Rows without doc_id are spread by their text when labels are joined.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text_failures(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("key"))
    rows = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("key")).otherwise(F.lit(0).cast("long")))
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    rows = rows.join(known.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left").fillna(0, ["good", "toxic"])
    same = ["part", "mask", "key", "good", "toxic"]
    by_id = rows.groupBy("doc_id", "spread", *same).agg(F.count(F.lit(1)).alias("n"))
    by_text = by_id.groupBy(*same).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("low"))
    first = by_text.groupBy("key").agg(F.min("low.doc_id").alias("first"))
    joined = by_text.join(first, "key")
    original = F.col("no_id") + F.when(F.col("low.doc_id") == F.col("first"), F.col("low.n")).otherwise(0)
    split = F.array(F.struct(F.col("mask"), original.alias("n")), F.struct((F.col("mask") + DUPLICATE).alias("mask"), (F.col("n") - original).alias("n")))
    return (joined.select("part", "good", "toxic", F.explode(split).alias("s")).where("s.n > 0").groupBy("part", F.col("s.mask").alias("mask"))
                  .agg(F.sum("s.n").alias("n"), F.sum(F.col("s.n") * F.col("good")).alias("good"), F.sum(F.col("s.n") * F.col("toxic")).alias("toxic")))


def coalitions(masks: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """(part, total, removed, good, toxic): what every coalition of filters removes, as arrays with a place per coalition."""
    def table_of(name):
        return F.array(*[F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, F.col(name))), F.lit(0)) for s in range(1 << filters)])
    return masks.groupBy("part").agg(F.sum("n").alias("total"), table_of("n").alias("removed"), table_of("good").alias("good"), table_of("toxic").alias("toxic"))


# ---- shares ---------------------------------------------------------------------------------------------------------

def solve(a: list[list[Fraction]], b: list[Fraction]) -> list[Fraction]:
    """x with a x = b, by Gauss-Jordan elimination in rationals."""
    n = len(b)
    m = [row[:] + [y] for row, y in zip(a, b)]
    for c in range(n):
        p = next(r for r in range(c, n) if m[r][c])
        m[c], m[p] = m[p], m[c]
        m[c] = [x / m[c][c] for x in m[c]]
        for r in range(n):
            if r != c and m[r][c]:
                m[r] = [x - m[r][c] * y for x, y in zip(m[r], m[c])]
    return [row[-1] for row in m]


class KernelEquations:
    """Normal equations of min sum_S w(S) (v(S) - sum_{i in S} x_i)^2 with sum x = v(all), w the Shapley kernel.

    The last row and column hold the constraint and its multiplier. Only the right side depends on v.
    """

    def __init__(self, n: int):
        self.n, self.full = n, (1 << n) - 1
        self.weights = {s: Fraction(n - 1, comb(n, s.bit_count()) * s.bit_count() * (n - s.bit_count())) for s in range(1, self.full)}
        both = lambda i, j: sum((w for s, w in self.weights.items() if s >> i & 1 and s >> j & 1), Fraction(0))
        self.left = [[both(i, j) for j in range(n)] + [Fraction(1)] for i in range(n)] + [[Fraction(1)] * n + [Fraction(0)]]

    def shares(self, v: list[int]) -> list[Fraction]:
        """Shapley values of a game given by its value for every coalition; v[0] is 0."""
        right = [sum((w * v[s] for s, w in self.weights.items() if s >> i & 1), Fraction(0)) for i in range(self.n)]
        return solve(self.left, right + [Fraction(v[self.full])])[:self.n]


def audit_rows(equations: KernelEquations, names: str, part: str, total: int, removed: list[int], good: list[int], toxic: list[int]):
    """A row for every order of the filters and every step of it."""
    orders = factorial(len(names))
    shares = [int(orders * x) for x in equations.shares(removed)]
    for order in permutations(range(len(names))):
        before, text = 0, "".join(names[i] for i in order)
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            gone = removed[after] - removed[before]
            yield (part, text, step, names[i], total - removed[after], gone, removed[1 << i] - gone, removed[equations.full] - removed[equations.full & ~(1 << i)],
                   good[after] - good[before], toxic[after] - toxic[before], shares[i])
            before = after


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: counts of the step and the filter's removals summed over all orders."""
    def make():
        equations = KernelEquations(len(FILTERS))
        return lambda *row: audit_rows(equations, FILTERS, *row)
    return emit(coalitions(mask_counts(docs, labels)), make, FIELDS)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
firsts AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(d.text) - length(regexp_replace(d.text, '[A-Z]', '', 'g'))) > 2 * length(d.text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > firsts.first_id THEN 'E' ELSE '' END AS fails
  FROM d JOIN firsts ON d.text = firsts.text LEFT JOIN l ON d.doc_id = l.doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS t(x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS filter, filter_order[1:step - 1] AS earlier FROM o, range(1, 6) AS r(step) WHERE length(filter_order) = 5),
r AS (
  SELECT g.part, s.filter_order, s.step, s.filter, g.n, g.good, g.toxic, contains(g.fails, s.filter) AS failing, length(translate(g.fails, s.earlier, '')) < length(g.fails) AS gone, g.fails = s.filter AS alone
  FROM g, s),
c AS (
  SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (gone AND failing), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (NOT gone AND failing), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND failing), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY part, filter_order, step, filter)
SELECT c.*, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM c
"""
