"""Merging event candidates across documents and versions, and their state over time.

Candidates: row_id, event_id, document_id, document_version_id, version, available_at, authority, event_type,
asset_key, region_key, market_key, the mergeable FIELDS, the RECORD fields and cleared_fields (array).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hours_between, r6
from .common import ensure_checkpoint_dir, running

FIELDS = ("region_key", "asset_key", "capacity_mw", "effective_start_at", "effective_end_at")
RECORD = ("relevance", "event_type", "direction", "status", "physical_effect", "review_status", "eligibility", "market_key")


def authority(tier) -> Column:
    """0 for primary, operator, regulator, government or official sources, 2 for media, reposts and aggregators, else 1."""
    t = F.lower(F.coalesce(F.col(tier) if isinstance(tier, str) else tier, F.lit("")))
    return F.when(t.startswith("primary_") | t.rlike("operator|regulator|government|official"), 0).when(t.rlike("secondary|media|repost|aggregator"), 2).otherwise(1)


def identity(records: DataFrame, column: str):
    """A key as text for grouping and joining: NULL and empty lists are the same empty key, lists are compared in order."""
    kind = dict(records.dtypes).get(column)
    if kind is None:
        return F.lit("")
    c = F.col(column)
    return F.coalesce(F.array_join(F.array_sort(c.cast("array<string>")), "\x1f") if kind.startswith("array") else c.cast("string"), F.lit(""))


def link_edges(records: DataFrame) -> DataFrame:
    """Pairs (src, dst) of candidates that state the same event; every group links to its first member only.

    Keys may be single values or lists, and may be missing; `group_keys` is part of the lineage where the candidates have it.
    """
    keys = ["event_type", "_asset", "_region", "_market"]
    records = records.select("*", *[identity(records, c).alias(n) for c, n in (("asset_key", "_asset"), ("region_key", "_region"), ("market_key", "_market"), ("group_keys", "_group"))])
    first = records.groupBy("event_id").agg(F.min("row_id").alias("dst"))
    by_id = records.join(first, "event_id").select(F.col("row_id").alias("src"), "dst")
    far = F.lit("9999-12-31").cast("timestamp")
    near = F.lit("0001-01-01").cast("timestamp")
    w = Window.partitionBy("document_version_id", *keys, "_group").orderBy(F.coalesce("effective_start_at", near), F.coalesce("effective_end_at", far), "event_id", "row_id")
    sib = records.withColumn("ordinal", F.row_number().over(w))       # siblings inside one document version
    lineage = ["document_id", *keys, "_group", "ordinal"]
    owner = sib.groupBy(*lineage).agg(F.min_by(F.struct("row_id", "document_version_id"), "row_id").alias("_o"))
    by_line = sib.join(owner, lineage).where(F.col("_o.document_version_id") != F.col("document_version_id")).select(F.col("row_id").alias("src"), F.col("_o.row_id").alias("dst"))
    cleared = records.where(F.array_contains("cleared_fields", "asset_groups")).select("row_id", "document_id", *keys, F.col("available_at").alias("_at"), F.col("document_version_id").alias("_ver"))
    prior = records.groupBy("document_id", *keys, "document_version_id", "available_at").agg(F.min("row_id").alias("dst"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 1)
    withdrawn = cleared.join(prior, ["document_id", *keys]).where((F.col("available_at") < F.col("_at")) & (F.col("document_version_id") != F.col("_ver"))).select(F.col("row_id").alias("src"), "dst")
    return by_id.unionByName(by_line).unionByName(withdrawn).where(F.col("src") != F.col("dst")).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components: (row_id, component) with the smallest member as the component.

    Smallest-label propagation with pointer jumping; each round is written to the
    checkpoint folder, so lineage stays short and a lost executor costs one round.
    """
    spark = nodes.sparkSession
    ensure_checkpoint_dir(spark)
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().checkpoint()
    lab = nodes.select(F.col("row_id").alias("id"), F.col("row_id").alias("label")).checkpoint()
    while True:
        near = both.join(lab, F.col("dst") == F.col("id")).groupBy("src").agg(F.min("label").alias("near"))
        step = lab.join(near, F.col("id") == F.col("src"), "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        root = step.select(F.col("id").alias("rid"), F.col("label").alias("root"))
        nxt = step.join(root, F.col("label") == F.col("rid")).select("id", "old", F.least("label", "root").alias("label")).checkpoint()
        lab = nxt.select("id", "label")
        if nxt.where(F.col("old") != F.col("label")).isEmpty():
            return lab.select(F.col("id").alias("row_id"), F.col("label").alias("component"))


def link_events(records: DataFrame, as_of=None) -> DataFrame:
    """Candidates visible at `as_of` with their component."""
    r = records if as_of is None else records.where(F.col("available_at") <= F.lit(as_of).cast("timestamp"))
    return r.join(components(r, link_edges(r)), "row_id")


def _stated(f: str) -> Column:
    """Struct of the field where the row states or clears it, else NULL."""
    return F.when(F.array_contains("cleared_fields", f) | F.col(f).isNotNull(), F.struct(F.col(f).alias("v")))


def merge_fields(linked: DataFrame) -> DataFrame:
    """One merged event per component, from aggregates only.

    Donors: the best-authority lineage's rows, newest first; then the newest row of every other
    lineage by authority and age. The first donor that states or clears a field decides it.
    """
    micros = F.unix_micros("available_at")
    order = F.struct("available_at", "version", "row_id")
    lin = linked.groupBy("component", "document_id").agg(F.min(F.struct("authority", "available_at", "document_id")).alias("_key"), F.max(order).alias("_latest"))
    prim = lin.groupBy("component").agg(F.min("_key").alias("_p")).select("component", F.col("_p.document_id").alias("primary_document_id"))
    d = linked.join(lin.select("component", "document_id", "_latest"), ["component", "document_id"]).join(prim, "component")
    own = F.col("document_id") == F.col("primary_document_id")
    key = F.when(own, F.struct(F.lit(0).alias("g"), (-micros).alias("a"), (-F.col("version")).alias("b"), (-F.col("row_id")).alias("c"), F.lit("").alias("s"))).when(
        order == F.col("_latest"), F.struct(F.lit(1).alias("g"), F.col("authority").cast("long").alias("a"), micros.alias("b"), F.lit(0).cast("long").alias("c"), F.col("document_id").alias("s")))
    d = d.withColumn("_k", key)
    aggs = [F.min_by(_stated(f), F.when(_stated(f).isNotNull(), F.col("_k"))).alias(f"_f_{f}") for f in FIELDS]
    rec = F.max_by(F.struct(*RECORD), F.when(own, order)).alias("_rec")
    earliest = F.min_by(F.struct("event_id", "available_at"), order).alias("_first")
    m = d.groupBy("component", "primary_document_id").agg(*aggs, rec, earliest, F.count(F.lit(1)).alias("members"), F.max("available_at").alias("last_available_at"))
    m = m.select("component", F.col("_first.event_id").alias("event_id"), F.col("_first.available_at").alias("announcement_available_at"), "last_available_at", "members", "primary_document_id",
                 *[F.col(f"_rec.{c}").alias(c) for c in RECORD], *[F.col(f"_f_{f}.v").alias(f) for f in FIELDS])
    return m.withColumn("effective_end_at", F.when(F.col("effective_start_at").isNotNull(), F.col("effective_end_at")))


def state_history(linked: DataFrame, keep=lambda df: df) -> DataFrame:
    """State of every event at each instant a member arrived, without pairing members with instants.

    Authority has three levels, so the leading lineage changes at most twice: the first lineage of each level.
    A value from outside it comes from some lineage's newest row; ordered by arrival, a row leads its level from
    the moment all earlier rows have been replaced until it is replaced itself, which is a running maximum of
    replacement times, taken for all fields and levels in one long table. Both kinds of leader go on one time line per
    event (`keep` cuts the plan there) and are scanned once.
    """
    far = F.lit("9999-01-01").cast("timestamp")
    nxt = Window.partitionBy("component", "document_id").orderBy("available_at", "version", "row_id")     # versions of one document
    rows = linked.withColumn("_until", F.coalesce(F.lead("available_at").over(nxt), far))
    leads = (linked.groupBy("component", "authority").agg(F.min(F.struct("available_at", "document_id")).alias("_q"))
             .select("component", F.col("authority").alias("_level"), F.col("_q.document_id").alias("document_id"), F.col("_q.available_at").alias("_since")))
    own = rows.join(leads, ["component", "document_id"])
    levels, at_level = range(3), lambda a, c: F.when(F.col("_level") == a, c)
    instants = linked.select("component", F.col("available_at").alias("at"), F.lit(2).alias("_o"), F.col("row_id").alias("_t")).distinct()
    owns = own.select("component", F.col("available_at").alias("at"), F.lit(0).alias("_o"), (F.col("version") * 1_000_000_000 + F.col("row_id") % 1_000_000_000).alias("_t"),
                      *[at_level(a, F.struct(*RECORD)).alias(f"rec{a}") for a in levels], *[at_level(a, _stated(f)).alias(f"own{a}_{f}") for a in levels for f in FIELDS])
    starts = leads.select("component", F.col("_since").alias("at"), F.lit(0).alias("_o"), F.lit(0).cast("long").alias("_t"), *[at_level(a, F.lit(True)).alias(f"lead{a}") for a in levels])
    # one row per stated field, its value in the column of that field
    kinds = dict(linked.dtypes)
    stated = [F.when(_stated(f).isNotNull(), F.struct(F.lit(f).alias("field"), *[(F.col(g) if g == f else F.lit(None).cast(kinds[g])).alias(g) for g in FIELDS])) for f in FIELDS]
    cand = (rows.select("component", F.col("authority").alias("_level"), "available_at", "document_id", "row_id", "_until", F.explode(F.array_compact(F.array(*stated))).alias("_v"))
                .withColumn("_field", F.col("_v.field")))
    win = running(cand, ["component", "_level", "_field"], "available_at", ["document_id", "row_id"], max_before={"_covered": "_until"})
    win = win.where(F.col("_covered").isNull() | (F.col("_until") > F.col("_covered"))).withColumn("at", F.greatest("available_at", F.coalesce("_covered", "available_at"))).where(F.col("at") < far)
    others = win.select("component", "at", F.lit(1).alias("_o"), F.col("row_id").alias("_t"),
                        *[at_level(a, F.when(F.col("_field") == f, F.struct(F.col(f"_v.{f}").alias("v"), F.col("_until").alias("until")))).alias(f"other{a}_{f}") for a in levels for f in FIELDS])
    cols = [c for x in (owns, starts, others) for c in x.columns if c not in ("component", "at", "_o", "_t")]
    tl = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [instants, owns, starts, others])
    s = running(keep(tl), ["component"], "at", ["_o", "_t"], last=cols).where(F.col("_o") == 2)
    level = F.when(F.col("lead0"), 0).when(F.col("lead1"), 1).otherwise(2)
    pick = lambda prefix, tail="": F.when(level == 0, F.col(f"{prefix}0{tail}")).when(level == 1, F.col(f"{prefix}1{tail}")).otherwise(F.col(f"{prefix}2{tail}"))
    s = s.withColumn("_rec", pick("rec"))
    for f in FIELDS:
        alive = [F.when(F.col(f"other{a}_{f}.until") > F.col("at"), F.struct(F.col(f"other{a}_{f}.v").alias("v"))) for a in range(3)]
        s = s.withColumn(f, F.coalesce(pick("own", f"_{f}"), *alive)["v"])
    first = linked.groupBy("component").agg(F.min_by("event_id", F.struct("available_at", "version", "row_id")).alias("event_id"), F.min("available_at").alias("announcement_available_at"))
    last_at = s.groupBy("component", "at").agg(F.max_by(F.struct("_rec", *FIELDS), "_t").alias("_s"))
    out = last_at.join(first, "component").select("component", "event_id", "announcement_available_at", F.col("at").alias("available_at"), *[F.col(f"_s._rec.{c}").alias(c) for c in RECORD], *[F.col(f"_s.{f}").alias(f) for f in FIELDS])
    return out.withColumn("effective_end_at", F.when(F.col("effective_start_at").isNotNull(), F.col("effective_end_at")))


def lead_times(events: DataFrame) -> DataFrame:
    """Hours from announcement to effect, whether it was announced ahead or after the fact, and when it is usable."""
    lead = hours_between("effective_start_at", "announcement_available_at")
    return events.withColumn("lead_hours", r6(lead)).withColumn("after_the_fact", F.coalesce(lead < 0, F.lit(False))).withColumn("advance_notice", F.coalesce(lead > 0, F.lit(False))).withColumn(
        "usable_from", F.greatest("effective_start_at", "announcement_available_at"))


def exclude_events(events: DataFrame, market: str | None = None) -> DataFrame:
    """First reason an event stays out of the price study; NULL for analyzable events."""
    rules = [(F.col("review_status") == "rejected", "rejected_in_review"), (F.col("eligibility") != "eligible", "not_eligible")]
    if market is not None:
        rules.append((F.coalesce(F.col("market_key") != market, F.lit(True)), "market_mismatch"))
    rules += [(F.col("event_type").isin("irrelevant", "unknown"), "skipped_type"), (F.col("relevance") != "short_term", "long_horizon"),
              (F.col("status") == "cancelled", "cancelled"), (F.col("effective_start_at").isNull(), "no_effective_start")]
    reason = reduce(lambda acc, r: acc.when(r[0], r[1]), rules[1:], F.when(rules[0][0], rules[0][1]))
    return events.withColumn("exclusion_reason", reason)
