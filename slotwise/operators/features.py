"""Event features on a settlement grid, from event states as they were known.

States: series_id, event_id, announcement_available_at, available_at and the state columns of `merging`.
A state holds from its arrival until the event's next one. Everything additive is built from +1/-1 steps at
the slots where a state starts and stops counting, summed along the grid; stretches stay stretches until then, and only
`active_events` and `restored_slots`, whose rows are slots, open them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_if, r6, share
from .align import MarketClock
from .common import asof_join, latest, over_holding, overlap_join, prefix_sums

# Event types with a count column, physical effects with a capacity column, and point-like types.
EVENT_TYPES = ("generation_outage", "generation_restore", "transmission_constraint", "demand_shock", "storage_dispatch", "renewable_supply_change", "fuel_supply_change")
EFFECTS = ("supply_up", "supply_down", "demand_up", "demand_down", "transfer_up", "transfer_down", "mixed", "unknown")
POINT_TYPES = ("generation_restore", "demand_shock", "storage_dispatch")
_FAR = "9999-01-01"


def known_state(states: DataFrame, instants: DataFrame) -> DataFrame:
    """Each (event_id, at) with the newest state that had arrived by then."""
    cols = [c for c in states.columns if c not in ("event_id", "available_at")]
    r = states.withColumn("state_available_at", F.col("available_at"))
    return asof_join(instants, r, ["event_id"], "at", "available_at", ["state_available_at", *cols], ["available_at"])


def pieces(states: DataFrame, cutoff: str | None = None) -> DataFrame:
    """Usable states with the span [known_from, known_until) in which they are the newest; knowledge stops at `cutoff`."""
    far = F.lit(_FAR).cast("timestamp")
    s = states if cutoff is None else states.where(F.col("available_at") <= F.lit(cutoff).cast("timestamp"))
    w = Window.partitionBy("event_id").orderBy("available_at")                    # revisions of one event
    s = s.withColumn("known_from", F.col("available_at")).withColumn("known_until", F.coalesce(F.lead("available_at").over(w), far))
    return s.where((F.col("relevance") == "short_term") & (F.col("eligibility") == "eligible") & (F.col("status") != "cancelled") & (F.col("review_status") != "rejected"))


def active_spans(p: DataFrame, clock: MarketClock) -> DataFrame:
    """Span [active_from, active_until) of grid time in which each piece counts as active, restorations aside."""
    step = clock.seconds
    start = F.col("effective_start_at")
    plus = lambda c: F.timestamp_micros(F.unix_micros(c) + step * 1_000_000)
    open_point = F.col("event_type").isin(*POINT_TYPES) & F.col("effective_end_at").isNull()
    restore = open_point & (F.col("event_type") == "generation_restore")
    seen = F.greatest(start, F.col("known_from"))
    lo = F.when(restore, seen).otherwise(F.greatest(clock.floor(start), F.col("known_from")))
    hi = F.when(restore, plus(seen)).when(open_point, plus(clock.floor(start))).otherwise(F.coalesce("effective_end_at", F.lit(_FAR).cast("timestamp")))
    return p.withColumn("active_from", F.when(start.isNotNull(), lo)).withColumn("active_until", F.when(start.isNotNull(), F.least(hi, F.col("known_until"))))


def slot_of(c, clock: MarketClock):
    """Number of the first grid slot that does not lie before `c`."""
    return F.ceil(F.unix_micros(c) / (clock.seconds * 1_000_000)).cast("long")


def _cut(df: DataFrame, limits: DataFrame) -> DataFrame:
    """Slot ranges [a, b) cut to the market's grid, as first and last slot a..b."""
    j = df.join(limits, "series_id").withColumn("a", F.greatest("a", "_f")).withColumn("b", F.least(F.col("b") - 1, F.col("_l")))
    return j.where(F.col("a") <= F.col("b")).drop("_f", "_l")


def _open(df: DataFrame) -> DataFrame:
    """One row per slot of the ranges a..b."""
    return df.withColumn("slot", F.explode(F.sequence("a", "b"))).drop("a", "b")


def restored_spans(spans: DataFrame, limits: DataFrame, clock: MarketClock) -> DataFrame:
    """Stretches a..b of slots in which an active outage counts as ended: a restoration of the same asset in the same
    market is known, has taken effect and starts no earlier than the outage.

    The latest start among an asset's effective restorations changes only where one begins or ends; between two changes it
    is one piece, and outages meet pieces, not slots. Stretches of one outage do not overlap.
    """
    asset = ["series_id", "asset_key"]
    named = F.col("asset_key").isNotNull() & F.col("effective_start_at").isNotNull()
    r = spans.where(named & (F.col("event_type") == "generation_restore"))
    r = _cut(r.select(*asset, F.col("effective_start_at").alias("_rs"), slot_of(F.greatest("effective_start_at", "known_from"), clock).alias("a"), slot_of("known_until", clock).alias("b")), limits)
    edges = r.select(*asset, F.explode(F.array(F.col("a"), F.col("b") + 1)).alias("_p")).distinct()
    pieces_ = (edges.join(over_holding(edges, r, asset, "_p", "a", "b", "_rs", F.max), [*asset, "_p"], "left")
               .withColumn("_q", F.lead("_p").over(Window.partitionBy(*asset).orderBy("_p")) - 1).where(F.col("_rs").isNotNull()))      # changes of one asset
    o = spans.where(named & (F.col("event_type") == "generation_outage") & (F.col("active_from") < F.col("active_until")))
    o = _cut(o.withColumn("a", slot_of("active_from", clock)).withColumn("b", slot_of("active_until", clock)), limits)
    time = lambda c: F.timestamp_seconds(F.col(c) * clock.seconds)
    o = o.withColumns({"_ta": time("a"), "_tb": time("b")})
    pieces_ = pieces_.withColumns({"_tp": time("_p"), "_tq": time("_q")})
    begins = overlap_join(pieces_, o, asset, "_tp", "_ta", "_tb", closed_end=True)
    holds = overlap_join(o, pieces_, asset, "_ta", "_tp", "_tq", closed_end=True).where(F.col("_p") < F.col("a"))
    both = begins.unionByName(holds).where(F.col("_rs") >= F.col("effective_start_at"))
    return both.withColumns({"a": F.greatest("a", "_p"), "b": F.least("b", "_q")}).drop("_p", "_q", "_rs", "_ta", "_tb", "_tp", "_tq")


def restored_slots(spans: DataFrame, limits: DataFrame, clock: MarketClock) -> DataFrame:
    """`restored_spans`, one row per slot."""
    return _open(restored_spans(spans, limits, clock))


def grid_limits(bounds: DataFrame, clock: MarketClock) -> DataFrame:
    return bounds.select("series_id", slot_of("lo", clock).alias("_f"), (slot_of("hi", clock) - 1).alias("_l"))


def event_features(states: DataFrame, bounds: DataFrame, clock: MarketClock, cutoff: str | None = None, keep=lambda df: df) -> DataFrame:
    """One row per market and interval of [lo, hi): active, announced and upcoming counts, MW totals, hours to the next start.

    With `cutoff`, rows after it know only the states that had arrived by the cutoff, and none is announced there.
    `keep` cuts the plan at the state spans and the slot steps, which are read more than once.
    A total is NULL while any active event has no MW, and 0 while nothing is active.
    """
    step = clock.seconds
    p = keep(active_spans(pieces(states, cutoff), clock))
    limits = grid_limits(bounds, clock)
    slot = lambda c: slot_of(c, clock)
    mw = F.col("capacity_mw").cast("decimal(18,6)").alias("mw")
    shared = ["series_id", "event_id", "event_type", "direction", "physical_effect", "effective_start_at"]
    up = F.struct(slot("known_from").alias("a"), slot(F.least("known_until", "effective_start_at")).alias("b"), F.lit("up").alias("kind"))
    act = F.struct(slot("active_from").alias("a"), slot("active_until").alias("b"), F.lit("act").alias("kind"))
    e = p.withColumn("_x", F.explode(F.array_compact(F.array(F.when(F.col("active_from") < F.col("active_until"), act), F.when(F.col("effective_start_at") > F.col("known_from"), up)))))
    e = e.select(*shared, mw, "_x.*").where(F.col("a") < F.col("b"))
    closed = restored_spans(p, limits, clock).select(*shared, mw, "a", (F.col("b") + 1).alias("b"), F.lit("act").alias("kind"))
    step_rows = lambda df, s: df.withColumn("_d", F.explode(F.array(F.struct(F.col("a").alias("slot"), F.lit(s).alias("sign")), F.struct(F.col("b").alias("slot"), F.lit(-s).alias("sign"))))).select(*shared, "mw", "kind", "_d.slot", "_d.sign")
    ends = step_rows(e, 1).unionByName(step_rows(closed, -1))
    is_act = F.col("kind") == "act"
    one = lambda cond: F.sum(F.when(cond, F.col("sign")).otherwise(0))
    mws = lambda cond: F.sum(F.when(cond, F.coalesce("mw", F.lit(0)) * F.col("sign")).otherwise(F.lit(0).cast("decimal(18,6)")))
    sums = {"n": one(is_act), "unknown": one(is_act & F.col("mw").isNull()), "mw": mws(is_act), "dir_up": one(is_act & (F.col("direction") == "up")), "dir_down": one(is_act & (F.col("direction") == "down")), "ahead": one(F.col("kind") == "up")}
    sums |= {f"t_{t}": one(is_act & (F.col("event_type") == t)) for t in EVENT_TYPES}
    for x in EFFECTS:
        sums |= {f"u_{x}": one(is_act & (F.col("physical_effect") == x) & F.col("mw").isNull()), f"m_{x}": mws(is_act & (F.col("physical_effect") == x))}
    steps = keep(ends.groupBy("series_id", "slot").agg(*[v.alias(k) for k, v in sums.items()]))
    grid = clock.grid(bounds, "lo", "hi").select("series_id", "ts").withColumn("slot", F.floor(F.unix_seconds("ts") / step))
    steps = steps.join(limits, "series_id").where(F.col("slot") <= F.col("_l")).withColumn("slot", F.greatest("slot", "_f")).groupBy("series_id", "slot").agg(*[F.sum(k).alias(k) for k in sums])
    j = grid.join(steps, ["series_id", "slot"], "left")
    run = prefix_sums(j, ["series_id"], "slot", {f"r_{k}": F.coalesce(F.col(k), F.lit(0)) for k in sums}).drop(*sums)
    ahead = _cut(e.where(F.col("kind") == "up"), limits).withColumnRenamed("effective_start_at", "_next")
    nxt = over_holding(grid, ahead, ["series_id"], "slot", "a", "b", "_next", F.min)
    ann = pieces(states, cutoff)
    newest = ann.withColumn("slot", slot("announcement_available_at")).where(F.timestamp_seconds(F.col("slot") * step).between(F.col("known_from"), F.col("known_until") - F.expr("INTERVAL 1 MICROSECOND")))
    if cutoff is not None:
        newest = newest.where(F.timestamp_seconds(F.col("slot") * step) <= F.lit(cutoff).cast("timestamp"))
    newest = newest.groupBy("series_id", "slot").agg(F.count(F.lit(1)).alias("_new"))
    f = run.join(nxt, ["series_id", "slot"], "left").join(newest, ["series_id", "slot"], "left")
    total = lambda n, u, m: F.when(F.col(u) > 0, None).otherwise(r6(F.col(m).cast("double")))
    at = F.col("ts") if cutoff is None else F.least("ts", F.lit(cutoff).cast("timestamp"))
    return f.select(
        "series_id", "ts", at.alias("available_at"), F.col("r_n").cast("long").alias("active_event_count"), total("r_n", "r_unknown", "r_mw").alias("active_capacity_mw"),
        F.col("r_dir_up").cast("long").alias("direction_up_count"), F.col("r_dir_down").cast("long").alias("direction_down_count"), *[F.col(f"r_t_{t}").cast("long").alias(f"count_{t}") for t in EVENT_TYPES],
        F.coalesce("_new", F.lit(0)).cast("long").alias("new_announcement_count"), F.col("r_ahead").cast("long").alias("upcoming_event_count"),
        r6((F.unix_micros("_next") - F.unix_micros("ts")) / 3.6e9).alias("next_effective_in_hours"), *[total("r_n", f"r_u_{x}", f"r_m_{x}").alias(f"capacity_{x}_mw") for x in EFFECTS])


def forecast_event_features(states: DataFrame, bounds: DataFrame, clock: MarketClock, cutoff: str, keep=lambda df: df) -> DataFrame:
    return event_features(states, bounds, clock, cutoff, keep)


def active_events(states: DataFrame, bounds: DataFrame, clock: MarketClock, cutoff: str | None = None) -> DataFrame:
    """(series_id, event_id, ts) of every active event, for evidence; one row per event and interval it covers."""
    p, limits = active_spans(pieces(states, cutoff), clock), grid_limits(bounds, clock)
    live = p.where(F.col("active_from") < F.col("active_until")).select("series_id", "event_id", "known_from", slot_of("active_from", clock).alias("a"), slot_of("active_until", clock).alias("b"))
    closed = restored_slots(p, limits, clock).select("series_id", "event_id", "known_from", "slot")
    return _open(_cut(live, limits)).join(closed, ["series_id", "event_id", "known_from", "slot"], "left_anti").select("series_id", "event_id", F.timestamp_seconds(F.col("slot") * clock.seconds).alias("ts"))


def leak_check(refs: DataFrame, events: DataFrame) -> DataFrame:
    """Feature references (series_id, ts, event_id) to events announced later, and to events nobody knows."""
    j = refs.join(events.select("event_id", "announcement_available_at", F.lit(True).alias("_k")), "event_id", "left")
    return j.groupBy("series_id").agg(F.count(F.lit(1)).alias("references"), count_if(F.col("announcement_available_at") > F.col("ts")).alias("leaked_rows"), count_if(F.col("_k").isNull()).alias("unknown_events"))


def select_features(features: DataFrame, columns: list[str], cutoff: str, min_obs: int = 96) -> DataFrame:
    """Which feature columns have enough values and more than one distinct value before the cutoff."""
    x = features.where((F.col("ts") < F.lit(cutoff).cast("timestamp")) & (F.col("available_at") <= F.lit(cutoff).cast("timestamp")))
    items = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
    u = x.withColumn("_i", F.explode(items)).select("series_id", "_i.name", "_i.value")
    g = u.groupBy("series_id", "name").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("observations"), (F.min("value") < F.max("value")).alias("_varies"))
    reason = F.when(F.col("observations") < min_obs, "too_few_observations").when(~F.coalesce("_varies", F.lit(False)), "constant")
    return g.select("series_id", "name", "observations", share("observations", "rows").alias("coverage"), reason.isNull().alias("selected"), reason.alias("reason"))


def attach_features(model: DataFrame, features: DataFrame, as_of: str, columns: list[str]) -> DataFrame:
    """Model rows with the newest feature version that had arrived by `as_of`."""
    v = latest(features.where(F.col("available_at") <= F.lit(as_of).cast("timestamp")).select("series_id", "ts", "available_at", *columns), ["series_id", "ts"], ["available_at"])
    return model.join(v.select("series_id", "ts", *[F.col(c).alias(f"news_{c}") for c in columns]), ["series_id", "ts"], "left")
