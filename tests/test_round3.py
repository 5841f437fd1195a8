"""Whole results, linear scans and bounded tasks: one small test per finding of round 3."""

from pyspark.sql import functions as F
from slotwise import plans
from slotwise.operators import align as al
from slotwise.operators import extraction as ex
from slotwise.operators import forecast as fc

Q, O = plans.load()
SMALL = "/root/testdata/sf0.001"


def test_occupied_keeps_slots_outside_the_price_range(spark, duck):
    """an event's stretches are whole, whether or not its market has a price there."""
    got = Q["occupied"](spark, SMALL).count()
    ends = "epoch_us(x.e) / 1800000000.0"
    want = duck.execute(f"""WITH ev AS (SELECT event_id, user_id, ts - to_hours(CAST(event_id % 3 AS INTEGER)) AS a, ts AS s, CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 2 HOUR ELSE ts + INTERVAL 4 HOUR END AS e FROM events WHERE event_type = 'error'),
        sp AS (SELECT event_id, unnest([{{'s': a, 'e': a + INTERVAL 4 HOUR}}, {{'s': s, 'e': e + INTERVAL 4 HOUR}}]) AS x FROM ev)
        SELECT count(*) FROM (SELECT DISTINCT event_id, unnest(range(CAST(epoch_us(x.s) // 1800000000 AS BIGINT), CAST(ceil({ends}) AS BIGINT))) FROM sp)""").fetchone()[0]
    assert got == want


def test_filled_grid_is_scanned_once_and_never_broadcast(spark):
    """No frame with an open end, which is scanned anew for every row, and no broadcast of the opened grid."""
    prices = spark.range(40).select(F.lit("a").alias("series_id"), F.lit("x").alias("name"), F.timestamp_seconds(F.col("id") * 7200).alias("ts"), F.col("id").cast("double").alias("value"))
    filled = al.fill_linear(al.align(prices, "x", "30min"))
    plan = filled._jdf.queryExecution().executedPlan().toString().splitlines()
    frames, joins = [x for x in plan if "Window" in x and "_p#" in x], [x for x in plan if "Join" in x and "_c#" in x]
    assert frames and not any("unboundedfollowing" in x for x in frames)
    assert joins and not any("Broadcast" in x for x in joins)
    assert filled.count() == 157 and filled.where(F.abs(F.col("value") - F.unix_seconds("ts") / 7200) > 1e-9).count() == 0


def test_quantity_of_zero(spark):
    """F16: zero MW, quoted as stated, gives no capacity; whether it also gets a reason is the caller's choice."""
    docs = spark.createDataFrame([("d", "t", "0.0 MW")], "document_version_id string, title string, body string")
    claims = spark.createDataFrame([("d", 0.0, "MW", "generation_loss", "0.0 MW")], "document_version_id string, value double, unit string, semantic string, raw_text string")
    passed, strict = (ex.check_quantities(claims, docs, **how).head() for how in ({"empty": None}, {}))
    assert (passed.reason, passed.normalized_mw, passed.capacity_mw) == (None, None, None)
    assert (strict.reason, strict.normalized_mw) == ("ambiguous_quantity", None)


def test_rows_of_a_market_spread_over_tasks_at_folds(spark):
    """Cutoffs meet the versions of a market in shares of the time line, not in one task."""
    v = spark.range(500).select(F.lit("a").alias("series_id"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.timestamp_seconds(F.col("id") * 3600 + 60).alias("available_at"), F.col("id").alias("tie"), F.col("id").alias("value"))
    folds = spark.createDataFrame([("a", 1, 360000), ("a", 2, 720000)], "series_id string, fold_id long, s long").select("series_id", "fold_id", F.timestamp_seconds("s").alias("as_of"))
    seen = fc.visible_at_folds(v, folds)
    assert {r.fold_id: r["count"] for r in seen.groupBy("fold_id").count().collect()} == {1: 100, 2: 200}
    assert all("_share" in x for x in seen._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [series_id" in x)


def test_documents_are_normalized_once(spark):
    """versions are kept once; what follows reads them, not the texts again."""
    for name in ("apply_reviews", "version_store"):
        assert "FileScan" not in Q[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
