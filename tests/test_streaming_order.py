"""Streams in any split and order of rows within the watermark against their batch twins; state that leaves in time."""

import random

import pytest
from pyspark.sql import functions as F

from sievemark import fixtures
from sievemark.catalog import state as catalog
from sievemark.operators import state
from sievemark.streaming import stateful

SF = "/root/testdata/sf0.001"
END = 4_000_000_000


def streamed(spark, tmp_path, rows, ddl, make, seed, files=4, delay="36500 days", key="session"):
    """What ``make`` gives of ``rows`` in shuffled files, one a batch, then of a row far ahead that moves the watermark past all."""
    rng = random.Random(seed)
    rows = rows[:]
    rng.shuffle(rows)
    folder = tmp_path / f"in{seed}"
    for k in range(files):
        spark.createDataFrame(rows[k::files], ddl).coalesce(1).write.mode("append").parquet(str(folder / f"part{k}"))
    schema = spark.createDataFrame([], ddl).schema
    last = {key: "~end", "at": END + 40_000_000_000}
    end = spark.createDataFrame([tuple(last.get(f.name) for f in schema)], ddl.replace("at timestamp", "at bigint")).withColumn("at", F.timestamp_seconds("at"))
    end.coalesce(1).write.parquet(str(folder / "part9"))
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "part*")).withWatermark("at", delay)
    name = f"out{seed}{abs(hash(str(tmp_path)))}"
    q = make(live).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.table(name).where(F.col(key) != "~end"), q


@pytest.mark.parametrize("seed", [1, 2])
def test_monitoring_in_any_order(spark, tmp_path, seed):
    e = catalog.events_as_history(spark, SF).where("session < 12").select(F.col("session").cast("string").alias("session"), F.col("at.ts").cast("timestamp").alias("at"), F.col("event_id").alias("ord"), "url", "score", "readiness_state", "may_monitor")
    ddl = "session string, at timestamp, ord bigint, url string, score int, readiness_state string, may_monitor boolean"
    rows = [tuple(r) for r in e.collect()]
    out, _ = streamed(spark, tmp_path, rows, ddl, lambda s: stateful.monitoring(s, tie="ord"), seed)
    want = state.monitoring(spark.createDataFrame(rows, ddl).withColumn("at", F.struct("at", "ord")))
    key = lambda r, at, o: repr((r.session, at, o, r.url, r.score, r.eligible, r.previous_score, r.delta, r.alert))
    assert sorted(key(r, r["at"], r.tie) for r in out.collect()) == sorted(key(r, r["at"]["at"], r["at"]["ord"]) for r in want.collect()) and rows


def test_subscriptions_in_any_order(spark, tmp_path):
    events = state.deduplicated(fixtures.table(spark, fixtures.EVENTS, catalog.EVENT_SCHEMA)).where("subscription is not null")
    rows = [(*r, None) for r in events.collect()]
    from datetime import datetime, timedelta

    rows = [(*r[:-1], datetime(2024, 1, 1) + timedelta(hours=r[0])) for r in rows]
    out, _ = streamed(spark, tmp_path, rows, f"{catalog.EVENT_SCHEMA}, at timestamp", stateful.subscription_states, 3, key="subscription")
    last = {}
    for r in sorted(out.collect(), key=lambda r: r.place):
        last[r.subscription] = (r.status, r.customer, r.lead_id)
    assert last == {r.subscription: (r.status, r.customer, r.lead_id) for r in state.subscription_states(events).collect()} and last


def test_deliveries_in_any_order(spark, tmp_path):
    from datetime import datetime, timedelta

    rng = random.Random(7)
    rows = [(f"k{rng.randrange(12)}", rng.choice(["reserve", "reserve", "failed", "sent"]), datetime(2024, 1, 1) + timedelta(hours=rng.randrange(24 * 150)), n) for n in range(400)]
    ddl = "delivery_key string, event string, at timestamp, ord bigint"
    out, q = streamed(spark, tmp_path, rows, ddl, stateful.deliveries, 4, key="delivery_key")
    want = state.deliveries(spark.createDataFrame(rows, ddl))
    got = sorted(map(repr, (tuple(r) for r in out.collect())))
    assert got == sorted(repr(tuple(r)) for r in want.collect())
    assert {r.granted for r in want.collect()} == {True, False, None}
    # After their lives all keys have left the state; the row that moved the watermark is alone.
    assert sum(s.numRowsTotal for s in q.lastProgress.stateOperators) < 12 or q.lastProgress["stateOperators"][0]["numRowsTotal"] < 12


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    from datetime import datetime

    ddl = "delivery_key string, event string, at timestamp, ord bigint"
    folder = tmp_path / "late"
    for k, (day, event) in enumerate([(1, "reserve"), (20, "reserve"), (21, "reserve"), (2, "failed")]):
        spark.createDataFrame([("k" if k in (0, 3) else f"other{k}", event, datetime(2024, 1, day), k)], ddl).coalesce(1).write.parquet(str(folder / f"part{k}"))
    live = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(folder / "part*")).withWatermark("at", "1 day")
    q = stateful.deliveries(live).writeStream.format("memory").queryName("late_rows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert [(r.event, r.status) for r in spark.table("late_rows").where("delivery_key = 'k'").collect()] == [("reserve", "pending")]
    assert sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"]) == 1


def test_entitlements_follow_leads_and_expire(spark, tmp_path):
    from datetime import datetime, timezone

    rng = random.Random(9)
    at = lambda s: datetime.fromtimestamp(s, timezone.utc).replace(tzinfo=None)
    rows, base = [], 1_700_000_000
    for n in range(200):
        lead, t = f"l{rng.randrange(8)}", base + rng.randrange(100_000)
        if rng.random() < 0.5:
            rows.append((lead, at(t), n, f"https://{rng.randrange(2)}.test/", None, rng.choice(["active", "active", "past_due"]), rng.random() < 0.8, rng.choice(["s1", "s1", None])))
        else:
            rows.append((lead, at(t), n, f"https://{rng.randrange(2)}.test/", t + rng.choice([10, 60_000, 200_000]), None, None, None))
    ddl = "lead_id string, at timestamp, ord bigint, website_url string, exp bigint, subscription_status string, price_locked boolean, subscription_id string"
    out, q = streamed(spark, tmp_path, rows, ddl, stateful.entitlements, 5, key="lead_id")
    changes = sorted(out.collect(), key=lambda r: r["at"])
    for now in (base + 50_000, base + 120_000, base + 1_000_000):
        seen = [r for r in rows if r[1] <= at(now)]
        leads = {}
        for r in sorted(seen, key=lambda r: (r[1], r[2])):
            if r[4] is None:
                leads[r[0]] = (r[0], r[3], r[5], r[6], r[7])
        tokens = {(r[0], r[3], r[4]) for r in seen if r[4] is not None}
        known = spark.createDataFrame(list(leads.values()), "lead_id string, website_url string, subscription_status string, price_locked boolean, subscription_id string")
        want = {(r.lead_id, r.website_url, r.exp): r.active for r in state.entitlements(spark.createDataFrame(list(tokens), "lead_id string, website_url string, exp bigint"), known, now).collect()}
        got = {}
        for r in changes:
            if r["at"] <= at(now):
                got[(r.lead_id, r.website_url, r.exp)] = r.active
        assert got == want
    assert not any(got.values())
