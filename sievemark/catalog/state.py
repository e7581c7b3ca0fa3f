"""Queries over state: monitoring, leads, subscriptions, deliveries, entitlements, remediation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..operators import state
from ..plans import pageaudit
from ..scratch import written

HISTORY_SCHEMA = "session string, at string, url string, score int, readiness_state string, may_monitor boolean"
LEAD_SCHEMA = "ord int, email string, website_url string, readiness_score string, visibility_score string, understanding_score string, buyability_score string, audit_status string"
EVENT_SCHEMA = "ord int, event_id string, type string, subscription string, customer string, status string, lead_id string"
ACTION_SCHEMA = "title string, reason string, action_id string, category string"
KNOWN_LEADS = [
    ("l1", "a@x.test", "https://a.test/", "active", True, "sub1"), ("l2", "b@x.test", "https://b.test/", "past_due", True, "sub2"), ("l3", "c@x.test", "https://c.test/", "active", False, "sub3"),
    ("l4", "d@x.test", "https://d.test/", "active", True, None), ("l5", "c@x.test", "https://e.test/", None, False, None),
]
KNOWN_SCHEMA = "lead_id string, email string, website_url string, subscription_status string, price_locked boolean, subscription_id string"
NOW = 1_700_000_000
TOKENS = [("l1", "https://a.test/", NOW + 10), ("l1", "https://a.test/", NOW), ("l1", "https://other.test/", NOW + 10), ("l2", "https://b.test/", NOW + 10), ("l3", "https://c.test/", NOW + 10), ("l4", "https://d.test/", NOW + 10), ("l9", "https://a.test/", NOW + 10)]
TOKEN_SCHEMA = "lead_id string, website_url string, exp bigint"
CHECKOUTS = [(None, None, False, 5), ("l1", "active", True, 5), ("l2", "past_due", True, 5), ("l5", None, False, 0), ("l5", None, False, 2), ("l6", "canceled", None, 1)]
CHECKOUT_SCHEMA = "lead_id string, subscription_status string, price_locked boolean, slots_left int"
LEDGER = [("founder_welcome:l1:sub1", "failed"), ("founder_welcome:l2:sub2", "sent"), ("readiness_drop:7", "pending")]
WANTED = [("founder_welcome:l1:sub1",), ("founder_welcome:l2:sub2",), ("readiness_drop:7",), ("readiness_drop:8",), ("readiness_drop:8",)]


#: Rows of the state queries from the given tables, as SQL that Spark and the twins read alike; the cases written down come beside them.
LEAD_ROWS = (
    "SELECT CAST(o_orderkey + 1000 AS INT) AS ord, CASE WHEN o_orderkey % 7 = 0 THEN 'no at' WHEN o_orderkey % 13 = 0 THEN NULL ELSE concat(' Customer', o_custkey % 400, '@X.test') END AS email, "
    "CASE WHEN o_orderkey % 11 = 0 THEN 'http://10.0.0.8/' WHEN o_orderkey % 17 = 0 THEN 'ftp://x.test/' ELSE concat('https://s', o_custkey % 5, '.test/ ') END AS website_url, "
    "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN '12.5' ELSE concat('', o_orderkey % 130) END AS readiness_score, CAST(NULL AS STRING) AS visibility_score, CAST(NULL AS STRING) AS understanding_score, "
    "CAST(NULL AS STRING) AS buyability_score, CASE o_orderstatus WHEN 'F' THEN ' Complete' WHEN 'O' THEN 'limited' ELSE 'odd' END AS audit_status FROM orders"
)
EVENT_ROWS = (
    "SELECT CAST(event_id + 1000 AS INT) AS ord, concat('t', event_id - CASE WHEN event_id % 9 = 1 THEN 1 ELSE 0 END) AS event_id, CASE event_type WHEN 'error' THEN 'customer.subscription.deleted' WHEN 'purchase' THEN 'invoice.paid' "
    "WHEN 'click' THEN 'invoice.payment_failed' WHEN 'view' THEN 'customer.subscription.updated' ELSE 'checkout.session.completed' END AS type, CASE WHEN event_id % 29 = 0 THEN NULL ELSE concat('u', user_id) END AS subscription, "
    "concat('c', user_id % 10) AS customer, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'active' WHEN 2 THEN 'past_due' ELSE 'trialing' END AS status, CASE WHEN event_id % 6 = 0 THEN concat('l', user_id) END AS lead_id FROM events"
)
KNOWN_ROWS = (
    "SELECT concat('k', c_custkey) AS lead_id, concat('m', c_custkey - c_custkey % 3 * (c_custkey % 2), '@y.test') AS email, concat('https://k', c_custkey, '.test/') AS website_url, "
    "CASE WHEN c_acctbal > 2000 THEN 'active' WHEN c_acctbal > 0 THEN 'past_due' END AS subscription_status, c_custkey % 5 <> 0 AS price_locked, CASE WHEN c_custkey % 7 <> 0 THEN concat('u', c_custkey) END AS subscription_id FROM customer"
)
TOKEN_ROWS = "SELECT concat('k', o_custkey) AS lead_id, concat('https://k', o_custkey - CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END, '.test/') AS website_url, CAST({now} + o_orderkey % 5 - 2 AS BIGINT) AS exp FROM orders"
CHECKOUT_ROWS = (
    "SELECT CAST(c_custkey + 100 AS INT) AS id, CASE WHEN c_custkey % 9 <> 0 THEN concat('k', c_custkey) END AS lead_id, CASE WHEN c_acctbal > 4000 THEN 'active' WHEN c_acctbal > 0 THEN 'canceled' END AS subscription_status, "
    "CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS price_locked, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(c_custkey % 3 AS INT) END AS slots_left FROM customer"
)


def from_tables(spark: SparkSession, sf_dir: str, rows: str, cases: list[tuple], schema: str) -> DataFrame:
    """``rows`` of a given table after the cases written down."""
    table = rows.rsplit(" ", 1)[1]
    spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"given_{table}")
    return fixtures.table(spark, cases, schema).unionByName(spark.sql(f"{rows.removesuffix(table)}given_{table}"))


def _sql_rows(rows: str, cases: list[tuple], schema: str) -> str:
    return f"(SELECT * FROM {fixtures.values(cases, schema)} UNION ALL BY NAME ({rows}))"


def events_as_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user read as audits of a session: value as score, type as URL; an error is a limited audit."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    limited = F.col("event_type") == "error"
    return e.select(
        F.col("user_id").alias("session"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("url"), F.when(~limited, F.floor(F.least(F.col("value"), F.lit(100.0))).cast("int")).alias("score"),
        F.when(limited, "insufficient_evidence").otherwise("observed").alias("readiness_state"), F.lit(True).alias("may_monitor"), "event_id",
    )


def monitoring_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = state.monitoring(events_as_history(spark, sf_dir))
    return out.select(F.col("at.event_id").alias("event_id"), "score", "previous_score", "delta", "alert")


def monitoring_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = state.monitoring(events_as_history(spark, sf_dir))
    return out.groupBy("session").agg(F.count("*").alias("n_audits"), F.count_if("alert").alias("n_alerts"), F.sum("delta").cast("bigint").alias("net_change"))


def monitoring_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.table(spark, fixtures.HISTORY, HISTORY_SCHEMA)
    return state.monitoring(t).select("session", F.col("at").alias("audited_at"), "eligible", "previous_score", "delta", "alert")


def leads_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.validated_leads(from_tables(spark, sf_dir, LEAD_ROWS, fixtures.LEADS, LEAD_SCHEMA)).select("ord", "email", "website_url", "readiness_score", "audit_status", "reject")


def leads_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = state.validated_leads(from_tables(spark, sf_dir, LEAD_ROWS, fixtures.LEADS, LEAD_SCHEMA)).where("reject is null").drop("reject")
    return state.upserted(good)


def events_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table with a part of it delivered again: each event counts once, at its first delivery."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value", F.lit(0).alias("ord"))
    again = e.where("event_id % 7 = 0").withColumn("ord", F.lit(1)).withColumn("value", F.col("value") + 1000)
    once = state.deduplicated(e.unionByName(again))
    return once.groupBy("user_id").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 2).alias("total"))


def subscription_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.subscription_states(from_tables(spark, sf_dir, EVENT_ROWS, fixtures.EVENTS, EVENT_SCHEMA))


def subscription_fold_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a keyed fold: last type and running state per user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = F.struct("ts", "event_id")
    return e.groupBy("user_id").agg(F.max_by("event_type", last).alias("last_type"), F.count("*").alias("n_events"), F.max_by("event_id", last).alias("last_event"))


def email_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger, wanted = fixtures.table(spark, LEDGER, "delivery_key string, status string"), fixtures.table(spark, WANTED, "delivery_key string")
    due = state.reserve(ledger, wanted)
    return state.settled(ledger, due.withColumn("sent", F.col("delivery_key") != "readiness_drop:8"))


LIFE_SECONDS = 24 * 3600


def events_as_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as commands to a ledger: a user is a delivery key, an error a failure, a purchase a success, anything else asks to send."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    event = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "sent").otherwise("reserve")
    return e.select(F.col("user_id").cast("string").alias("delivery_key"), event.alias("event"), F.col("ts").alias("at"), F.col("event_id").alias("ord"))


def delivery_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = state.deliveries(events_as_deliveries(spark, sf_dir), life_seconds=LIFE_SECONDS)
    return out.select("delivery_key", "ord", "event", "granted", "status")


def welcome_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.welcome_deliveries(from_tables(spark, sf_dir, EVENT_ROWS, fixtures.EVENTS, EVENT_SCHEMA), from_tables(spark, sf_dir, KNOWN_ROWS, KNOWN_LEADS, KNOWN_SCHEMA))


def unique_lead_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = from_tables(spark, sf_dir, KNOWN_ROWS, KNOWN_LEADS, KNOWN_SCHEMA)
    asked = fixtures.table(spark, [("a@x.test",), ("c@x.test",), ("z@x.test",)], "email string").unionByName(leads.where("email LIKE '%@y.test'").select("email").distinct())
    return state.unique_matches(asked, leads, "email")


def entitlement_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.entitlements(from_tables(spark, sf_dir, TOKEN_ROWS.format(now=NOW), TOKENS, TOKEN_SCHEMA), from_tables(spark, sf_dir, KNOWN_ROWS, KNOWN_LEADS, KNOWN_SCHEMA), NOW)


def checkout_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = from_tables(spark, sf_dir, CHECKOUT_ROWS, [(i, *r) for i, r in enumerate(CHECKOUTS)], f"id int, {CHECKOUT_SCHEMA}")
    return t.select("id", state.checkout_state().alias("state"))


def signature_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib
    import hmac

    sign = lambda t, body, key="k": f"t={t},v1={hmac.new(key.encode(), f'{t}.{body}'.encode(), hashlib.sha256).hexdigest()}"
    rows = [(1, "{}", sign(NOW, "{}")), (2, "{}", sign(NOW - 301, "{}")), (3, "{}", sign(NOW, "{}", "other")), (4, "{}", None), (5, "{}", f"{sign(NOW, '{}')},v1=00"), (6, "{ }", sign(NOW, "{}"))]
    return state.signature_valid(fixtures.table(spark, rows, "id int, payload string, signature string"), "k", NOW).select("id", "valid")


def remediation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.table(spark, [(i, *r) for i, r in enumerate(fixtures.ACTIONS)], f"id int, {ACTION_SCHEMA}")
    return state.remediation(t).select("id", "meta_action", "meta_category")


def remediation_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do about the next actions of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    audits = pageaudit.inspect(pages)
    of_group = lambda g: F.transform(F.col("evidence")[g], lambda e: F.struct(e["label"].alias("label"), e["excerpt"].alias("excerpt")))
    by_group = F.create_map(*(x for g in audits.schema["evidence"].dataType.names for x in (F.lit(g), of_group(g))))
    # Both sides of the plan's join read the audits, so they are made once.
    audits = written(audits.select(F.col("page_id").alias("audit_id"), by_group.alias("evidence"), F.col("capabilities")["conversion"].alias("conversion"), "next_actions"), "audits")
    actions = audits.select("audit_id", F.posexplode("next_actions").alias("k", "a")).select("audit_id", "k", F.col("a.title").alias("title"), F.lit("observed").alias("reason"), F.lit(None).cast("string").alias("action_id"), F.lit(None).cast("string").alias("category"))
    out = state.remediation_plan(actions, audits.drop("next_actions"))
    return out.select("audit_id", "k", "title", "template", F.size("relevant").alias("n_relevant"), F.array_join("affected", ",").alias("affected"), "insufficient")


def recheck_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = spark.createDataFrame([(1, "Explain price or the quote process", None, None), (1, "State availability or timing", None, None), (2, "Add a clear commercial next step", None, None), (3, "Make the main offer explicit", None, None), (4, "Anything", None, "booking_path")], "audit_id int, title string, action_id string, category string")
    audits = spark.createDataFrame([(1, "complete", "full", "meaningful"), (2, "blocked", "blocked", "insufficient_evidence"), (4, "complete", "full", "meaningful")], "audit_id int, status string, acquisition string, score_status string")
    after = spark.createDataFrame([(1, "State availability or timing", None, None), (4, "Book it", None, None)], "audit_id int, title string, action_id string, category string")
    return state.recheck(first, audits, after)


QUERIES = {
    f.__name__: f
    for f in (
        monitoring_delta, monitoring_alerts, monitoring_cases, leads_validate, leads_upsert, events_dedup, subscription_fold, subscription_fold_events, email_ledger, delivery_ledger, welcome_due, unique_lead_match,
        entitlement_active, checkout_decision, signature_check, remediation_lookup, remediation_plans, recheck_state,
    )
}

V = fixtures.values
_HIST = """h AS (SELECT user_id AS session, ts, event_id, event_type AS url, CASE WHEN event_type <> 'error' THEN floor(least(value, 100.0))::INT END AS score FROM events),
m AS (SELECT *, lag(score) OVER w AS ps, lag(url) OVER w AS pu FROM h WINDOW w AS (PARTITION BY session ORDER BY ts, event_id)),
d AS (SELECT *, CASE WHEN score IS NOT NULL AND ps IS NOT NULL AND pu = url THEN ps END AS previous_score FROM m)"""
_LEADS = _sql_rows(LEAD_ROWS, fixtures.LEADS, LEAD_SCHEMA)
_VALID = rf"""v AS (SELECT ord, lower(trim(email)) AS email, trim(website_url) AS website_url, lower(trim(audit_status)) AS audit_status, readiness_score AS r, visibility_score AS vs, understanding_score AS us, buyability_score AS bs FROM {_LEADS}),
w AS (SELECT *, CASE WHEN NOT coalesce(regexp_full_match(email, '[^\s@]+@[^\s@]+\.[^\s@]+') AND length(email) <= 254, false) THEN 'email'
  WHEN NOT coalesce(regexp_matches(website_url, '^https?://') AND NOT regexp_matches(website_url, '://10\.'), false) THEN 'website_url' WHEN NOT coalesce(audit_status IN ('complete', 'limited', 'blocked'), false) THEN 'audit_status'
  WHEN r IS NOT NULL AND NOT coalesce(r::DOUBLE = floor(r::DOUBLE) AND r::DOUBLE BETWEEN 0 AND 100, false) THEN 'readiness_score' END AS reject FROM v)"""
_L = _sql_rows(KNOWN_ROWS, KNOWN_LEADS, KNOWN_SCHEMA)
_E = _sql_rows(EVENT_ROWS, fixtures.EVENTS, EVENT_SCHEMA)
_SUBS = "'customer.subscription.created', 'customer.subscription.updated', 'customer.subscription.deleted', 'invoice.paid', 'invoice.payment_failed'"

ORACLES = {
    "monitoring_delta": f"WITH {_HIST} SELECT event_id, score, previous_score, score - previous_score AS delta, score IS NOT NULL AND (score < 60 OR coalesce(score - previous_score < 0, false)) AS alert FROM d",
    "monitoring_alerts": f"""WITH {_HIST} SELECT session, count(*) AS n_audits, count(*) FILTER (score IS NOT NULL AND (score < 60 OR coalesce(score - previous_score < 0, false))) AS n_alerts,
  sum(score - previous_score)::BIGINT AS net_change FROM d GROUP BY 1""",
    "monitoring_cases": "SELECT * FROM " + V(
        [("a", "2024-01-01 10:00:00", True, None, None, False), ("a", "2024-01-02 10:00:00", True, 70, -6, True), ("a", "2024-01-03 10:00:00", False, None, None, False), ("a", "2024-01-04 10:00:00", True, None, None, False),
         ("a", "2024-01-05 10:00:00", True, None, None, True), ("a", "2024-01-06 10:00:00", False, None, None, False), ("b", "2024-01-01 09:00:00", True, None, None, False), ("b", "2024-01-09 09:00:00", True, 90, 5, False), ("c", "2024-02-01 00:00:00", True, None, None, True)],
        "session string, audited_at string, eligible boolean, previous_score int, delta int, alert boolean",
    ),
    "leads_validate": f"WITH {_VALID} SELECT ord, email, website_url, CASE WHEN coalesce(r::DOUBLE = floor(r::DOUBLE) AND r::DOUBLE BETWEEN 0 AND 100, false) THEN r::DOUBLE::INT END AS readiness_score, audit_status, reject FROM w",
    "leads_upsert": f"""WITH {_VALID} SELECT ord, email, website_url, r::INT AS readiness_score, vs::INT AS visibility_score, us::INT AS understanding_score, bs::INT AS buyability_score, audit_status
FROM (SELECT *, row_number() OVER (PARTITION BY email, website_url ORDER BY ord DESC) AS n FROM w WHERE reject IS NULL) WHERE n = 1""",
    "events_dedup": "SELECT user_id, count(*) AS n_events, round(sum(value), 2) AS total FROM events GROUP BY 1",
    "subscription_fold": f"""WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ord) AS n FROM {_E}) WHERE n = 1 AND subscription IS NOT NULL),
l AS (SELECT *, last_value(lead_id IGNORE NULLS) OVER (PARTITION BY subscription ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lead FROM o),
t AS (SELECT *, CASE type WHEN 'invoice.paid' THEN 'active' WHEN 'customer.subscription.deleted' THEN coalesce(status, 'canceled') ELSE status END AS s FROM l WHERE type IN ({_SUBS}) AND (type <> 'invoice.paid' OR lead IS NOT NULL))
SELECT subscription, arg_max(s, ord) AS status, arg_max(customer, ord) AS customer, arg_max(lead, ord) AS lead_id FROM t WHERE s IS NOT NULL GROUP BY 1""",
    "subscription_fold_events": """SELECT user_id, event_type AS last_type, n AS n_events, event_id AS last_event FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r = 1""",
    "email_ledger": "SELECT * FROM " + V([("founder_welcome:l1:sub1", "sent"), ("founder_welcome:l2:sub2", "sent"), ("readiness_drop:7", "pending"), ("readiness_drop:8", "failed")], "delivery_key string, status string"),
    # A fold over each key's events in order, one at a time: [last time, last event, status, ...] with what every event got.
    "delivery_ledger": f"""WITH e AS (SELECT user_id::VARCHAR AS k, epoch_us(ts) AS us, event_id AS ord, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'sent' ELSE 'reserve' END AS event FROM events),
l AS (SELECT k, list({{'us': us, 'ord': ord, 'event': event, 'granted': NULL::BOOLEAN, 'status': NULL::VARCHAR}} ORDER BY us, ord) AS es FROM e GROUP BY k),
f AS (SELECT k, list_reduce(list_transform(es, lambda x: [x]), lambda a, b: list_append(a, {{'us': b[1].us, 'ord': b[1].ord, 'event': b[1].event,
    'granted': CASE WHEN b[1].event = 'reserve' THEN b[1].us - a[-1].us > {LIFE_SECONDS * 1_000_000} OR a[-1].status IS NULL OR a[-1].event = 'failed' END,
    'status': CASE WHEN b[1].us - a[-1].us > {LIFE_SECONDS * 1_000_000} OR a[-1].status IS NULL THEN CASE WHEN b[1].event = 'reserve' THEN 'pending' END
      WHEN b[1].event <> 'reserve' THEN b[1].event WHEN a[-1].event = 'failed' THEN 'pending' ELSE a[-1].status END}}),
    [{{'us': -{LIFE_SECONDS * 1_000_000 * 2}, 'ord': -1::BIGINT, 'event': '', 'granted': NULL::BOOLEAN, 'status': NULL::VARCHAR}}]) AS es FROM l)
SELECT k AS delivery_key, x.ord AS ord, x.event AS event, x.granted AS granted, x.status AS status FROM (SELECT k, unnest(es) AS x FROM f) WHERE x.ord >= 0 AND x.status IS NOT NULL""",
    "welcome_due": f"""SELECT DISTINCT 'founder_welcome:' || l.lead_id || ':' || subscription_id AS delivery_key, l.lead_id FROM {_L} l JOIN {_E} e ON e.subscription = l.subscription_id
WHERE subscription_status = 'active' AND price_locked AND type IN ('invoice.paid', 'customer.subscription.created', 'customer.subscription.updated')""",
    "unique_lead_match": f"SELECT email, min(lead_id) AS lead_id FROM {_L} WHERE email IN ('a@x.test', 'c@x.test', 'z@x.test') OR email LIKE '%@y.test' GROUP BY email HAVING count(*) = 1",
    "entitlement_active": f"""SELECT t.lead_id, t.website_url, t.exp, coalesce(t.exp > {NOW} AND l.website_url = t.website_url AND subscription_status = 'active' AND price_locked AND subscription_id <> '', false) AS active
FROM {_sql_rows(TOKEN_ROWS.format(now=NOW), TOKENS, TOKEN_SCHEMA)} t LEFT JOIN {_L} l ON t.lead_id = l.lead_id""",
    "checkout_decision": f"""SELECT id, CASE WHEN lead_id IS NULL THEN 'lead_missing' WHEN subscription_status = 'active' THEN 'already_active' WHEN coalesce(price_locked, false) THEN 'ineligible'
  WHEN coalesce(slots_left, 0) <= 0 THEN 'exhausted' ELSE 'checkout' END AS state FROM {_sql_rows(CHECKOUT_ROWS, [(i, *r) for i, r in enumerate(CHECKOUTS)], "id int, " + CHECKOUT_SCHEMA)}""",
    "remediation_lookup": "SELECT * FROM " + V(
        [(0, "commercial_accessibility", "buyability"), (1, "pricing", "missing_or_unclear_pricing"), (2, "cta", "weak_commercial_next_step"), (3, "availability", "commercial_availability"), (4, "offer", "offer_detail"),
         (5, "unknown", "unknown"), (6, "schema", "structured_data"), (7, "booking", "booking_path"), (8, "commercial_accessibility", "buyability"), (9, "booking", "booking_path")],
        "id int, meta_action string, meta_category string",
    ),
    "recheck_state": "SELECT * FROM " + V([(1, "Explain price or the quote process", "RESOLVED"), (1, "State availability or timing", "STILL_DETECTED"), (2, "Add a clear commercial next step", "INSUFFICIENT_EVIDENCE"), (3, "Make the main offer explicit", "INSUFFICIENT_EVIDENCE"), (4, "Anything", "STILL_DETECTED")], "audit_id int, title string, state string"),
}
