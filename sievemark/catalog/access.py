"""Queries over access and billing: identities, codes, payment links, activation, tokens, gated reports, semantic answers. Rows follow fixed
arithmetic rules, so that every branch is met."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..operators import access, state
from ..plans import pageaudit
from .pages import ORACLES as PAGE_ORACLES
from .pages import all_pages
from .state import NOW, _sql_rows, from_tables

SECRET = "k" * 40
PRICE, LINK = "price_1", "plink_1"

IDENTITIES = [
    (i, e, u) for i, (e, u) in enumerate((e, u) for e in (" A@B.test ", "a@b", "", None, "x" * 250 + "@b.test", "ok@c.test") for u in ("https://Site.test/a", "site.test", "", None, "https://localhost/", "https://s.test/" + "p" * 2048))
]
IDENTITY_SCHEMA = "id int, email string, website_url string"
RENDERS = [(i, s, h, o, t, x) for i, (s, h, o, t, x) in enumerate((s, h, o, t, x) for s in (True, False) for h in (200, 403, 429, 500, None) for o in (True, False, None) for t in ("<p>x</p>", " ", None) for x in (False, True))]
RENDER_SCHEMA = "id int, safe boolean, http_status int, success boolean, html string, timed_out boolean"
REQUESTS = [(i, *r) for i, r in enumerate((m, d, b, v, c, k) for m in ("POST", "GET") for d in (10, 9000, None) for b in ("{}", "{", None, "[" + "1," * 5000 + "1]") for v in (True, False) for c in (True, None) for k in (True, False))]
REQUEST_SCHEMA = "id int, method string, declared int, body string, valid boolean, created boolean, conflict boolean"
FAILURES = [(i, s, e, c) for i, (s, e, c) in enumerate((s, e, c) for s in (401, 403, 404, 422, 500, 302, None) for e in ("TypeError", "Error", None) for c in (True, False))]
FAILURE_SCHEMA = "id int, status int, error string, has_cause boolean"
VISITS = [(i, e, v) for i, (e, v) in enumerate((e, v) for e in ("audit_completed", "checkout_started", "lead_submitted", None) for v in (True, False, None))]
VISIT_SCHEMA = "id int, event string, submitted boolean"
LEADS = [(f"l{i:02d}", f"{'ABCDEF'[i % 6]}{i // 9}@x.test ", f"https://s{i}.test/", (None, "active", "past_due", "active")[i % 4], (True, False, None)[i % 3], None if i % 5 == 0 else f"sub{i % 11}", None) for i in range(40)]
LEAD_SCHEMA = "lead_id string, email string, website_url string, subscription_status string, price_locked boolean, subscription_id string, customer_id string"
SUBSCRIPTIONS = [(f"sub{i}", ("founder", "other", None)[i % 3], None if i % 7 == 3 else ("" if i % 7 == 5 else f"l{i:02d}"), (["price_1"], ["price_2", "price_1"], ["price_2"], [])[i % 4]) for i in range(30)]
SUBSCRIPTION_SCHEMA = "subscription string, offer string, lead_id string, prices array<string>"
SESSIONS = [
    (f"cs_{i}" if i % 13 else f"x-{i}", ("subscription", "subscription", "payment")[i % 3], (LINK, LINK, "plink_2", None)[i % 4], f" {'abcdef'[i % 6]}{i // 9 % 5}@X.test" if i % 5 else "", f"{'abcdef'[i % 6]}{i % 5}@x.test", None if i % 11 == 4 else f"cus{i}",
     None if i % 17 == 5 else f"sub{i % 11}", f"l{i % 40:02d}", ("paid", "paid", "unpaid")[i // 2 % 3], ("active", "active", "incomplete")[i // 3 % 3])
    for i in range(120)
]
SESSION_SCHEMA = "session_id string, mode string, payment_link string, details_email string, customer_email string, customer string, subscription string, lead_id string, payment_status string, subscription_state string"
STATES = [(f"sub{i}", ("active", "past_due", None)[i % 3]) for i in range(9)]
STATE_SCHEMA = "subscription string, status string"
ACTIVATIONS = [(f"l{i:02d}", f"cus{i}" if i % 2 else None, f"sub{i}", ("active", "canceled", "active")[i % 3]) for i in range(0, 40, 2)] + [("l99", "c", "s", "active")]
ACTIVATION_SCHEMA = "lead_id string, customer string, subscription string, status string"
GATES = [(f"v{i}", ("https://a.test/", "https://b.test/", "a.test", None)[i % 4]) for i in range(12)]
ENTITLED = [(f"v{i}", ("https://a.test/", "https://b.test/")[i // 4 % 2], i % 3 != 0) for i in range(10)] + [("v1", "https://b.test/", True)]
_GOOD = '{"classification": "%s", "accept": %s, "related_offer": %s, "confidence": %s, "justification": "%s"}'
ANSWERS = [
    (i, _GOOD % a) for i, a in enumerate((c, a, r, n, j) for c in ("product", "nonsense", "legal") for a in ("true", "1", "null") for r in ("null", '"Lamp"', "3") for n in ("0.5", "1", "1.5", "-0.1", '"0.5"', "true") for j in (" fits ", "  "))
] + [(900, "{}"), (901, None), (902, "not json"), (903, _GOOD[:-1] % ("product", "true", "null", "1", "x") + ', "more": 1}'), (904, "[]"), (905, '{"classification": "product", "accept": true, "confidence": 1, "justification": "x"}')]

#: The same from the given tables, as SQL that Spark and the twins read alike; they come after the rows above.
IDENTITY_ROWS = (
    "SELECT CAST(c_custkey + 100 AS INT) AS id, CASE c_custkey % 6 WHEN 0 THEN concat(' M', c_custkey, '@B.test ') WHEN 1 THEN 'a@b' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE concat('c', c_custkey, '@d.test') END AS email, "
    "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'https://localhost/' ELSE concat('https://s', c_nationkey, '.test/', c_custkey) END AS website_url FROM customer"
)
VISIT_ROWS = "SELECT CAST(event_id + 100 AS INT) AS id, CASE event_type WHEN 'error' THEN NULL WHEN 'purchase' THEN 'checkout_started' WHEN 'view' THEN 'audit_completed' ELSE event_type END AS event, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS submitted FROM events"
RENDER_ROWS = (
    "SELECT CAST(event_id + 1000 AS INT) AS id, event_id % 7 <> 0 AS safe, CAST(CASE event_id % 5 WHEN 0 THEN 403 WHEN 1 THEN 429 WHEN 2 THEN 500 WHEN 3 THEN NULL ELSE 200 END AS INT) AS http_status, "
    "CASE user_id % 3 WHEN 0 THEN false WHEN 1 THEN true END AS success, CASE WHEN event_id % 11 = 0 THEN ' ' WHEN event_id % 13 = 0 THEN NULL ELSE props END AS html, event_id % 17 = 0 AS timed_out FROM events"
)
REQUEST_ROWS = (
    "SELECT CAST(o_orderkey + 1000 AS INT) AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'GET' ELSE 'POST' END AS method, CAST(CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 9000 ELSE 100 END AS INT) AS declared, "
    "CASE o_orderkey % 5 WHEN 0 THEN '{' WHEN 1 THEN NULL ELSE concat('{\"k\":', o_orderkey, '}') END AS body, o_custkey % 3 <> 0 AS valid, CASE WHEN o_custkey % 2 = 0 THEN true END AS created, o_orderstatus = 'P' AS conflict FROM orders"
)
FAILURE_ROWS = (
    "SELECT CAST(o_orderkey + 1000 AS INT) AS id, CAST(CASE o_custkey % 8 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 404 WHEN 3 THEN 422 WHEN 4 THEN 500 WHEN 5 THEN 302 END AS INT) AS status, "
    "CASE o_orderstatus WHEN 'F' THEN 'TypeError' WHEN 'O' THEN 'Error' END AS error, o_orderkey % 2 = 0 AS has_cause FROM orders"
)


def _t(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return fixtures.table(spark, rows, schema)


def lead_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would be stored if someone left an address at each audited page."""
    audits = pageaudit.inspect(all_pages(spark, sf_dir))
    return state.lead_payload(audits, F.concat(F.lit(" Reader"), F.col("page_id").cast("string"), F.lit("@X.test ")), "page_id")


def checkout_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.checkout_identity(from_tables(spark, sf_dir, IDENTITY_ROWS, IDENTITIES, IDENTITY_SCHEMA)).select("id", "email", "reject", F.col("website_url").isNull().alias("no_url"))


def visit_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = from_tables(spark, sf_dir, VISIT_ROWS, VISITS, VISIT_SCHEMA)
    return t.select("id", access.report_access(F.col("submitted")).alias("a"), access.conversion_measure(F.col("event")).alias("measure"), access.confirmed(F.col("submitted"), F.col("event") == "checkout_started").alias("confirmed")).select("id", "a.*", "measure", "confirmed")


def renderer_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_tables(spark, sf_dir, RENDER_ROWS, RENDERS, RENDER_SCHEMA).select("id", access.renderer_status(*map(F.col, ("safe", "http_status", "success", "html", "timed_out"))).alias("status"))


def request_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return from_tables(spark, sf_dir, REQUEST_ROWS, REQUESTS, REQUEST_SCHEMA).select("id", access.request_code(c("method"), "POST", c("declared"), c("body"), c("valid"), c("created"), c("conflict")).alias("code"))


def failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_tables(spark, sf_dir, FAILURE_ROWS, FAILURES, FAILURE_SCHEMA).select("id", access.failure_kind(*map(F.col, ("status", "error", "has_cause"))).alias("kind"))


def subscription_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, SUBSCRIPTIONS, SUBSCRIPTION_SCHEMA).select("subscription", access.subscription_lead(PRICE).alias("lead_id"))


def payment_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.linked_payments(_t(spark, SESSIONS, SESSION_SCHEMA), _t(spark, LEADS, LEAD_SCHEMA), _t(spark, STATES, STATE_SCHEMA), LINK)


def lead_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.activated(_t(spark, LEADS, LEAD_SCHEMA), _t(spark, ACTIVATIONS, ACTIVATION_SCHEMA)).select("lead_id", "customer_id", "subscription_id", "subscription_status", "price_locked", "onboarding_ready")


def checkout_activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.checkout_activation(_t(spark, SESSIONS, SESSION_SCHEMA), _t(spark, LEADS, LEAD_SCHEMA))


def lead_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patched leads with the time of the write."""
    patch = _t(spark, [(f"l{i:02d}", None if i % 4 else "canceled") for i in range(0, 50, 5)], "lead_id string, subscription_status string")
    out = access.touched(_t(spark, LEADS, LEAD_SCHEMA), patch, "lead_id", F.timestamp_seconds(F.lit(NOW)))
    return out.select("lead_id", "subscription_status", F.unix_timestamp("updated_at").alias("updated"))


def drop_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries due for scores that fell, over the event table read as a history of audits."""
    from .state import events_as_history

    audits = state.monitoring(events_as_history(spark, sf_dir)).select(F.col("at.event_id").alias("audit_id"), F.when(F.col("session") % 5 > 0, F.col("session")).alias("lead_id"), "delta")
    return state.drop_deliveries(audits)


def entitlement_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed tokens of all leads; what is read back of them, of expired, foreign and bent ones."""
    t = _t(spark, LEADS, LEAD_SCHEMA).select("lead_id", "website_url")
    made = access.entitlement_token(F.col("lead_id"), F.col("website_url"), NOW, SECRET)
    read = lambda token, at=NOW: access.token_body(token, at, SECRET)["lead_id"]
    other = access.entitlement_token(F.col("lead_id"), F.col("website_url"), NOW, "z" * 40)
    return t.select("lead_id", F.element_at(F.split(made, r"\."), 2).alias("signature"), read(made).alias("known"), read(made, NOW + state.TOKEN_SECONDS).alias("expired"), read(other).alias("foreign"), read(F.concat(F.lit("x"), made)).alias("bent"), read(F.lit("")).alias("empty"))


def gated_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.report_visible(_t(spark, GATES, "session string, url string"), _t(spark, ENTITLED, "session string, website_url string, active boolean"))


def semantic_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, ANSWERS, "id int, answer string").select("id", access.semantic_decision(F.col("answer")).alias("d")).select("id", F.col("d").isNotNull().alias("valid"), "d.classification", "d.accept", "d.related_offer", "d.confidence", "d.justification")


QUERIES = {
    f.__name__: f
    for f in (
        lead_payloads, checkout_identities, visit_states, renderer_codes, request_codes, failure_kinds, subscription_leads, payment_links, lead_activation, checkout_activations, lead_updates, drop_notices,
        entitlement_tokens, gated_reports, semantic_answers,
    )
}

V = fixtures.values
_L, _S = V(LEADS, LEAD_SCHEMA), V(SESSIONS, SESSION_SCHEMA)


def _hmac_sql(secret: str, message: str) -> str:
    blob = lambda x: "'" + "".join(f"\\x{b ^ x:02x}" for b in secret.encode().ljust(64, b"\0")) + "'::BLOB"
    return f"unhex(sha256({blob(0x5C)} || unhex(sha256({blob(0x36)} || encode({message})))))"


_B64 = "rtrim(translate(base64({}), '+/', '-_'), '=')"
_BODY = _B64.format(f"""encode('{{"lead_id":"' || lead_id || '","website_url":"' || website_url || '","exp":{NOW + state.TOKEN_SECONDS}}}')""")

ORACLES = {
    "lead_payloads": f"""SELECT 'reader' || page_id || '@x.test' AS email, trim(url) AS website_url, observed_readiness AS readiness_score, visibility AS visibility_score, understanding AS understanding_score, buyability AS buyability_score, status AS audit_status, page_id
FROM ({PAGE_ORACLES["page_audit_scores"]}) s JOIN (SELECT page_id, url FROM pages UNION ALL SELECT page_id, url FROM {V(fixtures.PAGES, "page_id bigint, url string, html string")}) USING (page_id)""",
    "checkout_identities": rf"""SELECT id, email, CASE WHEN NOT good THEN 'email' WHEN NOT safe THEN 'website_url' END AS reject, NOT safe AS no_url FROM (SELECT id, lower(trim(email)) AS email,
  coalesce(length(trim(email)) <= 254 AND regexp_full_match(lower(trim(email)), '[^\s@]+@[^\s@]+\.[^\s@]+'), false) AS good, coalesce(website_url <> '' AND length(website_url) <= 2048 AND website_url LIKE '%://%' AND website_url NOT LIKE '%localhost%', false) AS safe FROM {_sql_rows(IDENTITY_ROWS, IDENTITIES, IDENTITY_SCHEMA)})""",
    "visit_states": f"""SELECT id, submitted IS NOT TRUE AS full_report_hidden, submitted IS NOT TRUE AS founder_offer_hidden, CASE event WHEN 'audit_completed' THEN 'custom' WHEN 'checkout_started' THEN 'contents' END AS measure,
  coalesce(submitted AND event = 'checkout_started', false) AS confirmed FROM {_sql_rows(VISIT_ROWS, VISITS, VISIT_SCHEMA)}""",
    "renderer_codes": f"""SELECT id, CASE WHEN NOT safe OR coalesce(http_status IN (401, 403, 429, 451), false) THEN 'blocked' WHEN timed_out THEN 'timeout' WHEN http_status IS NULL THEN 'unavailable'
  WHEN http_status // 100 <> 2 OR success IS NOT TRUE OR coalesce(trim(html), '') = '' THEN 'failed' ELSE 'success' END AS status FROM {_sql_rows(RENDER_ROWS, RENDERS, RENDER_SCHEMA)}""",
    "request_codes": f"""SELECT id, CASE WHEN method <> 'POST' THEN 405 WHEN coalesce(declared, 0) > 8192 OR coalesce(strlen(body), 0) > 8192 THEN 413 WHEN body IS NULL OR NOT json_valid(body) OR NOT valid THEN 400 WHEN conflict THEN 409
  WHEN created IS TRUE THEN 201 ELSE 200 END AS code FROM {_sql_rows(REQUEST_ROWS, REQUESTS, REQUEST_SCHEMA)}""",
    "failure_kinds": f"""SELECT id, CASE WHEN status = 401 THEN 'authentication' WHEN status = 403 THEN 'authorization' WHEN status BETWEEN 400 AND 499 THEN 'validation' WHEN status IS NOT NULL THEN 'upstream'
  WHEN error = 'TypeError' AND NOT has_cause THEN 'request_setup' ELSE 'network' END AS kind FROM {_sql_rows(FAILURE_ROWS, FAILURES, FAILURE_SCHEMA)}""",
    "subscription_leads": f"SELECT subscription, CASE WHEN coalesce(offer = 'founder', false) OR list_contains(prices, '{PRICE}') THEN nullif(lead_id, '') END AS lead_id FROM {V(SUBSCRIPTIONS, SUBSCRIPTION_SCHEMA)}",
    "payment_links": f"""WITH s AS (SELECT *, lower(trim(CASE WHEN coalesce(details_email, '') <> '' THEN details_email ELSE customer_email END)) AS mail FROM {_S} WHERE mode = 'subscription' AND payment_link = '{LINK}' AND customer IS NOT NULL AND subscription IS NOT NULL),
l AS (SELECT lower(trim(email)) AS mail, min(lead_id) AS lead_id, min(subscription_id) AS has, min(subscription_status) AS status FROM {_L} GROUP BY 1 HAVING count(*) = 1)
SELECT session_id, l.lead_id, customer, s.subscription, coalesce(l.status, 'pending') AS subscription_status, coalesce(t.status = 'active', false) AS activate
FROM s JOIN l USING (mail) LEFT JOIN {V(STATES, STATE_SCHEMA)} t ON t.subscription = s.subscription WHERE has IS NULL OR has = s.subscription""",
    "lead_activation": f"""SELECT l.lead_id, coalesce(a.customer, customer_id) AS customer_id, coalesce(a.subscription, subscription_id) AS subscription_id, coalesce(a.status, subscription_status) AS subscription_status,
  coalesce(price_locked, false) OR coalesce(a.status = 'active', false) AS price_locked, coalesce(a.status = 'active', false) AND NOT (coalesce(subscription_status = 'active', false) AND coalesce(price_locked, false)) AS onboarding_ready
FROM {_L} l LEFT JOIN {V(ACTIVATIONS, ACTIVATION_SCHEMA)} a USING (lead_id)""",
    "checkout_activations": f"""SELECT session_id, CASE WHEN NOT regexp_full_match(session_id, 'cs_[A-Za-z0-9_]+') THEN 'invalid'
  WHEN coalesce(mode = 'subscription' AND payment_status = 'paid' AND subscription_state = 'active' AND subscription_id = subscription AND subscription_status = 'active' AND price_locked, false) THEN 'active' ELSE 'pending' END AS state
FROM {_S} LEFT JOIN {_L} USING (lead_id)""",
    "lead_updates": f"""SELECT lead_id, CASE WHEN k % 20 = 0 THEN 'canceled' ELSE subscription_status END AS subscription_status, CASE WHEN k % 5 = 0 THEN {NOW} END::BIGINT AS updated FROM (SELECT *, substr(lead_id, 2)::INT AS k FROM {_L})""",
    "drop_notices": """WITH h AS (SELECT user_id, ts, event_id, event_type AS url, CASE WHEN event_type <> 'error' THEN floor(least(value, 100.0))::INT END AS score FROM events),
m AS (SELECT *, lag(score) OVER w AS ps, lag(url) OVER w AS pu FROM h WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT 'readiness_drop:' || event_id AS delivery_key, user_id AS lead_id FROM m WHERE score < ps AND pu = url AND user_id % 5 > 0""",
    "entitlement_tokens": f"""SELECT lead_id, {_B64.format(_hmac_sql(SECRET, _BODY))} AS signature, lead_id AS known, NULL::VARCHAR AS expired, NULL::VARCHAR AS foreign, NULL::VARCHAR AS bent, NULL::VARCHAR AS empty FROM {_L}""",
    "gated_reports": f"""SELECT session, url, coalesce(CASE WHEN url LIKE 'http%' THEN url WHEN url IS NOT NULL THEN 'https://' || url END IN (SELECT e.website_url FROM {V(ENTITLED, "session string, website_url string, active boolean")} e WHERE e.active AND e.session = g.session), false) AS visible
FROM {V(GATES, "session string, url string")} g""",
    "semantic_answers": f"""WITH a AS (SELECT id, CASE WHEN json_valid(answer) THEN answer END AS j FROM {V(ANSWERS, "id int, answer string")}),
t AS (SELECT *, list_sort(json_keys(j)) AS k, json_type(j, '$.confidence') AS ct, trim(j->>'$.justification') AS said FROM a),
v AS (SELECT *, coalesce(k = [{", ".join(f"'{x}'" for x in access.ANSWER_KEYS)}] AND j->>'$.classification' IN ({", ".join(f"'{x}'" for x in access.CLASSES)}) AND json_type(j, '$.accept') = 'BOOLEAN'
  AND CASE WHEN ct = 'BOOLEAN' THEN true WHEN ct IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN (j->>'$.confidence')::DOUBLE BETWEEN 0 AND 1 ELSE false END AND json_type(j, '$.related_offer') IN ('VARCHAR', 'NULL') AND json_type(j, '$.justification') = 'VARCHAR' AND said <> '', false) AS valid FROM t)
SELECT id, valid, CASE WHEN valid THEN j->>'$.classification' END AS classification, CASE WHEN valid THEN (j->>'$.accept')::BOOLEAN END AS accept, CASE WHEN valid THEN j->>'$.related_offer' END AS related_offer,
  CASE WHEN valid THEN CASE WHEN ct = 'BOOLEAN' THEN (j->>'$.confidence')::BOOLEAN::INT ELSE (j->>'$.confidence')::DOUBLE END END::DOUBLE AS confidence, CASE WHEN valid THEN said END AS justification FROM v""",
}
