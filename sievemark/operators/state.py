"""State over time: monitoring of scores, leads, subscriptions, deliveries, entitlements, remediation. Batch forms; the streaming
forms in ``streaming`` give the same results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .. import lexicons as L
from ..functions import urls

EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
STATUSES = ("complete", "limited", "blocked")
SUBSCRIPTION_EVENTS = ("customer.subscription.created", "customer.subscription.updated", "customer.subscription.deleted", "invoice.paid", "invoice.payment_failed")
WELCOME_EVENTS = ("invoice.paid", "customer.subscription.created", "customer.subscription.updated")
EMAIL_CHARS, URL_CHARS = 254, 2048
TOLERANCE_SECONDS, TOKEN_SECONDS = 300, 30 * 24 * 3600
#: How long a delivery key is remembered after its last event.
DELIVERY_SECONDS = 30 * 24 * 3600


# -- monitoring ---------------------------------------------------------------------------------------------------------


def eligible() -> Column:
    return F.col("score").isNotNull() & (F.col("readiness_state") == "observed") & F.coalesce("may_monitor", F.lit(True))


def monitoring(history: DataFrame) -> DataFrame:
    """Each audit of a session with the one before it: (…, eligible, previous_score, delta, alert).

    ``history``: session, at, url, score, readiness_state, may_monitor. The audit before is that of any URL; scores compare
    only if both audits are eligible and of the same URL. A limited audit replaces the score by none.
    """
    w = Window.partitionBy("session").orderBy("at")
    h = history.withColumn("eligible", eligible())
    h = h.withColumn("_p", F.lag(F.struct("url", "score", "eligible")).over(w))
    comparable = F.coalesce(F.col("eligible") & F.col("_p.eligible") & (F.col("url") == F.col("_p.url")), F.lit(False))
    delta = F.when(comparable, F.col("score") - F.col("_p.score"))
    alert = F.col("eligible") & ((F.col("score") < 60) | F.coalesce(delta < 0, F.lit(False)))
    return h.select("session", "at", "url", "score", "eligible", F.when(comparable, F.col("_p.score")).alias("previous_score"), delta.alias("delta"), alert.alias("alert"))


# -- leads --------------------------------------------------------------------------------------------------------------


def _score(name: str) -> tuple[Column, Column]:
    """(value, whether it is null or a whole number from 0 to 100)."""
    raw = F.col(name).cast("string")
    number = raw.try_cast("double")
    return number.cast("int"), raw.isNull() | F.coalesce((number == F.floor(number)) & number.between(0, 100), F.lit(False))


SCORES = ("readiness_score", "visibility_score", "understanding_score", "buyability_score")


def validated_leads(raw: DataFrame) -> DataFrame:
    """``raw`` cleaned, with ``reject``: the first thing wrong with a row, null if it is good."""
    email, url, status = F.lower(F.trim("email")), F.trim("website_url"), F.lower(F.trim("audit_status"))
    text_ok = lambda c, n: F.coalesce((c != "") & (F.length(c) <= n), F.lit(False))
    reject = (
        F.when(~(text_ok(email, EMAIL_CHARS) & F.coalesce(email.rlike(EMAIL), F.lit(False))), "email")
        .when(~(text_ok(url, URL_CHARS) & F.coalesce(urls.safe_public(url), F.lit(False))), "website_url")
        .when(~F.coalesce(status.isin(*STATUSES), F.lit(False)), "audit_status")
    )
    for s in SCORES:
        reject = reject.when(~_score(s)[1], s)
    keep = [c for c in raw.columns if c not in ("email", "website_url", "audit_status", *SCORES)]
    return raw.select(*keep, email.alias("email"), url.alias("website_url"), *(F.when(_score(s)[1], _score(s)[0]).alias(s) for s in SCORES), status.alias("audit_status"), reject.alias("reject"))


def upserted(leads: DataFrame, key: tuple[str, ...] = ("email", "website_url"), order: str = "ord") -> DataFrame:
    """The latest good row per key."""
    last = Window.partitionBy(*key).orderBy(F.desc(order))
    return leads.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def patched(table: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """``table`` with the columns of ``patch`` where that has the key and isn't null; other rows as they were."""
    new = patch.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in patch.columns if c != key))
    joined = table.join(new, F.col(key) == F.col("_k"), "left")
    return joined.select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in patch.columns and c != key else F.col(c) for c in table.columns))


def lead_payload(audits: DataFrame, email: Column, *keep: str) -> DataFrame:
    """What is stored of an audit when a visitor leaves an address."""
    return audits.select(*keep, F.lower(F.trim(email)).alias("email"), F.trim("url").alias("website_url"), F.col("observed_readiness").alias("readiness_score"), F.col("visibility").alias("visibility_score"), F.col("understanding").alias("understanding_score"), F.col("buyability").alias("buyability_score"), F.col("status").alias("audit_status"))


# -- subscriptions ------------------------------------------------------------------------------------------------------


def deduplicated(events: DataFrame, key: str = "event_id", order: str = "ord") -> DataFrame:
    """Each event once: its first delivery."""
    return events.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


def resolved_status() -> Column:
    """Status a subscription has after an event."""
    kind = F.col("type")
    return F.when(kind == "invoice.paid", "active").when(kind == "customer.subscription.deleted", F.coalesce("status", F.lit("canceled"))).otherwise(F.col("status"))


def subscription_states(events: DataFrame) -> DataFrame:
    """(subscription, status, customer, lead_id): the last status of each subscription, and the lead that any of its events names.

    A payment for a subscription that no lead or earlier event names changes nothing.
    """
    once = deduplicated(events).where(F.col("subscription").isNotNull())
    whole = Window.partitionBy("subscription").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    lead = F.last("lead_id", ignorenulls=True).over(whole)
    told = once.withColumn("lead", lead).where(F.col("type").isin(*SUBSCRIPTION_EVENTS) & ((F.col("type") != "invoice.paid") | F.col("lead").isNotNull()))
    told = told.withColumn("new_status", resolved_status()).where("new_status is not null")
    return told.groupBy("subscription").agg(F.max_by("new_status", "ord").alias("status"), F.max_by("customer", "ord").alias("customer"), F.max_by("lead", "ord").alias("lead_id"))


def unique_matches(rows: DataFrame, leads: DataFrame, on: str) -> DataFrame:
    """``rows`` joined with ``leads`` on a key that exactly one lead has."""
    single = leads.groupBy(on).agg(F.count("*").alias("_n"), F.min("lead_id").alias("lead_id")).where("_n = 1").drop("_n")
    return rows.join(single, on)


def checkout_state() -> Column:
    """Decision on a checkout request of a lead (lead_id, subscription_status, price_locked, slots_left)."""
    return (
        F.when(F.col("lead_id").isNull(), "lead_missing").when(F.col("subscription_status") == "active", "already_active").when(F.coalesce("price_locked", F.lit(False)), "ineligible")
        .when(F.coalesce("slots_left", F.lit(0)) <= 0, "exhausted").otherwise("checkout")
    )


def entitlements(tokens: DataFrame, leads: DataFrame, now: int) -> DataFrame:
    """Tokens (lead_id, website_url, exp) with ``active``: not expired, and the lead's site, status, price lock and subscription agree."""
    known = leads.select("lead_id", F.col("website_url").alias("_url"), "subscription_status", "price_locked", "subscription_id")
    joined = tokens.join(known, "lead_id", "left")
    ok = (F.col("exp") > now) & (F.col("_url") == urls.with_scheme(F.col("website_url"))) & (F.col("subscription_status") == "active") & F.col("price_locked") & (F.coalesce("subscription_id", F.lit("")) != "")
    return joined.select("lead_id", "website_url", "exp", F.coalesce(ok, F.lit(False)).alias("active"))


def signature_valid(payloads: DataFrame, secret: str, now: int) -> DataFrame:
    """Adds ``valid``: a fresh HMAC-SHA256 signature ``t=…,v1=…`` of ``t.payload``; the first time and any of the signatures count. Native."""
    from .access import hmac_sha256

    parts = F.split(F.coalesce("signature", F.lit("")), ",")
    of = lambda k: F.transform(F.filter(parts, lambda p: F.startswith(p, F.lit(f"{k}="))), lambda p: F.substring(p, len(k) + 2, 1 << 16))
    time = F.get(of("t"), F.lit(0))
    fresh = time.rlike("^[0-9]{1,18}$") & (F.abs(F.try_to_number(time, F.lit("9" * 18)) - now) <= TOLERANCE_SECONDS)
    good = F.lower(F.hex(hmac_sha256(secret, F.concat(time, F.lit("."), F.coalesce("payload", F.lit(""))))))
    return payloads.withColumn("valid", F.coalesce(fresh & F.exists(of("v1"), lambda v: F.lower(v) == good), F.lit(False)) & F.lit(bool(secret)))


def welcome_deliveries(events: DataFrame, leads: DataFrame) -> DataFrame:
    """(delivery_key, lead_id): one welcome per lead and subscription, once an event shows an active, price-locked lead."""
    due = deduplicated(events).where(F.col("type").isin(*WELCOME_EVENTS)).select("subscription").distinct()
    ready = leads.where((F.col("subscription_status") == "active") & F.col("price_locked") & (F.coalesce("email", F.lit("")) != "") & (F.coalesce("website_url", F.lit("")) != ""))
    joined = ready.join(due, ready["subscription_id"] == due["subscription"])
    return joined.select(F.concat_ws(":", F.lit("founder_welcome"), "lead_id", "subscription_id").alias("delivery_key"), "lead_id").distinct()


def drop_deliveries(audits: DataFrame) -> DataFrame:
    """(delivery_key, lead_id) of audits whose score fell; rows without an id are skipped."""
    return audits.where((F.col("delta") < 0) & F.col("audit_id").isNotNull() & F.col("lead_id").isNotNull()).select(F.concat_ws(":", F.lit("readiness_drop"), "audit_id").alias("delivery_key"), "lead_id")


def reserve(ledger: DataFrame, wanted: DataFrame) -> DataFrame:
    """Deliveries to send now: keys not in the ledger (delivery_key, status), and those that failed before."""
    done = ledger.where("status <> 'failed'").select("delivery_key")
    return wanted.dropDuplicates(["delivery_key"]).join(done, "delivery_key", "left_anti")


def settled(ledger: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The ledger after outcomes (delivery_key, sent)."""
    new = outcomes.select("delivery_key", F.when(F.col("sent"), "sent").otherwise("failed").alias("status"))
    return ledger.join(new.select("delivery_key"), "delivery_key", "left_anti").unionByName(new)


def deliveries(events: DataFrame, time: str = "at", tie: str = "ord", life_seconds: int = DELIVERY_SECONDS) -> DataFrame:
    """The ledger replayed: (delivery_key, at, ord, event, granted, status) of each event (delivery_key, event, at, ord) that counts.

    A ``reserve`` is granted to a new key and to one whose last event is a failure; ``sent`` and ``failed`` set the status of a reserved key.
    A key that rests for longer than its life is new again.
    """
    us = F.unix_micros(F.col(time).cast("timestamp"))
    w = Window.partitionBy("delivery_key").orderBy("_us", tie)
    rows = events.withColumn("_us", us).withColumn("_gap", F.col("_us") - F.lag("_us").over(w))
    rows = rows.withColumn("_life", F.sum((F.coalesce("_gap", F.lit(0)) > life_seconds * 1_000_000).cast("int")).over(w))
    inside = Window.partitionBy("delivery_key", "_life").orderBy("_us", tie)
    # Outcomes of a key that nothing reserved change nothing.
    rows = rows.withColumn("_reserved", F.max((F.col("event") == "reserve").cast("int")).over(inside)).where("_reserved = 1")
    rows = rows.withColumn("_before", F.lag("event").over(inside))
    rows = rows.withColumn("granted", F.when(F.col("event") == "reserve", F.coalesce(F.col("_before") == "failed", F.lit(True))))
    own = F.when(F.col("event") != "reserve", F.col("event")).when(F.col("granted"), "pending")
    return rows.select("delivery_key", F.timestamp_micros("_us").alias("at"), F.col(tie).cast("bigint").alias("ord"), "event", "granted", F.last(own, ignorenulls=True).over(inside).alias("status"))


# -- remediation --------------------------------------------------------------------------------------------------------


def remediation(actions: DataFrame) -> DataFrame:
    """Adds the template (action, category) of each action (title, action_id, category): first that fits in the list's order."""
    title = F.coalesce("title", F.lit(""))
    stable = F.lower(F.coalesce(F.nullif("action_id", F.lit("")), F.nullif("category", F.lit("")), F.lit("")))
    broad = F.lower(title).rlike(L.REMEDIATION_BROAD) | stable.isin("commercial_accessibility", "buyability")
    found = F.when(broad, 0)
    for k, (name, category, pattern) in enumerate(L.REMEDIATIONS):
        if pattern:
            hit = title.rlike(f"(?i){pattern}") | F.coalesce(F.col("action_id") == name, F.lit(False)) | F.coalesce(F.col("category") == category, F.lit(False))
            found = found.when(hit, k)
    names, categories = (F.array(*(F.lit(r[i]) for r in L.REMEDIATIONS)) for i in (0, 1))
    at = lambda a: F.when(found.isNotNull(), F.get(a, found))
    return actions.select("*", F.coalesce(F.nullif("action_id", F.lit("")), at(names), F.lit("unknown")).alias("meta_action"), F.coalesce(F.nullif("category", F.lit("")), at(categories), F.lit("unknown")).alias("meta_category"))


DIMENSIONS = ("visibility", "understanding", "buyability")


def remediation_plan(actions: DataFrame, audits: DataFrame) -> DataFrame:
    """What to do about each action (audit_id, title, reason, action_id, category) of an audit, and what the audit showed of it.

    ``audits``: (audit_id, evidence: map of lists of (label, excerpt), conversion: state of that capability). Adds to the template found by
    :func:`remediation`: ``relevant``, the proofs whose label or excerpt holds one of the title's first three words; ``affected``, the
    dimensions without proof, and buyability where no conversion was observed; ``insufficient``, if no template fits or no reason is given.
    """
    joined = remediation(actions.withColumn("title", F.trim(F.coalesce("title", F.lit(""))))).join(audits.select("audit_id", "evidence", "conversion").hint("merge"), "audit_id", "left")
    names, categories = (F.array(*(F.lit(r[i]) for r in L.REMEDIATIONS)) for i in (0, 1))
    found = F.coalesce(F.when(F.array_contains(names, F.col("meta_action")), F.col("meta_action")), F.get(names, F.nullif(F.array_position(categories, F.col("meta_category")), F.lit(0)).cast("int") - 1), F.lit("unknown"))
    lists = F.coalesce(F.map_values("evidence"), F.array().cast(ArrayType(audits.schema["evidence"].dataType.valueType)))
    shown = F.filter(F.flatten(F.filter(lists, lambda x: x.isNotNull())), lambda e: (F.coalesce(e["label"], F.lit("")) != "") | (F.coalesce(e["excerpt"], F.lit("")) != ""))
    words = F.slice(F.split(F.lower("title"), r"\s+"), 1, 3)
    said = lambda e: F.lower(F.concat(F.coalesce(e["label"], F.lit("")), F.lit(" "), F.coalesce(e["excerpt"], F.lit(""))))
    relevant = F.filter(shown, lambda e: F.exists(words, lambda w: F.contains(said(e), w)))
    observed = F.coalesce(F.contains("conversion", F.lit("OBSERVED")), F.lit(False))
    empty = lambda d: F.coalesce(F.size(F.col("evidence")[d]) == 0, F.lit(True))
    affected = F.array_compact(F.array(*(F.when(empty(d) | (F.lit(d == "buyability") & ~observed), d) for d in DIMENSIONS)))
    no_reason = F.trim(F.coalesce("reason", F.lit(""))) == ""
    return joined.select(
        *actions.columns, "meta_action", "meta_category", found.alias("template"), relevant.alias("relevant"), affected.alias("affected"), ((found == "unknown") | no_reason).alias("insufficient"), (F.size(relevant) > 0).alias("located"),
    )


def recheck(originals: DataFrame, audits: DataFrame, actions: DataFrame) -> DataFrame:
    """State of each original action (audit_id, title, …) in the next audit.

    ``audits``: (audit_id, status, acquisition, score_status); ``actions``: that audit's actions (audit_id, title, action_id, category).
    """
    first = remediation(originals)
    after = remediation(actions).select("audit_id", F.col("meta_action").alias("a"), F.col("meta_category").alias("c"))
    # An action is known by what it is in the next audit, not by its title, which may be null or repeat.
    now = after.groupBy("audit_id").agg(F.collect_set("a").alias("_a"), F.collect_set("c").alias("_c"))
    known = lambda here, there: (F.col(here) != "unknown") & F.array_contains(there, F.col(here))
    joined = first.join(now, "audit_id", "left").join(audits, "audit_id", "left").withColumn("still", F.coalesce(known("meta_action", "_a") | known("meta_category", "_c"), F.lit(False)))
    dark = F.col("status").isNull() | (F.col("status") == "error")
    weak = (F.col("acquisition") == "blocked") | (F.col("score_status") == "insufficient_evidence")
    state = F.when(dark, "INSUFFICIENT_EVIDENCE").when(F.col("still"), "STILL_DETECTED").when(weak, "INSUFFICIENT_EVIDENCE").otherwise("RESOLVED")
    return joined.select("audit_id", "title", state.alias("state"))
