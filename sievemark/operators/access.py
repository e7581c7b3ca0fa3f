"""Access and billing decisions as columns and joins: leads of audits, checkout and activation, payment links, signed entitlement tokens, gated
reports, renderer and request codes, strict answers of a semantic validator. Nothing is sent anywhere; callers bring rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .state import EMAIL, EMAIL_CHARS, TOKEN_SECONDS, URL_CHARS, patched, unique_matches

OFFER = "founder"
SESSION_ID = r"^cs_[A-Za-z0-9_]+$"
#: Statuses by which a renderer's provider refuses a page.
RENDERER_BLOCKED = (401, 403, 429, 451)
#: Classes that a semantic validator may answer with, and the keys of an answer.
CLASSES = (
    "commercial_offer", "product", "service", "booking", "quote", "category", "recommendation_widget", "article", "event", "portfolio", "testimonial", "legal", "process_step", "informational",
)
ANSWER_KEYS = ("accept", "classification", "confidence", "justification", "related_offer")


# -- identities and projections -----------------------------------------------------------------------------------------


def checkout_identity(rows: DataFrame) -> DataFrame:
    """``rows`` with email and website_url as a checkout keeps them, and ``reject``: the first of the two that is no good, null if both are."""
    email, url = F.lower(F.trim("email")), F.trim("website_url")
    good = F.coalesce((F.length(email) <= EMAIL_CHARS) & email.rlike(EMAIL), F.lit(False))
    safe = F.coalesce((url != "") & (F.length(url) <= URL_CHARS) & urls.safe_public(url), F.lit(False))
    keep = [c for c in rows.columns if c not in ("email", "website_url")]
    return rows.select(*keep, email.alias("email"), F.when(safe, urls.with_scheme(url)).alias("website_url"), F.when(~good, "email").when(~safe, "website_url").alias("reject"))


def report_access(email_submitted: Column) -> Column:
    """What a visitor doesn't see of a report: all of it until an address was left."""
    locked = ~F.coalesce(email_submitted, F.lit(False))
    return F.struct(locked.alias("full_report_hidden"), locked.alias("founder_offer_hidden"))


def conversion_measure(event: Column) -> Column:
    """The measure under which a conversion event counts elsewhere; null for the others."""
    return F.when(event == "audit_completed", "custom").when(event == "checkout_started", "contents")


def confirmed(ok: Column, active: Column) -> Column:
    return F.coalesce(ok & active, F.lit(False))


def renderer_status(safe: Column, http_status: Column, success: Column, html: Column, timed_out: Column) -> Column:
    """Result code of a rendered page: blocked, timeout, failed or success; ``http_status`` is null where no provider answered, and unavailable if there is none."""
    usable = F.coalesce(success & (F.trim(html) != ""), F.lit(False))
    return (
        F.when(~F.coalesce(safe, F.lit(False)) | http_status.isin(*RENDERER_BLOCKED), "blocked").when(F.coalesce(timed_out, F.lit(False)), "timeout").when(http_status.isNull(), "unavailable")
        .when(~http_status.between(200, 299) | ~usable, "failed").otherwise("success")
    )


def request_code(method: Column, allowed: str, declared: Column, body: Column, valid: Column, created: Column, conflict: Column, most: int = 8192) -> Column:
    """HTTP code of a handler: 405 for another method, 413 for a body too large as declared or as sent, 400 for no JSON or bad input, 409 for a
    decision against it, 200 for what was there already, 201 for what is new."""
    large = F.coalesce(declared > most, F.lit(False)) | F.coalesce(F.octet_length(body) > most, F.lit(False))
    bad = F.try_parse_json(body).isNull() | ~F.coalesce(valid, F.lit(False))
    return F.when(method != allowed, 405).when(large, 413).when(bad, 400).when(F.coalesce(conflict, F.lit(False)), 409).when(F.coalesce(created, F.lit(False)), 201).otherwise(200)


def failure_kind(status: Column, error: Column, has_cause: Column) -> Column:
    """Why a request to a store failed: by its status, or where there was none by the error."""
    by_status = F.when(status == 401, "authentication").when(status == 403, "authorization").when(status.between(400, 499), "validation").otherwise("upstream")
    return F.when(status.isNotNull(), by_status).when((error == "TypeError") & ~F.coalesce(has_cause, F.lit(False)), "request_setup").otherwise("network")


# -- subscriptions ------------------------------------------------------------------------------------------------------


def subscription_lead(price: str) -> Column:
    """The lead that a subscription (offer, lead_id, prices) is for: the one its metadata name, if they name the offer or an item has its price."""
    ours = F.coalesce(F.col("offer") == OFFER, F.lit(False)) | F.coalesce(F.exists("prices", lambda p: p == price), F.lit(False))
    return F.when(ours & (F.coalesce("lead_id", F.lit("")) != ""), F.col("lead_id"))


def linked_payments(sessions: DataFrame, leads: DataFrame, states: DataFrame, link: str) -> DataFrame:
    """(session_id, lead_id, customer, subscription, subscription_status, activate) of completed payment-link sessions that belong to exactly one lead.

    ``sessions``: session_id, mode, payment_link, details_email, customer_email, customer, subscription; ``leads``: lead_id, email, subscription_id,
    subscription_status; ``states``: subscription, status. A lead that has another subscription is left alone. ``activate``: the subscription is active already.
    """
    ours = (F.col("mode") == "subscription") & (F.col("payment_link") == link) & (F.coalesce("subscription", F.lit("")) != "") & (F.coalesce("customer", F.lit("")) != "")
    email = F.lower(F.trim(F.coalesce(F.nullif("details_email", F.lit("")), "customer_email")))
    asked = sessions.where(ours).select("session_id", "customer", "subscription", email.alias("email"))
    known = leads.withColumn("email", F.lower(F.trim("email")))
    matched = unique_matches(asked, known.select("lead_id", "email"), "email").join(known.select("lead_id", F.col("subscription_id").alias("_has"), F.col("subscription_status").alias("_status")), "lead_id")
    free = (F.coalesce("_has", F.lit("")) == "") | (F.col("_has") == F.col("subscription"))
    linked = matched.where(free).join(states.select("subscription", F.col("status").alias("_now")), "subscription", "left")
    return linked.select("session_id", "lead_id", "customer", "subscription", F.coalesce("_status", F.lit("pending")).alias("subscription_status"), F.coalesce(F.col("_now") == "active", F.lit(False)).alias("activate"))


def activated(leads: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """``leads`` after activations (lead_id, customer, subscription, status), with ``onboarding_ready``: the first time that a lead becomes active."""
    new = subscriptions.select("lead_id", F.col("customer").alias("_c"), F.col("subscription").alias("_s"), F.col("status").alias("_t")).dropDuplicates(["lead_id"])
    joined = leads.join(new, "lead_id", "left")
    starts = F.coalesce(F.col("_t") == "active", F.lit(False))
    was = F.coalesce(F.col("subscription_status") == "active", F.lit(False)) & F.coalesce("price_locked", F.lit(False))
    changed = {
        "customer_id": F.coalesce("_c", "customer_id"), "subscription_id": F.coalesce("_s", "subscription_id"), "subscription_status": F.coalesce("_t", "subscription_status"),
        "price_locked": F.coalesce("price_locked", F.lit(False)) | starts,
    }
    return joined.select(*((changed[c] if c in changed else F.col(c)).alias(c) for c in leads.columns), (starts & ~was).alias("onboarding_ready"))


def checkout_activation(sessions: DataFrame, leads: DataFrame) -> DataFrame:
    """(session_id, state): invalid, pending or active, for sessions (session_id, lead_id, mode, payment_status, subscription, subscription_state)."""
    known = leads.select("lead_id", F.col("subscription_id").alias("_sub"), F.col("subscription_status").alias("_status"), "price_locked")
    joined = sessions.join(known, "lead_id", "left")
    paid = (F.col("mode") == "subscription") & (F.col("payment_status") == "paid") & (F.col("subscription_state") == "active")
    active = paid & (F.col("_sub") == F.col("subscription")) & (F.col("_status") == "active") & F.col("price_locked")
    fits = F.coalesce(F.col("session_id").rlike(SESSION_ID), F.lit(False))
    return joined.select("session_id", F.when(~fits, "invalid").when(F.coalesce(active, F.lit(False)), "active").otherwise("pending").alias("state"))


def touched(table: DataFrame, patch: DataFrame, key: str, now: Column, stamp: str = "updated_at") -> DataFrame:
    """``table`` patched by key; rows that a patch has get the time of the write."""
    marked = patched(table, patch.withColumn(stamp, now), key) if stamp in table.columns else patched(table.withColumn(stamp, F.lit(None).cast("timestamp")), patch.withColumn(stamp, now), key)
    return marked


# -- signatures ---------------------------------------------------------------------------------------------------------


def hmac_sha256(secret: str, message: Column) -> Column:
    """HMAC-SHA256 as binary, from two native hashes."""
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in key)) for x in (0x36, 0x5C))
    hashed = lambda pad, data: F.unhex(F.sha2(F.concat(pad, data), 256))
    return hashed(outer, hashed(inner, F.encode(message, "UTF-8")))


def base64url(data: Column) -> Column:
    return F.regexp_replace(F.translate(F.regexp_replace(F.base64(data), r"\s", ""), "+/", "-_"), "=+$", "")


def entitlement_token(lead_id: Column, website_url: Column, now: int, secret: str) -> Column:
    """``body.signature``: base64url of the JSON body (valid for 30 days) and of its HMAC."""
    body = base64url(F.encode(F.to_json(F.struct(lead_id.alias("lead_id"), website_url.alias("website_url"), F.lit(now + TOKEN_SECONDS).alias("exp"))), "UTF-8"))
    return F.concat(body, F.lit("."), base64url(hmac_sha256(secret, body)))


def token_body(token: Column, now: int, secret: str) -> Column:
    """struct(lead_id, website_url, exp) of a token that is signed and not expired, else null."""
    parts = F.split(token, r"\.")
    body, signature = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    raw = F.translate(body, "-_", "+/")
    text = F.decode(F.try_to_binary(F.rpad(raw, F.length(raw) + (4 - F.length(raw) % 4) % 4, F.lit("=")), F.lit("base64")), "UTF-8")
    parsed = F.from_json(text, "lead_id string, website_url string, exp bigint")
    good = (signature == base64url(hmac_sha256(secret, body))) & (F.coalesce(parsed["lead_id"], F.lit("")) != "") & (F.coalesce(parsed["website_url"], F.lit("")) != "") & (parsed["exp"] > now)
    return F.when(F.coalesce(good, F.lit(False)), parsed)


def report_visible(audits: DataFrame, entitled: DataFrame) -> DataFrame:
    """``audits`` (session, url) with ``visible``: the session's entitlement (session, website_url, active) is active and for the audited URL."""
    known = entitled.where("active").select("session", F.col("website_url").alias("_url")).distinct()
    same = (audits["session"] == known["session"]) & (urls.with_scheme(audits["url"]) == known["_url"])
    return audits.join(known.withColumn("visible", F.lit(True)), same, "left").select(*(audits[c] for c in audits.columns), F.coalesce("visible", F.lit(False)).alias("visible"))


# -- semantic validation ------------------------------------------------------------------------------------------------


def semantic_decision(answer: Column) -> Column:
    """struct(classification, accept, related_offer, confidence, justification) of a JSON answer that keeps to the form exactly, else null.

    All five keys and no other; a known class; accept a boolean; confidence a number (or boolean) from 0 to 1; related_offer a string or null;
    justification a string with more than white space, which is trimmed.
    """
    v = F.try_parse_json(answer)
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    keys = F.sort_array(F.json_object_keys(answer))
    number = F.when(kind("confidence") == "BOOLEAN", F.try_variant_get(v, "$.confidence", "boolean").cast("double")).when(kind("confidence").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$.confidence", "double"))
    said = F.try_variant_get(v, "$.justification", "string")
    good = (
        (keys == F.array(*map(F.lit, ANSWER_KEYS))) & (kind("classification") == "STRING") & F.try_variant_get(v, "$.classification", "string").isin(*CLASSES) & (kind("accept") == "BOOLEAN")
        & number.between(0, 1) & kind("related_offer").isin("STRING", "VOID") & (kind("justification") == "STRING") & (F.trim(said) != "")
    )
    made = F.struct(
        F.try_variant_get(v, "$.classification", "string").alias("classification"), F.try_variant_get(v, "$.accept", "boolean").alias("accept"),
        F.try_variant_get(v, "$.related_offer", "string").alias("related_offer"), number.alias("confidence"), F.trim(said).alias("justification"),
    )
    return F.when(F.coalesce(good, F.lit(False)), made)
