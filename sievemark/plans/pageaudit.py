"""Page audit: acquisition, seven capabilities with three-valued evidence, three scores and the next actions of single pages.

One projection chain over (url, html): no shuffle, no Python. Absence is only stated where acquisition was full; otherwise a
capability that wasn't seen is insufficiently evidenced, and scores that can't be given are null, never 0.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import urls
from ..functions.money import half_up, page_prices

#: Blank characters of the audit's patterns, spelled out: engines disagree about ``\s``.
BLANK = "[\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
OBSERVED, NOT_OBSERVED, INSUFFICIENT = "OBSERVED", "NOT_OBSERVED", "INSUFFICIENT_EVIDENCE"
CAPABILITIES = ("identity", "offer", "pricing", "conversion", "availability", "payment", "geography")
CONTACT_LINK = "(?i)mailto:|tel:|wa\\.me|whatsapp"


@lru_cache(maxsize=None)
def _literals(words: str) -> tuple[str, ...]:
    """The strings that a list of alternatives stands for; its classes have single characters."""
    out: list[str] = []
    for one in words.split("|"):
        options = [list(p[1:-1]) if p.startswith("[") else [p] for p in re.split(r"(\[[^\]]*\])", one) if p]
        out += ["".join(x) for x in product(*options)]
    return tuple(dict.fromkeys(out))


def folded(text: Column) -> Column:
    """Lower case, with the letters whose capital or small form is an ASCII letter as that letter: what the patterns take as equal."""
    return F.lower(F.translate(text, "ſ\u212aİı", "skii"))


def worded(text: Column, words: str, low: Column | None = None) -> Column:
    """Whether one of the alternatives stands between ASCII word edges. ``low`` is the text folded: the pattern is tried only where that holds one of them."""
    exact = text.rlike(f"(?iu){_EDGE}(?:{words}){_EDGE}")
    return exact if low is None else reduce(lambda a, b: a | b, (F.contains(low, F.lit(x)) for x in _literals(words))) & exact


def decode(value: Column) -> Column:
    """Four entities, then tags out, then blanks to single spaces - in this order."""
    for name, char in (("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&quot;", '"'), ("&#39;", "'"), ("<[^>]+>", " "), (f"{BLANK}+", " ")):
        value = F.regexp_replace(value, name, char)
    return F.trim(value)


def visible_text(html: Column) -> Column:
    return decode(F.regexp_replace(html, r"(?i)<script[\s\S]*?</script>|<style[\s\S]*?</style>|<template[\s\S]*?</template>|<noscript[\s\S]*?</noscript>", " "))


def _first(html: Column, pattern: str) -> Column:
    return decode(F.regexp_extract(html, pattern, 1))


def _all(html: Column, pattern: str, limit: int) -> Column:
    return F.slice(F.filter(F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), decode), lambda x: x != ""), 1, limit)


TITLE = r"(?i)<title[^>]*>([\s\S]*?)</title>"
HEADING = r"(?i)<h[1-3][^>]*>([\s\S]*?)</h[1-3]>"


def _described(html: Column) -> Column:
    first = _first(html, r"""(?i)<meta[^>]+(?:name|property)=["'](?:description|og:description)["'][^>]+content=["']([^"']+)["'][^>]*>""")
    second = _first(html, r"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+(?:name|property)=["'](?:description|og:description)["'][^>]*>""")
    return F.when(first != "", first).otherwise(second)


#: Characters of a proof that are kept.
EXCERPT = 220


def _evidence(url: Column, has: dict[str, Column], identity: Column, blocked: Column, limited: Column, thin: Column) -> Column:
    """Proofs (label, excerpt) in four groups; what isn't text of the page is a code."""
    proof = lambda label, excerpt: F.struct(F.lit(label).alias("label"), F.substring(decode(excerpt), 1, EXCERPT).alias("excerpt"))
    when = lambda test, label, excerpt: F.when(test, proof(label, excerpt))
    some = lambda *items: F.filter(F.array(*items), lambda x: x.isNotNull())
    each = lambda label, values: F.transform(values, lambda v: proof(label, v))
    code, c = F.lit, F.col
    acquisition = some(
        when(blocked, "blocked", code("challenge_page")), when(limited & (c("_first") == "hard_limited"), "limited", code("javascript_required")),
        when(limited & (c("_first") != "hard_limited") & thin, "limited", code("thin_text")), when(limited & (c("_first") != "hard_limited") & c("_shell"), "limited", code("script_shell")),
    )
    visibility = some(
        proof("page", url), when(c("title") != "", "title", c("title")), when(c("description") != "", "description", c("description")), when(c("same_host_canonical"), "canonical", c("canonical")),
    )
    name = F.when(c("title") != "", c("title")).otherwise(F.try_element_at("headings", F.lit(1)))
    understanding = F.concat(
        some(when(identity, "identity", name)), each("commercial_heading", c("commercial_headings")), some(when(c("schema_commerce"), "structured_data", code("commercial_jsonld"))), each("price", c("prices")),
    )
    buyability = F.concat(each("action", F.slice("actions", 1, 5)), some(*(when(has[k], k, code("wording")) for k in ("availability", "payment", "geography"))))
    none = F.array().cast("array<struct<label:string,excerpt:string>>")
    groups = {"acquisition": acquisition, "visibility": visibility, "understanding": understanding, "buyability": buyability}
    return F.struct(*((g if k == "acquisition" else F.when(blocked, none).otherwise(g)).alias(k) for k, g in groups.items()))


def _sources(html: Column) -> Column:
    return F.concat(
        _all(html, r"(?i)<(?:a|button)[^>]*>([\s\S]*?)</(?:a|button)>", 40),
        _all(html, r"""(?i)<form[^>]*(?:action|name|id)=["']([^"']+)["'][^>]*>""", 12),
        _all(html, r"""(?i)<(?:a|button)[^>]+(?:aria-label|title)=["']([^"']+)["'][^>]*>""", 20),
        _all(html, r"""(?i)<a[^>]+href=["'](mailto:[^"']+|tel:[^"']+|https?://(?:wa\.me|api\.whatsapp\.com)[^"']*)["'][^>]*>""", 12),
    )


def _resolved_host(link: Column, base: Column) -> Column:
    """Host a link points to from a page: its own if absolute, else the page's."""
    own = F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), urls.host(link)).when(link.startswith("//"), urls.host(F.concat(F.lit("https:"), link)))
    return F.coalesce(own, urls.host(base))


def inspect(pages: DataFrame, url: str = "url", html: str = "html", method: str = "static") -> DataFrame:
    """``pages`` with the columns of the audit; stages are separate projections, so nothing is computed twice."""
    keep = pages.columns
    h = F.coalesce(F.col(html), F.lit(""))
    seen = pages.select(
        "*",
        visible_text(h).alias("visible"),
        _first(h, TITLE).alias("title"),
        _described(h).alias("description"),
        _first(h, r"""(?i)<link[^>]+rel=["'][^"']*canonical[^"']*["'][^>]+href=["']([^"']+)["'][^>]*>""").alias("canonical"),
        _all(h, HEADING, 8).alias("headings"),
        _all(h, r"""(?i)<script[^>]+type=["']application/ld\+json["'][^>]*>([\s\S]*?)</script>""", 8).alias("schemas"),
        _sources(h).alias("sources"),
        F.regexp_count(h, F.lit(r"(?i)<script(?![A-Za-z0-9_])")).alias("n_scripts"),
    )
    joined, both, low = F.col("_joined"), F.col("_both"), F.col("_low")
    seen = seen.select("*", F.array_join("sources", " ").alias("_joined"), F.concat(h, F.lit(" "), F.col("visible")).alias("_both"))
    seen = seen.select("*", folded(both).alias("_low"), folded(F.col("visible")).alias("_seen"), folded(joined).alias("_asked"))
    seen = seen.select(
        "*",
        F.length("visible").alias("n_visible"),
        page_prices(F.col("visible")).alias("prices"),
        F.slice(F.filter("sources", lambda x: worded(x, L.PAGE_CTA) | x.rlike(CONTACT_LINK)), 1, 8).alias("actions"),
        worded(joined, L.PAGE_BOOKING, F.col("_asked")).alias("says_booking"),
        worded(joined, L.PAGE_QUOTE, F.col("_asked")).alias("says_quote"),
        worded(joined, L.PAGE_PURCHASE, F.col("_asked")).alias("says_purchase"),
        (worded(joined, L.PAGE_CONTACT, F.col("_asked")) | joined.rlike(CONTACT_LINK)).alias("says_contact"),
        F.filter("headings", lambda x: worded(x, L.PAGE_COMMERCIAL)).alias("commercial_headings"),
        F.exists("schemas", lambda x: x.rlike(rf'(?i)"@type"{BLANK}*:{BLANK}*"(?:Product|Service|Offer|Course|Event|LocalBusiness)"')).alias("schema_commerce"),
        worded(both, L.PAGE_BOT_BLOCK, low).alias("is_blocked"),
        worded(both, L.PAGE_JS_REQUIRED, low).alias("needs_js"),
        worded(F.col("visible"), L.PAGE_AVAILABILITY, F.col("_seen")).alias("has_availability"),
        worded(F.col("visible"), L.PAGE_PAYMENT, F.col("_seen")).alias("has_payment"),
        worded(F.col("visible"), L.PAGE_AREA, F.col("_seen")).alias("has_geography"),
        ((F.col("canonical") != "") & (_resolved_host(F.col("canonical"), F.col(url)) == urls.host(F.col(url)))).alias("same_host_canonical"),
    )
    thin, shell = F.col("n_visible") < 180, (F.col("n_visible") < 500) & (F.col("n_scripts") >= 5)
    journey = F.when(F.col("says_purchase"), "purchase").when(F.col("says_booking"), "booking").when(F.col("says_quote"), "quote").when(F.col("says_contact"), "contact").otherwise("unknown")
    offer = (F.size("commercial_headings") > 0) | F.col("schema_commerce") | ((F.size("prices") > 0) & (F.size("actions") > 0))
    first = F.when(F.col("is_blocked"), "blocked").when(F.col("needs_js"), "hard_limited").when(thin | shell, "limited").otherwise("full")
    seen = seen.select("*", first.alias("_first"), journey.alias("journey"), offer.alias("has_offer"), (F.size("prices") > 0).alias("has_pricing"), shell.alias("_shell"))
    rescued = (F.col("_first") == "limited") & F.col("has_offer") & ((F.col("journey") != "unknown") | F.col("has_pricing"))
    seen = seen.select("*", F.when(rescued, "full").when(F.col("_first") == "hard_limited", "limited").otherwise(F.col("_first")).alias("acquisition"))
    blocked, limited = F.col("acquisition") == "blocked", F.col("acquisition") == "limited"
    identity = (F.col("title") != "") | (F.size("headings") > 0)
    has = {
        "identity": identity,
        "offer": F.col("has_offer"),
        "pricing": F.col("has_pricing"),
        "conversion": F.col("journey") != "unknown",
        "availability": F.col("has_availability"),
        "payment": F.col("has_payment"),
        "geography": F.col("has_geography"),
    }
    point = lambda c, n: F.when(c, n).otherwise(0)
    described = F.col("description") != ""
    visibility = 35 + point(F.col("title") != "", 20) + point(described, 15) + point(F.col("same_host_canonical"), 15) + point(F.size("headings") >= 2, 15)
    understanding = point(has["identity"], 25) + point(has["offer"], 35) + point(has["pricing"], 15) + point(described, 10) + point(F.col("schema_commerce"), 15)
    buyability = point(has["conversion"], 40) + point(has["pricing"] | F.col("says_quote"), 25) + point(has["availability"], 15) + point(has["payment"], 10) + point(has["geography"], 10)
    n_visibility = 1 + point(F.col("title") != "", 1) + point(described, 1) + point(F.col("same_host_canonical"), 1)
    n_understanding = point(identity, 1) + F.size("commercial_headings") + point(F.col("schema_commerce"), 1) + F.size("prices")
    n_buyability = F.least(F.size("actions"), F.lit(5)) + point(has["availability"], 1) + point(has["payment"], 1) + point(has["geography"], 1)
    usable = ~blocked & (F.col("_first") != "hard_limited") & (F.col("n_visible") >= 20)
    state = lambda c: F.when(blocked, INSUFFICIENT).when(c, OBSERVED).when(limited, INSUFFICIENT).otherwise(NOT_OBSERVED)
    scored = seen.select(
        "*",
        F.when(usable & (n_visibility >= 2), visibility).alias("visibility"),
        F.when(usable & (n_understanding >= 1), understanding).alias("understanding"),
        F.when(usable, buyability).alias("buyability"),
        F.create_map(*(x for k in CAPABILITIES for x in (F.lit(k), state(has[k])))).alias("capabilities"),
        n_visibility.alias("n_visibility_evidence"),
        n_understanding.alias("n_understanding_evidence"),
        n_buyability.alias("n_buyability_evidence"),
        _evidence(F.col(url), has, identity, blocked, limited, thin).alias("evidence"),
        _next_actions(has, blocked, limited).alias("next_actions"),
        _gaps(has, blocked, n_buyability).alias("gaps"),
    )
    whole = F.col("visibility").isNotNull() & F.col("understanding").isNotNull() & F.col("buyability").isNotNull()
    rest = F.col("capabilities")
    detail = (rest["pricing"] == OBSERVED) | (rest["availability"] == OBSERVED) | (rest["payment"] == OBSERVED) | (rest["geography"] == OBSERVED)
    enough = ((rest["offer"] == OBSERVED) & (rest["conversion"] == OBSERVED)) | (((rest["offer"] == OBSERVED) | (rest["conversion"] == OBSERVED)) & detail)
    level = F.when(limited, "LOW").otherwise("MEDIUM" if method == "rendered" else "HIGH")
    return scored.select(
        *keep,
        F.when(blocked, "blocked").when(limited, "limited").otherwise("complete").alias("status"),
        "acquisition",
        (F.col("_shell") & limited).alias("rendering_recommended"),
        (F.col("_first") == "hard_limited").alias("hard_limited"),
        "title",
        "description",
        "same_host_canonical",
        F.slice("headings", 1, 5).alias("headings"),
        "prices",
        F.slice("actions", 1, 5).alias("commercial_actions"),
        F.when(blocked, "unknown").otherwise(F.col("journey")).alias("journey"),
        "capabilities",
        "visibility",
        "understanding",
        "buyability",
        F.when(whole, half_up((F.col("visibility") + F.col("understanding") + F.col("buyability")) / 3)).alias("observed_readiness"),
        F.when(whole, "observed").otherwise("insufficient_evidence").alias("readiness_state"),
        F.when(whole, level).otherwise("LOW").alias("confidence"),
        (~blocked & ~limited & (enough if method == "rendered" else F.lit(True))).alias("monitoring_eligible"),
        "next_actions",
        F.try_element_at("gaps", F.lit(1)).alias("main_gap"),
        F.when(F.size("gaps") >= 2, "HIGH").when(F.size("gaps") == 1, "MEDIUM").otherwise("LOW").alias("fix_potential"),
        "n_visible",
        "evidence",
    )


def _action(priority: str, title: str) -> Column:
    return F.struct(F.lit(priority).alias("priority"), F.lit(title).alias("title"))


def _next_actions(has: dict[str, Column], blocked: Column, limited: Column) -> Column:
    """At most four, in order of urgency."""
    commercial = has["offer"] | has["pricing"] | has["conversion"]
    steps = F.array(
        F.when(~has["offer"], _action("high", "Make the main offer explicit")),
        F.when(~has["conversion"], _action("high", "Add a clear commercial next step")),
        F.when(~has["pricing"] & ~F.col("says_quote"), _action("high", "Explain price or the quote process")),
        F.when(F.col("journey").isin("purchase", "booking") & ~has["availability"], _action("medium", "State availability or timing")),
    )
    some = lambda a: F.filter(a, lambda x: x.isNotNull())
    return (
        F.when(blocked, F.array(_action("high", "Keep essential public information accessible to agents")))
        .when(limited, F.array(_action("high", "Make key commercial information agent-accessible")))
        .when(commercial, some(steps))
        .otherwise(some(F.array(F.when(~has["identity"], _action("medium", "Clarify the organization and its purpose")))))
    )


def _gaps(has: dict[str, Column], blocked: Column, n_buyability: Column) -> Column:
    found = F.array(
        F.when(n_buyability == 0, "No buyability signal was observed in the inspected content."),
        F.when(~has["offer"], "offer details are not fully observable"),
        F.when(~has["conversion"], "a commercial next step is not observable"),
        F.when(~has["pricing"], "pricing is not observable"),
    )
    return F.when(blocked, F.array().cast("array<string>")).otherwise(F.filter(found, lambda x: x.isNotNull()))


def with_rendered(static: DataFrame, rendered: DataFrame, key: str = "url") -> DataFrame:
    """Audits where a rendered page, if one was made for a thin one, replaces the static reading; else the static one stays.

    ``rendered`` has the columns of ``inspect(..., method="rendered")``; its blocked and limited readings don't replace, and of several
    of one key the first by ``page_id`` counts, so that pages that repeat a URL stay as many as they are.
    """
    complete = rendered.where(F.col("status") == "complete").where(F.col(key).isNotNull())
    good = complete.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*static.columns), F.col("page_id")).alias("_new"))
    joined = static.join(good, F.col(key) == F.col("_key"), "left")
    take = F.col("_new").isNotNull() & F.col("rendering_recommended")
    return joined.select(*(F.when(take, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in static.columns), F.when(take, "rendered").otherwise("static").alias("method"))


def primary_finding(audits: DataFrame) -> DataFrame:
    """The first urgent action, else the first, else what the evidence allows to say."""
    urgent = F.try_element_at(F.filter("next_actions", lambda a: a["priority"] == "high"), F.lit(1))
    first = F.coalesce(urgent, F.try_element_at("next_actions", F.lit(1)))
    default = F.when(F.col("readiness_state") == "insufficient_evidence", _action("high", "More observable evidence is needed")).otherwise(_action("medium", "No urgent issue observed on this page"))
    return audits.withColumn("finding", F.coalesce(first, default))
