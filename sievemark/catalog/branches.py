"""Rules and issues over customers as sites: each signal follows from a customer's orders by an arithmetic rule, so that every branch of every rule
is met, and the SQL twin computes each verdict from the same signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from .. import lexicons as L
from ..operators import profile, rules

FIELDS = (
    "business_name", "activity_market", "payment", "pricing", "quote_process", "service_area", "address", "structured_data", "purchase_process", "booking_process", "contact_process", "commercial_status",
    "availability", "opening_hours", "returns", "cancellation",
)
STATES = ("unknown", "known", "not_applicable", "known", "unknown", "conflicting")
CLOSURES = (None, "seasonal", "temporarily_closed", "open", "unavailable", "permanently_closed")
MEANS = (0.0, 0.331, 0.907, 0.953)
SITE_SCHEMA = (
    "site_id string, n_pages int, n_good int, n_text int, n_noindex int, n_canonical int, n_described int, n_blocked int, robots_accessible boolean, n_sitemaps int, profile string, n_offers int, "
    "mean_understanding double, mean_buyability double, closure string, has_price_value boolean, " + ", ".join(f"s_{f} string" for f in FIELDS)
)
#: What a customer's orders add to its key; the signals are made of the sum.
FROM_ORDERS = "7 * count(o_orderkey) + coalesce(max(o_orderkey), 0) + coalesce(sum(o_orderkey % 11), 0)"


def _signals(div: str) -> list[str]:
    """Columns of SITE_SCHEMA as SQL over (c_custkey, i); ``div`` is the dialect's whole division."""
    pick = lambda at, values: "CASE " + at + " " + " ".join(f"WHEN {k} THEN {'NULL' if v is None else repr(v)}" for k, v in enumerate(values)) + " END"
    text = "least(i % 7, i * 3 % 5)"
    share = lambda m: f"(CASE WHEN {text} > 0 THEN least({text}, i * {m} % ({text} + 1)) ELSE 0 END)"
    cast = lambda x, t="INT": f"CAST({x} AS {t})"
    state = lambda k: pick(f"((i * {k + 2} + (i {div} {k + 3}) + {k}) % {len(STATES)})", STATES)
    names = (*profile.PROFILES, "unknown")
    made = {
        "site_id": "concat('g', c_custkey)", "n_pages": cast("i % 7"), "n_good": cast(f"CASE WHEN i % 4 <> 0 THEN {share(5)} ELSE {text} END"), "n_text": cast(text), "n_noindex": cast(f"CASE WHEN i % 5 = 0 THEN {share(3)} ELSE 0 END"),
        "n_canonical": cast(f"CASE WHEN i % 6 = 1 THEN {text} ELSE {share(7)} END"), "n_described": cast(f"CASE WHEN i % 7 = 2 THEN {text} ELSE {share(11)} END"), "n_blocked": cast(f"(i % 4) {div} 3"), "robots_accessible": "i % 5 < 3",
        "n_sitemaps": cast("i % 3"), "profile": pick(f"((i * 5) % {len(names)})", names), "n_offers": cast("(i % 3) * (i % 2)"), "mean_understanding": cast(pick(f"((i {div} 3) % 4)", MEANS), "DOUBLE"),
        "mean_buyability": cast(pick(f"((i {div} 5) % 4)", MEANS), "DOUBLE"), "closure": pick(f"((i {div} 2) % {len(CLOSURES)})", CLOSURES), "has_price_value": "i % 4 = 1",
    }
    made |= {f"s_{f}": f"CASE WHEN {state(k)} = 'conflicting' AND i % 3 <> 0 THEN 'known' ELSE {state(k)} END" for k, f in enumerate(FIELDS)}
    return [f"{x} AS {name}" for name, x in made.items()]


def numbered_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signals of every customer's site."""
    customer, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders"))
    numbers = customer.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.expr(FROM_ORDERS).alias("k"))
    return numbers.select("c_custkey", (F.col("c_custkey") + F.col("k")).cast("bigint").alias("i")).selectExpr(*_signals("div"))


def signal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sites in the form that the rules read. A known or conflicting fact has a value, and a proof unless the site's place in the list is even."""
    t = numbered_sites(spark, sf_dir)
    pairs = lambda make: F.create_map(*(x for f in FIELDS for x in (F.lit(f), make(f))))
    here = lambda f: F.col(f"s_{f}").isin("known", "conflicting")
    value = lambda f: F.col("closure") if f == "commercial_status" else F.lit("x")
    odd = F.substring("site_id", -1, 1).cast("int") % 2 == 1
    return t.select(
        "*", pairs(lambda f: F.col(f"s_{f}")).alias("state"), pairs(lambda f: F.when(here(f) & value(f).isNotNull(), F.array(value(f))).otherwise(F.array().cast("array<string>"))).alias("values"),
        pairs(lambda f: F.when(here(f) & odd, 1).otherwise(0)).alias("n_proofs"),
    )


def rule_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_results(signal_rows(spark, sf_dir)).select("site_id", "rule_id", "status", "points_awarded", "points_possible")


def score_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.site_scores(rules.rule_results(signal_rows(spark, sf_dir)))


def sanity_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = signal_rows(spark, sf_dir)
    return rules.sanity(rules.recommendations(spark, rules.rule_results(sites)), sites).select("site_id", "issue_id", "rule_id", "contradiction")


def final_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues that nothing contradicts, united with price inconsistencies (two pages of every ninth site), in the order of a report."""
    sites = signal_rows(spark, sf_dir)
    issues = rules.sanity(rules.recommendations(spark, rules.rule_results(sites)), sites)
    proof = F.struct(F.lit("u").alias("url"), F.lit("cta").alias("kind"), F.lit("9 €").alias("excerpt"), F.lit(None).cast("string").alias("selector"))
    torn = sites.where("cast(substr(site_id, 2) as int) % 9 = 0").select("site_id", F.explode(F.array(F.lit("b"), F.lit("a"))).alias("url"), F.array(proof).alias("evidence"))
    return rules.final_issues(issues, torn).select("site_id", "place", "issue_id", "rule_id", "impact", F.size("evidence").alias("n_evidence"))


def rule_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What proves each verdict: a customer's orders are the proofs of its facts, those of one status its offers."""
    sites = signal_rows(spark, sf_dir)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("g"), F.col("o_custkey").cast("string")).alias("site_id"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    proof = F.struct(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("url"), F.lit("visible_text").alias("kind"), F.col("o_orderpriority").alias("excerpt"), F.lit(None).cast("string").alias("selector"))
    field = F.element_at(F.array(*map(F.lit, FIELDS)), (F.col("o_orderkey") % len(FIELDS) + 1).cast("int"))
    told = orders.groupBy("site_id", field.alias("field")).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", proof.alias("e")))), lambda x: x["e"]), 1, 15).alias("evidence"))
    states = sites.select("site_id", F.explode("state").alias("field", "state"))
    facts = states.join(told, ["site_id", "field"], "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(told.schema["evidence"].dataType)))
    offers = orders.where("o_orderstatus = 'O'").select("site_id", F.col("o_orderkey").alias("rank"), F.array(proof, proof).alias("evidence"))
    results = rules.with_evidence(rules.rule_results(sites), facts, offers)
    return results.select("site_id", "rule_id", "proof", F.size("evidence").alias("n_evidence"), F.try_element_at("evidence", F.lit(1))["url"].alias("first_url"), F.try_element_at("evidence", F.lit(-1))["url"].alias("last_url"))


QUERIES = {f.__name__: f for f in (rule_branches, score_branches, sanity_branches, final_issues, rule_evidence)}

_G = f"(SELECT {', '.join(_signals('//'))} FROM (SELECT c_custkey, (c_custkey + {FROM_ORDERS})::BIGINT AS i FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey))"
_R = fixtures.values([(k, r, f, p) for k, (r, f, p) in enumerate(L.RULES)], "ord int, rule_id string, family string, points int")
_SHARE = "CASE WHEN {n} > 0 THEN {part} / {whole}::DOUBLE ELSE 0.0 END"


def _share(part: str, whole: str, n: str, most: float = 0.8, low: str = "r > 0") -> tuple[str, str]:
    r = f"(CASE WHEN {n} > 0 THEN ({part}) / greatest({whole}, 1)::DOUBLE ELSE 0.0 END)"
    return f"CASE WHEN {n} > 0 AND {r} >= {most} THEN 'pass' WHEN {n} > 0 AND {low.replace('r ', r + ' ')} THEN 'partial' ELSE 'fail' END", r


def _fact(f: str) -> tuple[str, str]:
    s = f"s_{f}"
    return f"CASE {s} WHEN 'not_applicable' THEN 'not_applicable' WHEN 'known' THEN 'pass' WHEN 'conflicting' THEN 'partial' ELSE 'fail' END", f"CASE {s} WHEN 'known' THEN 1.0 WHEN 'conflicting' THEN 0.35 ELSE 0.0 END"


def _sql_rules() -> dict[str, tuple[str, str]]:
    own = "CASE profile WHEN 'ecommerce' THEN s_purchase_process WHEN 'service_with_booking' THEN s_booking_process WHEN 'service_with_quote_or_lead' THEN s_quote_process WHEN 'local_business' THEN s_contact_process END"
    path = "('known' IN (s_purchase_process, s_booking_process, s_quote_process, s_contact_process))"
    quote = "(profile IN ('service_with_quote_or_lead', 'local_business') AND s_quote_process = 'known')"
    price = (f"CASE WHEN s_pricing = 'known' OR {quote} THEN 'pass' WHEN s_pricing = 'not_applicable' THEN 'not_applicable' ELSE 'fail' END", f"CASE WHEN s_pricing = 'known' OR {quote} THEN 1.0 ELSE 0.0 END")
    at_home = "profile = 'local_business' AND s_address = 'known'"
    area = tuple(f"CASE WHEN {at_home} THEN {x} ELSE {y} END" for x, y in zip(("'pass'", "1.0"), _fact("service_area")))
    schema = ("CASE WHEN s_structured_data = 'known' THEN 'pass' ELSE 'fail' END", "CASE WHEN s_structured_data = 'known' THEN 1.0 ELSE 0.0 END")
    torn = f"'conflicting' IN ({', '.join(f's_{f}' for f in FIELDS)})"
    closed = "s_commercial_status = 'known' AND coalesce(closure IN ('temporarily_closed', 'permanently_closed', 'unavailable'), false)"
    season = "s_commercial_status = 'known' AND coalesce(closure = 'seasonal', false)"
    hours = "profile = 'local_business' AND s_opening_hours = 'known'"
    available = tuple(f"CASE WHEN {closed} THEN {a} WHEN {season} THEN {b} WHEN {hours} THEN {c} ELSE {d} END" for a, b, c, d in zip(("'fail'", "0.0"), ("'partial'", "0.5"), ("'pass'", "1.0"), _fact("availability")))
    free = "profile IN ('service_with_quote_or_lead', 'informational', 'local_business')"
    policy = "(CASE WHEN profile = 'ecommerce' THEN s_returns ELSE s_cancellation END) = 'known'"
    return {
        "DISC.ACCESS.001": _share("n_good", "n_pages", "n_good"),
        "DISC.ROBOTS.002": (
            "CASE WHEN n_blocked > 0 AND n_pages = 0 THEN 'fail' WHEN n_blocked > 0 OR NOT robots_accessible THEN 'partial' ELSE 'pass' END",
            "CASE WHEN n_blocked > 0 AND n_pages = 0 THEN 0.0 WHEN n_blocked > 0 OR NOT robots_accessible THEN 0.6 ELSE 1.0 END",
        ),
        "DISC.INDEX.003": (
            "CASE WHEN n_text = 0 THEN 'fail' WHEN n_noindex = 0 THEN 'pass' ELSE 'partial' END",
            "CASE WHEN n_text = 0 THEN 0.0 ELSE 1 - n_noindex / n_text::DOUBLE END",
        ),
        "DISC.CANONICAL.004": _share("n_canonical", "n_text", "n_text"),
        "DISC.SITEMAP.005": ("CASE WHEN n_sitemaps > 0 THEN 'pass' ELSE 'fail' END", "CASE WHEN n_sitemaps > 0 THEN 1.0 ELSE 0.0 END"),
        "DISC.LINKS.006": ("CASE WHEN n_text >= 3 THEN 'pass' WHEN n_text > 0 THEN 'partial' ELSE 'fail' END", "CASE WHEN n_text >= 3 THEN 1.0 WHEN n_text > 0 THEN 0.4 ELSE 0.0 END"),
        "DISC.META.007": _share("n_described", "n_text", "n_text"),
        "UNDR.IDENTITY.001": _fact("business_name"),
        "UNDR.ACTIVITY.002": _fact("activity_market"),
        "UNDR.OFFERS.003": (
            "CASE WHEN n_offers > 0 AND mean_understanding >= 0.9 THEN 'pass' WHEN n_offers > 0 THEN 'partial' WHEN profile = 'informational' THEN 'not_applicable' ELSE 'fail' END",
            "CASE WHEN n_offers > 0 THEN 0.45::DOUBLE + 0.55::DOUBLE * mean_understanding ELSE 0.0 END",
        ),
        "UNDR.PRICE.004": price,
        "UNDR.AREA.005": area,
        "UNDR.SCHEMA.006": schema,
        "UNDR.CONSISTENCY.007": (f"CASE WHEN {torn} THEN 'partial' ELSE 'pass' END", f"CASE WHEN {torn} THEN 0.3 ELSE 1.0 END"),
        "BUY.CONVERSION.001": (
            f"""CASE WHEN profile = 'informational' THEN 'not_applicable' WHEN {own} IS NULL THEN CASE WHEN {path} THEN 'partial' ELSE 'fail' END
  WHEN {own} = 'known' THEN CASE WHEN n_offers = 0 OR mean_buyability < 0.9 THEN 'partial' ELSE 'pass' END WHEN {own} = 'conflicting' THEN 'partial' WHEN {own} = 'not_applicable' THEN 'not_applicable' ELSE 'fail' END""",
            f"""CASE WHEN profile = 'informational' THEN 0.0 WHEN {own} IS NULL THEN CASE WHEN {path} THEN 0.65 ELSE 0.0 END
  WHEN {own} = 'known' THEN CASE WHEN n_offers = 0 THEN 0.65 WHEN mean_buyability < 0.9 THEN 0.65::DOUBLE + 0.35::DOUBLE * mean_buyability ELSE 1.0 END WHEN {own} = 'conflicting' THEN 0.35 ELSE 0.0 END""",
        ),
        "BUY.PRICE.002": price,
        "BUY.AVAILABILITY.003": available,
        "BUY.AREA.004": area,
        "BUY.PAYMENT.005": _fact("payment"),
        "BUY.POLICY.006": (f"CASE WHEN {free} THEN 'not_applicable' WHEN {policy} THEN 'pass' ELSE 'fail' END", f"CASE WHEN NOT {free} AND {policy} THEN 1.0 ELSE 0.0 END"),
        "BUY.MACHINE.007": schema,
    }


def results_sql(sites: str) -> str:
    """CTEs ``r0`` and ``results`` over a table of signals with the columns of SITE_SCHEMA."""
    each = _sql_rules()
    status = " ".join(f"WHEN '{r}' THEN {each[r][0]}" for r, _, _ in L.RULES)
    ratio = " ".join(f"WHEN '{r}' THEN ({each[r][1]})::DOUBLE" for r, _, _ in L.RULES)
    return f"""r0 AS (SELECT g.*, ord, rule_id, family, points, CASE rule_id {status} END AS status, CASE rule_id {ratio} END AS ratio FROM {sites} g, {_R}),
results AS (SELECT *, CASE WHEN status = 'not_applicable' THEN 0 ELSE points END AS points_possible, CASE WHEN status = 'not_applicable' THEN 0.0 ELSE round_even(points * ratio, 2) END AS points_awarded FROM r0)"""


SCORES_SQL = """y AS (SELECT site_id, family, CASE WHEN sum(points_possible) > 0 THEN round_even(round(100 * sum(points_awarded) / sum(points_possible), 9), 0) ELSE 100 END::INT AS s FROM results GROUP BY 1, 2),
z AS (SELECT site_id, max(s) FILTER (family = 'ai_discoverability') AS ai_discoverability, max(s) FILTER (family = 'understanding') AS understanding, max(s) FILTER (family = 'buyability') AS buyability FROM y GROUP BY 1)
SELECT *, round_even(round(0.30 * ai_discoverability + 0.35 * understanding + 0.35 * buyability, 9), 0)::INT AS ai_readiness FROM z"""


def _sanity_sql() -> str:
    here = lambda f: f"s_{f} IN ('known', 'conflicting')"
    proved = "(right(site_id, 1)::INT % 2 = 1)"
    out = "CASE"
    # The last reason stands, so the first in a CASE.
    policy = f"(CASE WHEN profile = 'ecommerce' THEN {here('returns')} ELSE {here('cancellation')} END) AND {proved}"
    out += f" WHEN rule_id = 'BUY.POLICY.006' AND {policy} THEN 'policy'"
    path = " OR ".join(here(f) for f in ("purchase_process", "booking_process", "quote_process", "contact_process"))
    out += f" WHEN rule_id = 'BUY.CONVERSION.001' AND ({path}) AND {proved} THEN 'path'"
    out += " WHEN rule_id = 'BUY.AVAILABILITY.003' AND s_commercial_status = 'known' THEN 'fact:commercial_status'"
    out += " WHEN rule_id IN ('UNDR.PRICE.004', 'BUY.PRICE.002') AND has_price_value THEN 'offer:price'"
    for rule_id, f in rules.FIELD_OF_RULE.items():
        out += f" WHEN rule_id = '{rule_id}' AND {here(f)} THEN 'fact:{f}'"
    return out + " END"


_LISTED = fixtures.values([(r, i, t) for r, i, t, _, _ in L.RECOMMENDATIONS], "rule_id string, impact int, title string")
_ISSUES = f"""WITH {results_sql(_G)},
i0 AS (SELECT r.*, impact, title, row_number() OVER (PARTITION BY site_id, title ORDER BY ord) AS n FROM results r JOIN {_LISTED} USING (rule_id) WHERE status IN ('fail', 'partial')),
i AS (SELECT *, printf('issue-%03d', row_number() OVER (PARTITION BY site_id ORDER BY ord)) AS issue_id, {_sanity_sql()} AS contradiction FROM i0 WHERE n = 1)"""

def _proof_sql() -> str:
    told = lambda f: f"CASE WHEN s_{f} IN ('known', 'conflicting') THEN '{f}' END"
    own = {"ecommerce": "purchase_process", "service_with_booking": "booking_process", "service_with_quote_or_lead": "quote_process", "local_business": "contact_process"}
    closed = "s_commercial_status = 'known' AND coalesce(closure IN ('temporarily_closed', 'permanently_closed', 'unavailable', 'seasonal'), false)"
    price = "CASE WHEN s_pricing = 'known' THEN 'pricing' WHEN profile IN ('service_with_quote_or_lead', 'local_business') AND s_quote_process = 'known' THEN 'quote_process' END"
    area = f"CASE WHEN profile = 'local_business' AND s_address = 'known' THEN 'address' ELSE {told('service_area')} END"
    schema = "CASE WHEN s_structured_data = 'known' THEN 'structured_data' END"
    each = {
        "UNDR.IDENTITY.001": told("business_name"), "UNDR.ACTIVITY.002": told("activity_market"), "BUY.PAYMENT.005": told("payment"), "UNDR.OFFERS.003": f"CASE WHEN n_offers > 0 THEN '{rules.OFFERS}' END", "UNDR.PRICE.004": price, "BUY.PRICE.002": price,
        "UNDR.AREA.005": area, "BUY.AREA.004": area, "UNDR.SCHEMA.006": schema, "BUY.MACHINE.007": schema, "UNDR.CONSISTENCY.007": f"CASE WHEN 'conflicting' IN ({', '.join(f's_{f}' for f in FIELDS)}) THEN '{rules.CONFLICTS}' END",
        "BUY.CONVERSION.001": "CASE profile WHEN 'informational' THEN NULL " + " ".join(f"WHEN '{p}' THEN {told(f)}" for p, f in own.items()) + " ELSE CASE " + " ".join(f"WHEN s_{f} = 'known' THEN '{f}'" for f in own.values()) + " END END",
        "BUY.AVAILABILITY.003": f"CASE WHEN {closed} THEN 'commercial_status' WHEN profile = 'local_business' AND s_opening_hours = 'known' THEN 'opening_hours' ELSE {told('availability')} END",
        "BUY.POLICY.006": "CASE WHEN profile IN ('service_with_quote_or_lead', 'informational', 'local_business') THEN NULL WHEN profile = 'ecommerce' THEN CASE WHEN s_returns = 'known' THEN 'returns' END ELSE CASE WHEN s_cancellation = 'known' THEN 'cancellation' END END",
    }
    return "CASE rule_id " + " ".join(f"WHEN '{r}' THEN {x}" for r, x in each.items()) + " END"


_NAMED = "[" + ", ".join(f"'{f}'" for f in FIELDS) + "]"
_ALL_FIELDS = "[" + ", ".join(f"'{f}'" for f in L.FACT_FIELDS) + "]"

ORACLES = {
    "rule_evidence": f"""WITH {results_sql(_G)},
p AS (SELECT site_id, rule_id, {_proof_sql()} AS proof FROM results),
o AS (SELECT 'g' || o_custkey AS site_id, o_orderkey AS k, o_orderstatus, {_NAMED}[o_orderkey % {len(FIELDS)} + 1] AS field FROM orders),
f AS (SELECT site_id, field, list('o' || k ORDER BY k)[1:15] AS e FROM o GROUP BY 1, 2),
s AS (SELECT site_id, unnest({_NAMED}) AS field, unnest([{', '.join(f's_{f}' for f in FIELDS)}]) AS state FROM {_G} g),
c AS (SELECT site_id, flatten(list(e ORDER BY list_position({_ALL_FIELDS}, field)))[1:10] AS e FROM s JOIN f USING (site_id, field) WHERE state = 'conflicting' GROUP BY 1),
n AS (SELECT site_id, flatten(list(['o' || k, 'o' || k] ORDER BY k))[1:10] AS e FROM o WHERE o_orderstatus = 'O' GROUP BY 1),
u AS (SELECT site_id, field AS proof, e FROM s JOIN f USING (site_id, field) WHERE state IN ('known', 'conflicting') UNION ALL SELECT site_id, '{rules.CONFLICTS}', e FROM c UNION ALL SELECT site_id, '{rules.OFFERS}', e FROM n)
SELECT p.site_id, rule_id, p.proof, coalesce(len(e), 0)::INT AS n_evidence, e[1] AS first_url, e[-1] AS last_url FROM p LEFT JOIN u ON u.site_id = p.site_id AND u.proof = p.proof""",
    "rule_branches": f"WITH {results_sql(_G)} SELECT site_id, rule_id, status, points_awarded::DOUBLE AS points_awarded, points_possible FROM results",
    "score_branches": f"WITH {results_sql(_G)}, {SCORES_SQL}",
    "sanity_branches": f"{_ISSUES} SELECT site_id, issue_id, rule_id, contradiction FROM i",
    "final_issues": f"""{_ISSUES}, u AS (SELECT site_id, issue_id, rule_id, impact, 0 AS n_evidence FROM i WHERE contradiction IS NULL
  UNION ALL SELECT site_id, printf('inconsistency-price-%d', k), '{rules.CONFLICT_RULE}', {rules.CONFLICT_IMPACT}, 1 FROM (SELECT site_id FROM {_G} g WHERE substr(site_id, 2)::INT % 9 = 0), range(1, 3) t(k))
SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY impact DESC, issue_id)::INT AS place FROM u""",
}
