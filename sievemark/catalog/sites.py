"""Site audit queries: parsing, facts, offers, profiles, rules, coverage, recommendations, crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures, sql
from .. import lexicons as L
from ..operators import consolidate, crawl, facts, offers, profile, rules
from ..plans import siteaudit
from ..sources import html
from . import branches
from .pages import PAGE_SCHEMA, all_pages
from .pages import crawl as crawled
from .texts import _HOST, _REL


def html_parse_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = html.parse(crawled(spark, sf_dir), ["page_id", "url"])
    return p.select("page_id", F.size("links").alias("n_links"), F.size("headings").alias("n_headings"), F.size("blocks").alias("n_blocks"), F.size("jsonld").alias("n_jsonld"), "description", "canonical")


def sql_page_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages parsed from SQL, by the registered functions."""
    sql.register(spark)
    crawled(spark, sf_dir).createOrReplaceTempView("crawled_pages")
    return spark.sql("SELECT url_host(url) AS site, count(*) AS n_pages, sum(size(h.links)) AS n_links, sum(size(h.headings)) AS n_headings, count_if(is_relevant_url(url)) AS n_relevant FROM crawled_pages, LATERAL parse_html(url, html) h GROUP BY url_host(url)")


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = html.parse(all_pages(spark, sf_dir), ["page_id"], "url")
    return p.select("page_id", F.posexplode("blocks").alias("ix", "b")).select("page_id", "ix", "b.heading", "b.tag", F.length("b.text").alias("n_text"), F.size("b.actions").alias("n_actions"), F.size("b.ancestors").alias("n_ancestors"))


def html_under_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    from functools import reduce

    pages = all_pages(spark, sf_dir)
    h = F.col("html")
    counted = pages.withColumn("n_js", reduce(lambda a, b: a + b, (h.rlike(f"(?i){m}").cast("int") for m in L.JS_APP_MARKERS))).withColumn("n_scripts", F.regexp_count(h, F.lit(r"(?i)<script\b")))
    return siteaudit.under_render_reason(html.parse(counted, ["page_id", "n_js", "n_scripts"], "url")).select("page_id", "render_reason")


def _jsonld_pages(spark: SparkSession) -> DataFrame:
    rows = [(i, f"https://j{i}.test/p", f"<html><body><h1>x</h1><script type='application/ld+json'>{j}</script></body></html>") for i, j in fixtures.JSONLD]
    return siteaudit.parsed_pages(fixtures.table(spark, rows, PAGE_SCHEMA))


def jsonld_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.schema_types(_jsonld_pages(spark)).select("site_id", "type", "n")


def jsonld_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.node_candidates(_jsonld_pages(spark)).select("site_id", "field", "value", "confidence")


def jsonld_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers.node_offers(_jsonld_pages(spark), siteaudit.AS_OF).select("site_id", "name", "offer_type", "candidate_role", "price_value", "currency", "availability")


FACT_SCHEMA = "site_id string, page_ord int, ord int, field string, value string, confidence double, url string"


def _facts(spark: SparkSession) -> DataFrame:
    from ..functions.text import evidence

    t = fixtures.table(spark, fixtures.FACTS, FACT_SCHEMA)
    return t.select("site_id", "page_ord", "ord", "field", "value", evidence(F.col("url"), "visible_text", F.col("value")).alias("evidence"), "confidence")


def facts_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates per field over the crawl and the signal pages."""
    p = siteaudit.parsed_pages(all_pages(spark, sf_dir))
    return facts.text_candidates(p).groupBy("field").agg(F.count("*").alias("n_candidates"), F.countDistinct("site_id").alias("n_sites"))


def fact_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = facts.resolve(_facts(spark))
    return r.select("site_id", "field", F.array_join("values", "|").alias("vals"), F.array_join(F.transform("evidence", lambda e: e["url"]), "|").alias("urls"), "confidence")


def status_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = facts.with_status(facts.resolve(_facts(spark)))
    return r.where("field in ('commercial_status', 'availability')").select("site_id", "field", F.array_join("values", "|").alias("vals"), "confidence")


def not_applicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = spark.createDataFrame([(p, p) for p in (*profile.PROFILES, "unknown")], "site_id string, profile string")
    found = facts.resolve(fixtures_known(spark, sites))
    out = facts.apply_profile(facts.complete(found, sites), sites)
    return out.groupBy("site_id", "state").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("field")), ",").alias("fields")).where("state <> 'unknown'")


def fixtures_known(spark: SparkSession, sites: DataFrame) -> DataFrame:
    """Every site knows its returns."""
    from ..functions.text import evidence

    return sites.select("site_id", F.lit(1).alias("page_ord"), F.lit(1).alias("ord"), F.lit("returns").alias("field"), F.lit("30 jours").alias("value"), evidence(F.lit("u"), "visible_text", F.lit("30 jours")).alias("evidence"), F.lit(0.75).alias("confidence"))


OFFER_SCHEMA = "site_id string, ord int, name string, url string, offer_type string, candidate_role string, cta string, price string, price_value double, availability string, description string, confidence double"
_EVIDENCE = "array<struct<url:string,kind:string,excerpt:string,selector:string>>"


def _offers(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    t = fixtures.table(spark, fixtures.OFFERS if rows is None else rows, OFFER_SCHEMA)
    none = F.lit(None).cast("string")
    proof = F.array(F.struct(F.col("url"), F.lit("cta").alias("kind"), F.col("name").alias("excerpt"), none.alias("selector")))
    extra = {"page_ord": F.lit(1), "price_original": F.col("price"), "price_evidence": F.array().cast(_EVIDENCE), "currency": F.when(F.col("price").isNotNull(), "EUR"), "frequency": none, "cta_url": none, "evidence": proof}
    return t.withColumns(extra).select(*offers.COLUMNS)


def offers_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = [("s9", 1, "Lampe", "https://s9.test/x#offer-1", "product", "product", None, None, None, None, "a", 0.6), ("s9", 2, "LAMPE", "https://s9.test/x", "product", "product", "Acheter", "5 €", 5.0, None, "b", 0.5), ("s9", 3, "Lampé", "https://s9.test/x#offer-2", "product", "product", "Commander", "6 €", 6.0, None, "c", 0.9), ("s9", 4, "Lampe", "https://s9.test/y", "product", "product", None, None, None, None, None, 0.4)]
    out = offers.dedupe(_offers(spark, [*fixtures.OFFERS, *more]))
    return out.select("site_id", "name", "url", "price", "cta", F.size("evidence").alias("n_evidence"), "confidence")


def offers_rank_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(f"t{s}", k, f"Objet {k:03d}", f"https://t{s}.test/{k % 7}", "product", "product", None, None, None, None, None, round(0.4 + (k * 7 % 11) / 20, 2)) for s in range(2) for k in range(30 + 30 * s)]
    out = offers.top(_offers(spark, rows))
    return out.select("site_id", "name", "rank", "n_total")


def offers_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.createDataFrame([("s3", "https://s3.test/soin", 1, None)], "site_id string, url string, page_ord int, canonical string")
    profiles = spark.createDataFrame([("s3", "local_business"), ("s1", "service_with_booking"), ("s2", "ecommerce")], "site_id string, profile string")
    out = consolidate.consolidate(_offers(spark), consolidate.page_canonicals(pages), profiles)
    return out.select("site_id", "name", "merged_count", F.array_join("reasons", "|").alias("reasons"), "price", "relationship", F.size("evidence").alias("n_evidence"), "n_candidates")


def offer_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of the signal pages' blocks."""
    p = siteaudit.parsed_pages(fixtures.table(spark, fixtures.PAGES, PAGE_SCHEMA))
    return offers.page_offers(p).select("site_id", "name", "offer_type", "candidate_role", "price_value", "currency", "cta", "availability", "confidence")


def offer_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _offers(spark).withColumn("profile", F.element_at(F.array(*map(F.lit, ("ecommerce", "service_with_booking", "service_with_quote_or_lead", "local_business"))), F.col("ord") % 4 + 1))
    u, b = offers.completeness(F.col("profile"), F.lit(False), F.lit(True))
    return t.select("site_id", "ord", F.round(u, 6).alias("understanding"), F.round(b, 6).alias("buyability"))


def price_inconsistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.createDataFrame([("s1", "https://s1.test/c", 1, "Cours à 20 €"), ("s2", "https://s2.test/lampe", 1, "Lampe 31 €"), ("s2", "https://s2.test/lampe", 2, "Lampe 30 €"), ("s2", "https://s2.test/table", 3, "Table 90 €")], "site_id string, url string, page_ord int, text string")
    return rules.price_conflicts(_offers(spark), pages).select("site_id", "url", "n_offers", F.size("evidence").alias("n_evidence"))


_SIGNS = ("has_paid", "has_buy_cta", "has_booking", "has_service", "type_Product", "type_Offer", "type_Reservation", "type_Event", "type_Service", "type_LocalBusiness", "knows_pricing", "knows_payment", "knows_purchase_process", "knows_booking_process", "knows_quote_process", "knows_contact_process", "knows_availability", "knows_address", "knows_opening_hours", "knows_business_description", "describes_service")
_COUNTS = ("n_pages", "n_offers", "urls_purchase_process", "urls_booking_process", "urls_quote_process")
PROFILE_SCHEMA = "site_id string, " + ", ".join(f"{s} boolean" for s in _SIGNS) + ", " + ", ".join(f"{c} int" for c in _COUNTS)
#: 300 sites whose signs come from a fixed arithmetic rule, so that every branch is met.
PROFILE_ROWS = [
    (f"p{i:03d}", *((i * (2 * k + 3) + k * k + i * i // (k + 2)) % (3 + (k + i) % 4) == 0 for k in range(len(_SIGNS))), i % 3, i % 4, i * 3 % 4, i * 5 % 4, i * 7 % 4) for i in range(300)
]


def profile_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.classify(fixtures.table(spark, PROFILE_ROWS, PROFILE_SCHEMA)).select("site_id", "profile", "ambiguous", F.round("confidence", 2).alias("confidence"))


def rule_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = siteaudit.audit(siteaudit.parsed_pages(crawled(spark, sf_dir)))
    return a.results.select("site_id", "rule_id", "status", "points_awarded", "points_possible")


def site_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = siteaudit.audit(siteaudit.parsed_pages(crawled(spark, sf_dir)))
    return a.scores


def site_audit_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole audit over the signal pages: profile, scores, offers kept and issues of each site."""
    a = siteaudit.audit(siteaudit.parsed_pages(fixtures.table(spark, fixtures.PAGES, PAGE_SCHEMA)))
    issues = a.issues.groupBy("site_id").agg(F.count_if(F.col("contradiction").isNull()).alias("n_issues"), F.count_if(F.col("contradiction").isNotNull()).alias("n_rejected"))
    return a.scores.join(a.profiles.select("site_id", "profile", F.col("n_offers").alias("n_offers")), "site_id").join(issues, "site_id", "left").join(a.coverage.select("site_id", "coverage_confidence", "coverage_status", "adjusted_readiness"), "site_id")


COVERAGE_SCHEMA = "label string, pages_analyzed int, pages_discovered int, page_limit_reached boolean, headless_needed int, headless_used int, headless_budget_reached boolean, offers_detected int, offers_kept int, readiness int, non_html_skipped int"


def coverage_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.coverage(fixtures.table(spark, fixtures.COVERAGE, COVERAGE_SCHEMA))
    return out.select("label", "coverage_confidence", "coverage_status", "adjusted_readiness", F.size("coverage_reasons").alias("n_reasons"))


#: Results of three sites by a fixed rule over the registry.
RESULT_ROWS = [(f"r{s}", k, r, f, ("fail", "partial", "pass", "not_applicable")[(k * 5 + s * 3 + k * k) % 4], float(p) / 2, p) for s in range(3) for k, (r, f, p) in enumerate(L.RULES)]
RESULT_SCHEMA = "site_id string, ord int, rule_id string, score string, status string, points_awarded double, points_possible int"


def issues_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    out = rules.recommendations(spark, fixtures.table(spark, RESULT_ROWS, RESULT_SCHEMA))
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("impact"), "rule_id"))
    return out.select("site_id", "issue_id", "rule_id", "impact", "priority", rank.alias("rank"))


def issues_sanity_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = rules.recommendations(spark, fixtures.table(spark, RESULT_ROWS, RESULT_SCHEMA))
    rows = [("r0", "ecommerce", {"pricing": "known", "returns": "known"}, {"pricing": ["5 €"], "returns": ["x"]}, {"pricing": 1, "returns": 1}, False), ("r1", "unknown", {"commercial_status": "known", "availability": "unknown", "contact_process": "known"}, {}, {"contact_process": 2}, True), ("r2", "local_business", {"payment": "conflicting", "service_area": "known"}, {"payment": ["visa"], "service_area": []}, {"service_area": 3}, False)]
    sites = spark.createDataFrame(rows, "site_id string, profile string, state map<string,string>, values map<string,array<string>>, n_proofs map<string,int>, has_price_value boolean")
    return rules.sanity(issues, sites).select("site_id", "rule_id", "contradiction")


def crawl_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([("https://g.test/",)], "origin string")
    out = crawl.breadth_first(seeds, fixtures.table(spark, fixtures.LINKS, "src string, dst string, ord int"), 3, 5)
    return out.select("url", "depth", "place", "visited")


def robots_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.table(spark, fixtures.ROBOTS, "site_id string, robots_txt string")
    return t.select("site_id", F.posexplode(crawl.sitemaps_of(F.col("robots_txt"), F.concat(F.lit("https://"), "site_id", F.lit(".test")))).alias("ord", "sitemap"))


def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.table(spark, fixtures.ROBOTS, "site_id string, robots_txt string")
    paths = t.select("site_id", F.explode(F.array(*map(F.lit, ("/", "/private", "/private/open/x", "/else")))).alias("path"))
    return crawl.may_fetch(paths.withColumn("url", F.concat(F.lit("https://x.test"), "path")), crawl.robots_rules(t, "sievemark")).select("site_id", "path", "allowed")


def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.table(spark, fixtures.SITEMAPS, "origin string, sitemap string, xml string")
    start = t.where("sitemap like '%index.xml' or sitemap like '%broken.xml'").select("origin", "sitemap")
    return crawl.sitemap_pages(start, t.select("sitemap", "xml")).select("sitemap", "url")


QUERIES = {
    f.__name__: f
    for f in (
        html_parse_summary, sql_page_parse, html_blocks, html_under_render, jsonld_type_counts, jsonld_facts, jsonld_offers, facts_long, fact_resolution, status_priority, not_applicable, offers_dedupe, offers_rank_top50,
        offers_consolidated, offer_extraction, offer_completeness, price_inconsistency, profile_classification, rule_results, site_scores, site_audit_signals, coverage_confidence, issues_ranked,
        issues_sanity_rejected, crawl_bfs, robots_sitemaps, robots_rules, sitemap_urls,
    )
}

V = fixtures.values
_S = {s: s for s in _SIGNS}
_PTS = """
  4 * has_paid::INT + 6 * (has_buy_cta OR knows_purchase_process)::INT + 2 * (knows_pricing AND knows_payment)::INT + 4 * (type_Product OR type_Offer)::INT AS s1,
  has_paid::INT + (has_buy_cta OR knows_purchase_process)::INT + (knows_pricing AND knows_payment)::INT + (type_Product OR type_Offer)::INT AS f1,
  4 * has_booking::INT + 7 * (knows_booking_process OR type_Reservation OR type_Event)::INT + ((has_booking OR knows_booking_process) AND knows_availability)::INT AS s2,
  has_booking::INT + (knows_booking_process OR type_Reservation OR type_Event)::INT + ((has_booking OR knows_booking_process) AND knows_availability)::INT AS f2,
  7 * knows_quote_process::INT + 2 * (knows_quote_process AND describes_service)::INT + 3 * (has_service AND knows_contact_process)::INT + 2 * (type_Service AND knows_contact_process)::INT AS s3,
  knows_quote_process::INT + (knows_quote_process AND describes_service)::INT + (has_service AND knows_contact_process)::INT + (type_Service AND knows_contact_process)::INT AS f3,
  4 * type_LocalBusiness::INT + 4 * (knows_address AND knows_opening_hours)::INT + (knows_address AND knows_contact_process)::INT AS s4,
  type_LocalBusiness::INT + (knows_address AND knows_opening_hours)::INT + (knows_address AND knows_contact_process)::INT AS f4,
  5 * (knows_business_description AND NOT commercial)::INT + 2 * (n_pages >= 2 AND NOT commercial)::INT AS s5"""
_REG = V([(r, i, t) for r, i, t, _, _ in L.RECOMMENDATIONS], "rule_id string, impact int, title string")
_RES = V(RESULT_ROWS, RESULT_SCHEMA)
_ISSUES = f"""i0 AS (SELECT r.site_id, r.ord, r.rule_id, impact, row_number() OVER (PARTITION BY site_id, title ORDER BY r.ord) AS n FROM {_RES} r JOIN {_REG} g USING (rule_id) WHERE status IN ('fail', 'partial')),
i AS (SELECT site_id, rule_id, impact, printf('issue-%03d', row_number() OVER (PARTITION BY site_id ORDER BY ord)) AS issue_id FROM i0 WHERE n = 1)"""
_O = V(fixtures.OFFERS, OFFER_SCHEMA)
#: Signals of crawled sites, counted in their HTML. Their invented prose names no commercial fact; structured data would show as JSON-LD.
_CRAWLED = f"""(SELECT site_id, count(*)::INT AS n_pages, count(*) FILTER (words)::INT AS n_good, count(*) FILTER (words)::INT AS n_text, count(*) FILTER (words AND noindex)::INT AS n_noindex,
    count(*) FILTER (words AND canonical = site_id)::INT AS n_canonical, count(*) FILTER (words AND titled AND described)::INT AS n_described, 0 AS n_blocked, false AS robots_accessible, 0 AS n_sitemaps,
    'unknown' AS profile, 0 AS n_offers, 0.0 AS mean_understanding, 0.0 AS mean_buyability, NULL::VARCHAR AS closure, {", ".join("CASE WHEN bool_or(ld) THEN 'known' ELSE 'unknown' END AS s_structured_data" if f == "structured_data" else f"'unknown' AS s_{f}" for f in branches.FIELDS)}
  FROM (SELECT {_HOST} AS site_id, regexp_matches(regexp_replace(regexp_replace(html, '(?is)<(script|style|head)[ >].*?</(script|style|head)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\S') AS words,
      regexp_matches(html, '(?i)<meta[^>]+noindex') AS noindex, regexp_extract(html, '(?i)<link[^>]+canonical[^>]+href="https?://([^/"]+)', 1) AS canonical,
      regexp_matches(html, '(?i)<title>[^<]*\\S') AS titled, regexp_matches(html, '(?i)<meta[^>]+name="description"') AS described, contains(html, 'application/ld+json') AS ld FROM pages) GROUP BY 1)"""
_RULES_SQL = f"WITH {branches.results_sql(_CRAWLED)}"

ORACLES = {
    "html_parse_summary": r"""SELECT page_id, len(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1)))::INT AS n_links, len(list_distinct(regexp_extract_all(html, '<h[1-3]>')))::INT AS n_headings,
  len(regexp_extract_all(html, '<h[1-3]>'))::INT AS n_blocks, 0 AS n_jsonld, '' AS description, NULL::VARCHAR AS canonical FROM pages""",
    "sql_page_parse": rf"""SELECT {_HOST} AS site, count(*) AS n_pages, sum(len(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))))::BIGINT AS n_links, sum(len(list_distinct(regexp_extract_all(html, '<h[1-3]>'))))::BIGINT AS n_headings,
  count(*) FILTER ({_REL}) AS n_relevant FROM pages GROUP BY 1""",
    "jsonld_type_counts": "SELECT * FROM " + V([("j1.test", "Product", 1), ("j1.test", "Offer", 1), ("j2.test", "Organization", 1), ("j2.test", "Store", 1), ("j2.test", "FAQPage", 1), ("j3.test", "Event", 2), ("j5.test", "Course", 1)], "site_id string, type string, n bigint"),
    "jsonld_facts": "SELECT * FROM " + V([("j1.test", "pricing", "29.00", 1.0), ("j1.test", "availability", "InStock", 1.0), ("j2.test", "business_name", "Acme", 1.0), ("j2.test", "address", "1 rue A, Paris", 1.0), ("j2.test", "faq", "FAQPage", 1.0)], "site_id string, field string, value string, confidence double"),
    "jsonld_offers": "SELECT * FROM " + V([("j1.test", "Gourde", "product", "product", 29.0, "EUR", "InStock"), ("j3.test", "New", "reservation", "booking", None, None, None), ("j5.test", "Loom", "formation", "formation", 10.0, "USD", None)], "site_id string, name string, offer_type string, candidate_role string, price_value double, currency string, availability string"),
    "fact_resolution": f"""WITH c AS (SELECT *, trim(regexp_replace(value, '\\s+', ' ', 'g')) AS v FROM {V(fixtures.FACTS, FACT_SCHEMA)}),
k AS (SELECT *, lower(v) AS key, first_value(v) OVER w AS first_v, first_value(confidence) OVER w AS first_c, first_value(page_ord * 1000 + ord) OVER w AS place,
  row_number() OVER w AS r FROM c WHERE v <> '' WINDOW w AS (PARTITION BY site_id, field, lower(v) ORDER BY page_ord, ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
d AS (SELECT *, dense_rank() OVER (PARTITION BY site_id, field ORDER BY place) AS rank FROM k),
e AS (SELECT *, row_number() OVER (PARTITION BY site_id, field ORDER BY rank, r) AS n FROM d WHERE rank <= 12)
SELECT site_id, field, string_agg(first_v, '|' ORDER BY rank) FILTER (r = 1) AS vals, string_agg(url, '|' ORDER BY n) FILTER (n <= 15) AS urls, max(first_c) AS confidence FROM e GROUP BY 1, 2""",
    "status_priority": "SELECT * FROM " + V([("s1", "commercial_status", "temporarily_closed", 1.0), ("s1", "availability", "temporarily_closed", 1.0), ("s2", "commercial_status", "seasonal", 1.0), ("s2", "availability", "seasonal", 1.0)], "site_id string, field string, vals string, confidence double"),
    "not_applicable": "SELECT * FROM ("
    + " UNION ALL ".join(
        [f"SELECT '{p}' AS site_id, 'known' AS state, 1::BIGINT AS n, 'returns' AS fields" for p in (*profile.PROFILES, "unknown")]
        + [f"SELECT '{p}', 'not_applicable', {len([f for f in v if f != 'returns'])}::BIGINT, '{','.join(sorted(f for f in v if f != 'returns'))}'" for p, v in L.NOT_APPLICABLE.items()]
    )
    + ")",
    "offers_dedupe": f"""SELECT site_id, name, url, price, cta, 1 AS n_evidence, confidence FROM {_O} UNION ALL SELECT * FROM
{V([("s9", "Lampé", "https://s9.test/x#offer-2", "6 €", "Commander", 3, 0.9), ("s9", "Lampe", "https://s9.test/y", None, None, 1, 0.4)], "site_id string, name string, url string, price string, cta string, n_evidence int, confidence double")}""",
    "offers_rank_top50": """SELECT site_id, name, rank::INT AS rank, n_total FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY c DESC, url, name) AS rank, count(*) OVER (PARTITION BY site_id) AS n_total FROM (
  SELECT 't' || s AS site_id, printf('Objet %03d', k) AS name, 'https://t' || s || '.test/' || (k % 7) AS url, round(0.4 + (k * 7 % 11) / 20.0, 2) AS c FROM range(2) t(s), range(60) u(k) WHERE k < 30 + 30 * s)) WHERE rank <= 50""",
    "offers_consolidated": "SELECT * FROM " + V(
        [("s1", "Réserver un cours", 3, "repeated_booking_cta|repeated_booking_cta", "20 €", "standalone", 3, 3), ("s2", "Lampe Nord", 3, "same_name_and_repeated_cta|process_step_attached_to_same_canonical_offer", "30 €", "standalone", 3, 4), ("s2", "Table Sud", 1, "", "90 €", "standalone", 1, 4), ("s3", "Massage", 3, "same_name_and_canonical_url|local_subservice_same_canonical_page", None, "category_with_subservices", 3, 3)],
        "site_id string, name string, merged_count int, reasons string, price string, relationship string, n_evidence int, n_candidates int",
    ),
    "offer_completeness": f"""SELECT site_id, ord, round(CASE p WHEN 1 THEN (a + t + d + pr + av) / 5.0 WHEN 2 THEN (a + t + d + pr + av) / 5.0 WHEN 3 THEN (a + t + d + 1) / 4.0 ELSE (a + t + d) / 3.0 END, 6) AS understanding,
  round(CASE p WHEN 1 THEN (pr + c + av) / 3.0 WHEN 2 THEN (c + pr + av) / 3.0 ELSE 1.0 END, 6) AS buyability
FROM (SELECT site_id, ord, ord % 4 + 1 AS p, 1 AS a, (offer_type <> 'unknown')::INT AS t, (coalesce(description, '') <> '')::INT AS d, (coalesce(price, '') <> '')::INT AS pr, (coalesce(availability, '') <> '')::INT AS av, (coalesce(cta, '') <> '')::INT AS c FROM {_O})""",
    "price_inconsistency": "SELECT * FROM " + V([("s2", "https://s2.test/lampe", 1, 1)], "site_id string, url string, n_offers bigint, n_evidence int"),
    "profile_classification": f"""WITH a AS (SELECT *, n_offers > 0 OR has_paid OR has_booking OR knows_pricing OR knows_purchase_process OR knows_booking_process OR knows_quote_process AS commercial FROM {V(PROFILE_ROWS, PROFILE_SCHEMA)}),
b AS (SELECT *, {_PTS} FROM a),
l AS (
  SELECT site_id, 'ecommerce' AS p, s1 AS s, s1 >= 4 AND f1 >= 2 AS fit, (urls_purchase_process >= 2 OR type_Product OR type_Offer) AND s1 >= 6 AS strong FROM b
  UNION ALL SELECT site_id, 'service_with_booking', s2, s2 >= 4 AND f2 >= 2, (urls_booking_process >= 2 OR (has_booking AND NOT knows_quote_process)) AND s2 >= 7 FROM b
  UNION ALL SELECT site_id, 'service_with_quote_or_lead', s3, s3 >= 4 AND f3 >= 2, urls_quote_process >= 2 AND s3 >= 7 FROM b
  UNION ALL SELECT site_id, 'local_business', s4, s4 >= 4 AND f4 >= 2, knows_address AND knows_opening_hours AND urls_quote_process < 2 AND s4 >= 4 FROM b
  UNION ALL SELECT site_id, 'informational', s5, s5 >= 5, false FROM b),
t AS (SELECT site_id, list({{'s': s, 'p': p}} ORDER BY s DESC, p) FILTER (fit) AS f, list({{'s': s, 'p': p}} ORDER BY s DESC, p) FILTER (strong) AS g, max(s) AS m FROM l GROUP BY 1),
z AS (SELECT b.*, t.m, coalesce(len(f), 0) AS nf, f[1].p AS fp, coalesce(f[1].s, 0) AS f1s, coalesce(f[2].s, 0) AS f2s, coalesce(len(g), 0) AS ng, g[1].p AS gp, coalesce(g[1].s, 0) AS g1s, coalesce(g[2].s, 0) AS g2s FROM b JOIN t USING (site_id)),
y AS (SELECT *, CASE WHEN ng = 1 OR (ng > 1 AND g1s - g2s >= 2) THEN 1
  WHEN urls_booking_process > 0 AND s2 >= 7 AND urls_booking_process > urls_quote_process AND urls_booking_process >= urls_purchase_process THEN 2
  WHEN urls_quote_process > 0 AND s3 >= 7 AND urls_quote_process > urls_booking_process AND urls_quote_process >= urls_purchase_process THEN 3
  WHEN nf = 0 THEN 4 WHEN f2s >= 4 AND f1s - f2s <= 2 THEN 5 ELSE 6 END AS branch FROM z)
SELECT site_id, CASE branch WHEN 1 THEN gp WHEN 2 THEN 'service_with_booking' WHEN 3 THEN 'service_with_quote_or_lead' WHEN 6 THEN fp ELSE 'unknown' END AS profile,
  CASE branch WHEN 4 THEN m > 0 WHEN 5 THEN true ELSE false END AS ambiguous,
  round(round_even(CASE branch WHEN 1 THEN least(0.97::DOUBLE, 0.55 + g1s * 0.035::DOUBLE + (g1s - g2s) * 0.015::DOUBLE) WHEN 2 THEN 0.88 WHEN 3 THEN 0.88 WHEN 4 THEN 0.25
    WHEN 5 THEN least(0.55::DOUBLE, 0.30::DOUBLE + f1s / 40.0::DOUBLE) ELSE least(0.97::DOUBLE, 0.42::DOUBLE + f1s * 0.045::DOUBLE + (f1s - f2s) * 0.02::DOUBLE) END::DOUBLE, 2), 2)::DOUBLE AS confidence
FROM y""",
    "rule_results": _RULES_SQL + " SELECT site_id, rule_id, status, points_awarded::DOUBLE AS points_awarded, points_possible FROM results",
    "site_scores": f"{_RULES_SQL}, {branches.SCORES_SQL}",
    "coverage_confidence": f"""WITH a AS (SELECT *, greatest(pages_analyzed, pages_discovered) AS d, greatest(offers_detected, offers_kept) AS o, offers_detected > offers_kept AS cut FROM {V(fixtures.COVERAGE, COVERAGE_SCHEMA)}),
b AS (SELECT *, round_even(100 * (0.55 * (CASE WHEN page_limit_reached THEN 0.7 ELSE 1 END) * (0.6 + 0.4 * sqrt(CASE WHEN d > 0 THEN least(1.0, pages_analyzed / d) ELSE 0 END))
  + 0.30 * (CASE WHEN cut THEN 0.75 ELSE 1 END) * (0.6 + 0.4 * sqrt(CASE WHEN o > 0 THEN least(1.0, offers_kept / o) ELSE 1 END))
  + 0.15 * (CASE WHEN headless_budget_reached THEN 0.7 ELSE 1 END) * (0.6 + 0.4 * sqrt(CASE WHEN headless_needed > 0 THEN least(1.0, headless_used / headless_needed) ELSE 1 END))), 0)::INT AS raw FROM a),
c AS (SELECT *, CASE WHEN page_limit_reached OR cut THEN least(raw, 74) WHEN headless_budget_reached OR headless_needed > headless_used THEN least(raw, 89) ELSE raw END AS k FROM b)
SELECT label, k AS coverage_confidence, CASE WHEN k >= 90 THEN 'complete' WHEN k >= 75 THEN 'substantial' WHEN k >= 50 THEN 'partial' ELSE 'limited' END AS coverage_status, round_even(readiness * k / 100.0, 0)::INT AS adjusted_readiness,
  greatest(1, page_limit_reached::INT + (d >= greatest(50, pages_analyzed * 5))::INT + cut::INT + (headless_budget_reached OR headless_needed > headless_used)::INT + (non_html_skipped > 0)::INT)::INT AS n_reasons FROM c""",
    "issues_ranked": f"""WITH {_ISSUES} SELECT site_id, issue_id, rule_id, impact, CASE WHEN impact >= 95 THEN 'critical' WHEN impact >= 80 THEN 'high' WHEN impact >= 55 THEN 'medium' ELSE 'low' END AS priority,
  row_number() OVER (PARTITION BY site_id ORDER BY impact DESC, rule_id)::INT AS rank FROM i""",
    "issues_sanity_rejected": f"""WITH {_ISSUES} SELECT site_id, rule_id, CASE
  WHEN site_id = 'r0' AND rule_id IN ('UNDR.PRICE.004', 'BUY.PRICE.002') THEN 'fact:pricing' WHEN site_id = 'r0' AND rule_id = 'BUY.POLICY.006' THEN 'policy'
  WHEN site_id = 'r1' AND rule_id IN ('UNDR.PRICE.004', 'BUY.PRICE.002') THEN 'offer:price' WHEN site_id = 'r1' AND rule_id = 'BUY.AVAILABILITY.003' THEN 'fact:commercial_status'
  WHEN site_id = 'r1' AND rule_id = 'BUY.CONVERSION.001' THEN 'path' WHEN site_id = 'r2' AND rule_id = 'BUY.PAYMENT.005' THEN 'fact:payment'
  WHEN site_id = 'r2' AND rule_id IN ('UNDR.AREA.005', 'BUY.AREA.004') THEN 'fact:service_area' END AS contradiction FROM i""",
    "crawl_bfs": "SELECT * FROM " + V([("https://g.test/", 0, 1, True), ("https://g.test/product", 1, 2, True), ("https://g.test/a", 1, 3, True), ("https://g.test/faq", 2, 4, True), ("https://g.test/b", 2, 5, True), ("https://g.test/c", 3, 6, False)], "url string, depth int, place int, visited boolean"),
    "robots_sitemaps": "SELECT * FROM " + V([("g1", 0, "https://g1.test/map.xml"), ("g1", 1, "https://g1.test/news.xml"), ("g2", 0, "https://g2.test/sitemap.xml"), ("g3", 0, "https://g3.test/sitemap.xml"), ("g4", 0, "https://g4.test/1.xml"), ("g4", 1, "2"), ("g4", 2, "3"), ("g4", 3, "4"), ("g4", 4, "5")], "site_id string, ord int, sitemap string"),
    "sitemap_urls": "SELECT * FROM " + V([("https://g1.test/map.xml", "https://g1.test/a"), ("https://g1.test/map.xml", "https://g1.test/c")], "sitemap string, url string"),
}
