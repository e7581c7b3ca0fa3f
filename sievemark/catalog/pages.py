"""Page audit queries over the crawl and over pages with commercial signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from .. import lexicons as L
from ..plans import pageaudit

PAGE_SCHEMA = "page_id bigint, url string, html string"


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")


def signal_pages(spark: SparkSession) -> DataFrame:
    return fixtures.table(spark, fixtures.PAGES, PAGE_SCHEMA)


def all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl(spark, sf_dir).unionByName(signal_pages(spark))


def page_audit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pageaudit.inspect(all_pages(spark, sf_dir))
    return out.select("page_id", "status", "acquisition", "journey", "visibility", "understanding", "buyability", "observed_readiness", "readiness_state", "confidence", "fix_potential")


def page_visible_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = all_pages(spark, sf_dir).select("page_id", pageaudit.visible_text(F.coalesce("html", F.lit(""))).alias("v"))
    return seen.select("page_id", F.length("v").alias("n_visible"), F.md5("v").alias("visible_md5"))


def page_title_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pageaudit.inspect(all_pages(spark, sf_dir))
    return out.select("page_id", "title", "description", "same_host_canonical", F.size("headings").alias("n_headings"), F.array_join("headings", "|").alias("headings"))


def page_acquisition_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pageaudit.inspect(all_pages(spark, sf_dir))
    return out.groupBy("acquisition", "hard_limited").agg(F.count("*").alias("n_pages"), F.count_if("rendering_recommended").alias("n_renderable"), F.count_if(F.size("prices") > 0).alias("n_priced"))


def page_actions_journey(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pageaudit.inspect(signal_pages(spark))
    return out.select("page_id", "journey", F.array_join("commercial_actions", "|").alias("actions"), F.array_join("prices", "|").alias("prices"))


def page_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pageaudit.inspect(all_pages(spark, sf_dir))
    return out.select("page_id", F.explode_outer("capabilities").alias("capability", "state")).groupBy("capability", "state").agg(F.count("*").alias("n_pages"))


def page_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs per page, group and label."""
    out = pageaudit.inspect(all_pages(spark, sf_dir))
    groups = F.array(*(F.struct(F.lit(g).alias("group"), F.col(f"evidence.{g}").alias("proofs")) for g in ("acquisition", "visibility", "understanding", "buyability")))
    each = out.select("page_id", F.explode_outer(groups).alias("g")).select("page_id", "g.group", F.explode_outer("g.proofs").alias("p")).where("p is not null")
    return each.groupBy("page_id", "group", "p.label").agg(F.count("*").alias("n"))


def page_next_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pageaudit.primary_finding(pageaudit.inspect(signal_pages(spark)))
    return out.select("page_id", F.array_join(F.col("next_actions.title"), "|").alias("titles"), F.col("finding.title").alias("finding"), F.col("finding.priority").alias("finding_priority"), "main_gap", "monitoring_eligible")


def page_rendered_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thin pages take the reading of their rendered twin where that is complete."""
    static = pageaudit.inspect(signal_pages(spark))
    twins = fixtures.table(spark, [(i, u, fixtures.PAGES[1][2]) for i, u, _ in fixtures.PAGES if i in (900004, 900006)], PAGE_SCHEMA)
    out = pageaudit.with_rendered(static, pageaudit.inspect(twins, method="rendered"))
    return out.select("page_id", "method", "acquisition", "buyability", "confidence", "monitoring_eligible")


QUERIES = {
    f.__name__: f
    for f in (page_audit_scores, page_visible_text_stats, page_title_headings, page_acquisition_mix, page_actions_journey, page_capabilities, page_evidence, page_next_actions, page_rendered_fallback)
}

_BLANK = r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _decode(x: str) -> str:
    for pattern, char in (("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&quot;", '"'), ("&#39;", "''"), ("<[^>]+>", " "), (f"{_BLANK}+", " ")):
        x = f"regexp_replace({x}, '{pattern}', '{char}', 'g')"
    return f"trim({x})"


def _listed(pattern: str, limit: int) -> str:
    return f"list_slice(list_filter(list_transform(regexp_extract_all(h, '{pattern}', 1), lambda x: {_decode('x')}), lambda x: x <> ''), 1, {limit})"


def _says(text: str, words: str) -> str:
    return f"regexp_matches({text}, '(?i)\\b(?:{words.replace(chr(39), chr(39) * 2)})\\b')"


_Q = "[\"'']"
_NQ = "[^\"'']"
_PRICE = r"(?i)(?:(?:€|\$|£)[\s\x{00a0}\x{202f}]*\d+(?:[\s\x{00a0}\x{202f}]\d{3})*(?:[,.]\d{1,2})?|\d+(?:[\s\x{00a0}\x{202f}]\d{3})*(?:[,.]\d{1,2})?[\s\x{00a0}\x{202f}]*(?:€|EUR|\$|USD|£|GBP))"
_CONTACT = r"(?i)mailto:|tel:|wa\.me|whatsapp"
_HOST = r"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def audit_sql(source: str) -> str:
    """The audit as common table expressions over ``source``; the last is ``audit``."""
    meta = "(?:name|property)=Q(?:description|og:description)Q".replace("Q", _Q)
    return rf"""
p AS (SELECT page_id, url, coalesce(html, '') AS h FROM {source}),
q AS (
  SELECT page_id, url, h,
    {_decode("regexp_replace(h, '(?is)<script.*?</script>|<style.*?</style>|<template.*?</template>|<noscript.*?</noscript>', ' ', 'g')")} AS v,
    {_decode("regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
    {_decode(f"regexp_extract(h, '(?i)<meta[^>]+{meta}[^>]+content={_Q}({_NQ}+){_Q}[^>]*>', 1)")} AS d1,
    {_decode(f"regexp_extract(h, '(?i)<meta[^>]+content={_Q}({_NQ}+){_Q}[^>]+{meta}[^>]*>', 1)")} AS d2,
    {_decode(f"regexp_extract(h, '(?i)<link[^>]+rel={_Q}{_NQ}*canonical{_NQ}*{_Q}[^>]+href={_Q}({_NQ}+){_Q}[^>]*>', 1)")} AS canonical,
    {_listed("(?is)<h[1-3][^>]*>(.*?)</h[1-3]>", 8)} AS headings,
    {_listed(f"(?is)<script[^>]+type={_Q}application/ld\\+json{_Q}[^>]*>(.*?)</script>", 8)} AS schemas,
    list_concat(list_concat({_listed("(?is)<(?:a|button)[^>]*>(.*?)</(?:a|button)>", 40)},
      {_listed(f"(?i)<form[^>]*(?:action|name|id)={_Q}({_NQ}+){_Q}[^>]*>", 12)}),
      list_concat({_listed(f"(?i)<(?:a|button)[^>]+(?:aria-label|title)={_Q}({_NQ}+){_Q}[^>]*>", 20)},
      {_listed(f"(?i)<a[^>]+href={_Q}(mailto:{_NQ}+|tel:{_NQ}+|https?://(?:wa.me|api.whatsapp.com){_NQ}*){_Q}[^>]*>", 12)})) AS src,
    len(regexp_extract_all(h, '(?i)<script\b')) AS n_scripts
  FROM p),
r AS (
  SELECT *, length(v) AS n_visible, CASE WHEN d1 <> '' THEN d1 ELSE d2 END AS description, array_to_string(src, ' ') AS j,
    list_slice(list_transform(regexp_extract_all(v, '{_PRICE}'), lambda x: trim(x)), 1, 6) AS prices,
    list_slice(list_filter(src, lambda x: {_says("x", L.PAGE_CTA)} OR regexp_matches(x, '{_CONTACT}')), 1, 8) AS actions,
    list_filter(headings, lambda x: {_says("x", L.PAGE_COMMERCIAL)}) AS commercial,
    len(list_filter(schemas, lambda x: regexp_matches(x, '(?i)"@type"\s*:\s*"(?:Product|Service|Offer|Course|Event|LocalBusiness)"'))) > 0 AS schema_commerce,
    {_says("h || ' ' || v", L.PAGE_BOT_BLOCK)} AS bot, {_says("h || ' ' || v", L.PAGE_JS_REQUIRED)} AS js,
    {_says("v", L.PAGE_AVAILABILITY)} AS av, {_says("v", L.PAGE_PAYMENT)} AS pay, {_says("v", L.PAGE_AREA)} AS geo,
    lower(regexp_extract(url, '{_HOST}', 1)) AS own_host, lower(regexp_extract(canonical, '{_HOST}', 1)) AS canonical_host
  FROM q),
s AS (
  SELECT *, {_says("j", L.PAGE_QUOTE)} AS says_quote,
    CASE WHEN {_says("j", L.PAGE_PURCHASE)} THEN 'purchase' WHEN {_says("j", L.PAGE_BOOKING)} THEN 'booking' WHEN {_says("j", L.PAGE_QUOTE)} THEN 'quote'
         WHEN {_says("j", L.PAGE_CONTACT)} OR regexp_matches(j, '{_CONTACT}') THEN 'contact' ELSE 'unknown' END AS path,
    len(commercial) > 0 OR schema_commerce OR (len(prices) > 0 AND len(actions) > 0) AS offer, len(prices) > 0 AS priced,
    canonical <> '' AND CASE WHEN canonical_host <> '' THEN canonical_host ELSE own_host END = own_host AS same_host,
    CASE WHEN bot THEN 'blocked' WHEN js THEN 'hard_limited' WHEN n_visible < 180 OR (n_visible < 500 AND n_scripts >= 5) THEN 'limited' ELSE 'full' END AS first
  FROM r),
t AS (
  SELECT *, CASE WHEN first = 'limited' AND offer AND (path <> 'unknown' OR priced) THEN 'full' WHEN first = 'hard_limited' THEN 'limited' ELSE first END AS acq,
    title <> '' OR len(headings) > 0 AS identity
  FROM s),
u AS (
  SELECT *, acq <> 'blocked' AND first <> 'hard_limited' AND n_visible >= 20 AS usable,
    35 + 20 * (title <> '')::INT + 15 * (description <> '')::INT + 15 * same_host::INT + 15 * (len(headings) >= 2)::INT AS vis,
    25 * identity::INT + 35 * offer::INT + 15 * priced::INT + 10 * (description <> '')::INT + 15 * schema_commerce::INT AS und,
    40 * (path <> 'unknown')::INT + 25 * (priced OR says_quote)::INT + 15 * av::INT + 10 * pay::INT + 10 * geo::INT AS buy,
    1 + (title <> '')::INT + (description <> '')::INT + same_host::INT AS n_vis,
    identity::INT + len(commercial) + schema_commerce::INT + len(prices) AS n_und,
    least(len(actions), 5) + av::INT + pay::INT + geo::INT AS n_buy
  FROM t),
audit AS (
  SELECT *, CASE acq WHEN 'blocked' THEN 'blocked' WHEN 'limited' THEN 'limited' ELSE 'complete' END AS status,
    CASE WHEN acq = 'blocked' THEN 'unknown' ELSE path END AS journey,
    CASE WHEN usable AND n_vis >= 2 THEN vis END AS visibility, CASE WHEN usable AND n_und >= 1 THEN und END AS understanding, CASE WHEN usable THEN buy END AS buyability,
    CASE WHEN usable AND n_vis >= 2 AND n_und >= 1 THEN floor((vis + und + buy) / 3.0 + 0.5)::INT END AS observed_readiness,
    CASE WHEN acq = 'blocked' THEN 0 ELSE (n_buy = 0)::INT + (NOT offer)::INT + (path = 'unknown')::INT + (NOT priced)::INT END AS n_gaps
  FROM u)"""


_ALL = f"(SELECT page_id, url, html FROM pages UNION ALL SELECT * FROM {fixtures.values(fixtures.PAGES, PAGE_SCHEMA)})"
_SIGNALS = fixtures.values(fixtures.PAGES, PAGE_SCHEMA)
_STATE = "CASE WHEN acq = 'blocked' THEN 'INSUFFICIENT_EVIDENCE' WHEN {0} THEN 'OBSERVED' WHEN acq = 'limited' THEN 'INSUFFICIENT_EVIDENCE' ELSE 'NOT_OBSERVED' END"

ORACLES = {
    "page_audit_scores": f"""WITH {audit_sql(_ALL)}
SELECT page_id, status, acq AS acquisition, journey, visibility, understanding, buyability, observed_readiness,
  CASE WHEN observed_readiness IS NULL THEN 'insufficient_evidence' ELSE 'observed' END AS readiness_state,
  CASE WHEN observed_readiness IS NULL OR acq = 'limited' THEN 'LOW' ELSE 'HIGH' END AS confidence,
  CASE WHEN n_gaps >= 2 THEN 'HIGH' WHEN n_gaps = 1 THEN 'MEDIUM' ELSE 'LOW' END AS fix_potential
FROM audit""",
    "page_visible_text_stats": f"WITH {audit_sql(_ALL)} SELECT page_id, n_visible::INT AS n_visible, md5(v) AS visible_md5 FROM audit",
    "page_title_headings": f"""WITH {audit_sql(_ALL)}
SELECT page_id, title, description, same_host AS same_host_canonical, least(len(headings), 5)::INT AS n_headings, array_to_string(list_slice(headings, 1, 5), '|') AS headings FROM audit""",
    "page_acquisition_mix": f"""WITH {audit_sql(_ALL)}
SELECT acq AS acquisition, first = 'hard_limited' AS hard_limited, count(*) AS n_pages,
  count(*) FILTER (acq = 'limited' AND n_visible < 500 AND n_scripts >= 5) AS n_renderable, count(*) FILTER (priced) AS n_priced
FROM audit GROUP BY ALL""",
    "page_actions_journey": f"WITH {audit_sql(_SIGNALS)} SELECT page_id, journey, array_to_string(list_slice(actions, 1, 5), '|') AS actions, array_to_string(prices, '|') AS prices FROM audit",
    "page_capabilities": f"WITH {audit_sql(_ALL)} SELECT capability, state, count(*) AS n_pages FROM ("
    + " UNION ALL ".join(
        f"SELECT '{k}' AS capability, {_STATE.format(c)} AS state FROM audit"
        for k, c in (("identity", "identity"), ("offer", "offer"), ("pricing", "priced"), ("conversion", "path <> 'unknown'"), ("availability", "av"), ("payment", "pay"), ("geography", "geo"))
    )
    + ") GROUP BY ALL",
    "page_next_actions": f"""WITH {audit_sql(_SIGNALS)},
a AS (
  SELECT *, CASE WHEN acq = 'blocked' THEN ['Keep essential public information accessible to agents']
    WHEN acq = 'limited' THEN ['Make key commercial information agent-accessible']
    WHEN offer OR priced OR path <> 'unknown' THEN list_filter([
      CASE WHEN NOT offer THEN 'Make the main offer explicit' END, CASE WHEN path = 'unknown' THEN 'Add a clear commercial next step' END,
      CASE WHEN NOT priced AND NOT says_quote THEN 'Explain price or the quote process' END,
      CASE WHEN path IN ('purchase', 'booking') AND NOT av THEN 'State availability or timing' END], lambda x: x IS NOT NULL)
    WHEN NOT identity THEN ['Clarify the organization and its purpose'] ELSE [] END AS titles
  FROM audit)
SELECT page_id, array_to_string(titles, '|') AS titles,
  coalesce(list_filter(titles, lambda x: x NOT IN ('State availability or timing', 'Clarify the organization and its purpose'))[1], titles[1],
    CASE WHEN observed_readiness IS NULL THEN 'More observable evidence is needed' ELSE 'No urgent issue observed on this page' END) AS finding,
  CASE WHEN len(list_filter(titles, lambda x: x NOT IN ('State availability or timing', 'Clarify the organization and its purpose'))) > 0 THEN 'high'
    WHEN len(titles) > 0 THEN 'medium' WHEN observed_readiness IS NULL THEN 'high' ELSE 'medium' END AS finding_priority,
  CASE WHEN acq = 'blocked' THEN NULL WHEN n_buy = 0 THEN 'No buyability signal was observed in the inspected content.' WHEN NOT offer THEN 'offer details are not fully observable'
    WHEN path = 'unknown' THEN 'a commercial next step is not observable' WHEN NOT priced THEN 'pricing is not observable' END AS main_gap,
  acq = 'full' AS monitoring_eligible
FROM a""",
}
