"""URL, text, contact and money queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from .. import lexicons as L
from ..functions import money, phrases, text, urls


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", urls.normalize(F.col("url")).alias("url"))


def url_normalize_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, fixtures.URLS, "url string").select("url", urls.normalize(F.col("url")).alias("normalized"))


def url_site_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).groupBy(urls.host(F.col("url")).alias("site")).agg(F.count("*").alias("n_pages"), F.countDistinct(urls.normalize(F.col("url"))).alias("n_urls"))


def url_relevance_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl's order of a site's pages: relevant ones first, then short, then by text; the first five."""
    from pyspark.sql import Window

    p = _pages(spark, sf_dir).select(urls.host(F.col("url")).alias("site"), "url", urls.relevant(F.col("url")).alias("relevant"))
    order = Window.partitionBy("site").orderBy(F.col("relevant").desc(), F.length("url"), "url")
    return p.withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("site", "rank", "url", "relevant")


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    both = _pages(spark, sf_dir).select("url").unionByName(fixtures.table(spark, fixtures.URLS, "url string"))
    return both.select("url", urls.relevant(u).alias("relevant"), urls.excluded(u).alias("excluded"), urls.non_html(u).alias("non_html"), urls.home_page(u).alias("home_page"))


def url_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _pages(spark, sf_dir).select("url").unionByName(fixtures.table(spark, fixtures.URLS, "url string"))
    return both.select("url", urls.safe_public(F.col("url")).alias("safe"))


def page_kind_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _pages(spark, sf_dir).select("url").unionByName(fixtures.table(spark, fixtures.URLS, "url string"))
    return both.groupBy(urls.page_kind(F.col("url")).alias("kind")).agg(F.count("*").alias("n"))


def url_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _pages(spark, sf_dir).select(F.explode(urls.attribution(F.col("url"))).alias("name", "value"))
    return found.groupBy("name", "value").agg(F.count("*").alias("n"))


def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links per page as the href attribute has them, first occurrences in order."""
    found = F.array_distinct(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1)))
    return _pages(spark, sf_dir).select("page_id", F.posexplode(found).alias("ord", "href"))


def link_top_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = link_edges(spark, sf_dir).groupBy("href").agg(F.count("*").alias("n_pages"))
    return counted.orderBy(F.desc("n_pages"), "href").limit(20)


def link_degree_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = _pages(spark, sf_dir).select("page_id", urls.host(F.col("url")).alias("site"))
    return link_edges(spark, sf_dir).join(site, "page_id").groupBy("site").agg(F.count("*").alias("n_links"), F.countDistinct("href").alias("n_targets"))


def text_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.md5(text.normalized(F.col("text"))).alias("normalized_md5"))


def phrase_context_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.table(spark, [(i, *r) for i, r in enumerate(fixtures.PHRASES)], "id int, text string, phrase string, context string, hit boolean")
    norm = text.normalized(F.col("text"))
    out = F.lit(False)
    for phrase, context in sorted({(p, c) for _, p, c, _ in fixtures.PHRASES}, key=str):
        same = (F.col("phrase") == phrase) & F.col("context").eqNullSafe(F.lit(context))
        out = F.when(same, text.first_phrase(norm, [phrase], context).isNotNull()).otherwise(out)
    return t.select("id", "text", out.alias("hit"))


def phrase_hits_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per field whose text has one of the field's phrases, and a control phrase that the corpus has."""
    fields = L.FACT_PHRASES | {"license": ("license", "licensed under")}
    found = _documents(spark, sf_dir).select(phrases.found_in(text.normalized(F.col("text")), [p for listed in fields.values() for p in listed]).alias("f"))
    counted = found.agg(*(F.count_if(phrases.any_of(F.col("f"), p)).alias(k) for k, p in fields.items()))
    return counted.unpivot([], list(fields), "field", "n_documents")


def emails_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.exploded(_documents(spark, sf_dir), "doc_id", email=text.emails(F.col("text")))


def phones_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.exploded(_documents(spark, sf_dir), "doc_id", phone=text.phones(F.col("text")))


def price_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, [(i, *r) for i, r in enumerate(fixtures.NUMBERS)], "id int, raw string, expected double").select("id", "raw", money.number(F.col("raw")).alias("value"))


def price_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.table(spark, [(i, *r) for i, r in enumerate(fixtures.PRICES)], "id int, raw string, expected double")
    found = t.select("id", F.try_element_at(money.prices(F.col("raw")), F.lit(1)).alias("p"))
    return found.select("id", "p.minimum", "p.maximum", "p.currency", "p.qualifier", "p.frequency")


def commercial_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, availability and frequency labels of texts."""
    rows = [(i, t) for i, t in enumerate(("Ouvert 7j/7, fermeture temporaire en août", "Permanently closed", "produit indisponible", "en stock, paiement unique", "rupture de stock", "abonnement mensuel", "12 € par an", "selon la saison", "rien", ""))]
    n = text.normalized(F.col("text"))
    return fixtures.table(spark, rows, "id int, text string").select(
        "id", text.first_label(n, L.COMMERCIAL_STATUS).alias("status"), text.first_label(n, L.AVAILABILITY_LABELS).alias("availability"), text.first_label(n, L.FREQUENCY_LABELS).alias("frequency")
    )


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text around a word, or a text's beginning."""
    d = _documents(spark, sf_dir)
    return d.select("doc_id", text.excerpt_of(F.col("text"), F.lit("license")).alias("excerpt"))


QUERIES = {
    f.__name__: f
    for f in (
        url_normalize, url_normalize_cases, url_site_counts, url_relevance_rank, url_filters, url_safety, page_kind_mix, url_attribution, link_edges, link_top_targets, link_degree_by_site,
        text_normalized, phrase_context_hits, phrase_hits_by_field, emails_extracted, phones_extracted, price_number, price_parse, commercial_labels, excerpts,
    )
}


def _norm_sql(x: str) -> str:
    return rf"trim(regexp_replace(strip_accents(replace(lower({x}), 'ß', 'ss')), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def _any_sql(norm: str, phrases) -> str:
    return "(" + " OR ".join(f"contains(' ' || {norm} || ' ', ' {text.plain(p)} ')" for p in phrases) + ")"


def _label_sql(norm: str, labels) -> str:
    return "CASE " + " ".join(f"WHEN {_any_sql(norm, p)} THEN '{k}'" for k, p in labels) + " END"


_URLS = fixtures.values(fixtures.URLS, "url string")
_BOTH = f"(SELECT url FROM pages UNION ALL SELECT url FROM {_URLS})"
_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)"
_NORM_URL = rf"""regexp_extract(url, '^([a-z]+)://', 1) || '://' || {_HOST}
  || CASE WHEN {_PATH} IN ('', '/') THEN '/' ELSE regexp_replace({_PATH}, '/+$', '') END
  || CASE WHEN len(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) > 0
     THEN '?' || array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_')), '&') ELSE '' END"""
_REL = "(" + " OR ".join(f"contains(lower(url), '{t}')" for t in L.RELEVANT_TOKENS) + ")"
_EXC = "(" + " OR ".join(f"contains(lower({_PATH}), '{t}')" for t in L.EXCLUDED_TOKENS) + ")"
_NON = "(" + " OR ".join(f"ends_with(lower({_PATH}), '{t}')" for t in L.NON_HTML_EXTENSIONS) + ")"
_LINKS = """(SELECT page_id, url, unnest(list_filter(list_transform(range(0, len(l)), lambda i: {'i': i, 'h': l[i + 1]}), lambda x: list_position(l, x.h) = x.i + 1)) AS e
  FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages))"""
_KIND = "CASE " + " ".join(
    f"WHEN list_has_any(seg, [{', '.join(repr(text.plain(n)) for n in names)}]) THEN '{k}'" for k, names in L.PAGE_KINDS
) + f" ELSE '{L.GENERAL_KIND}' END"
_PHRASE_FIELDS = L.FACT_PHRASES | {"license": ("license", "licensed under")}

ORACLES = {
    "url_normalize": f"SELECT page_id, {_NORM_URL} AS url FROM pages",
    "url_normalize_cases": "SELECT * FROM "
    + fixtures.values(
        [
            (a[0], b)
            for a, b in zip(
                fixtures.URLS,
                (
                    "http://example.test/Path?b=2&a=+c", "https://example.test/", "https://example.test:8443/a", "https://example.test/", "https://example.test/a/b;p/c", "http://example.test/?q=a+b",
                    "https://example.test/contact", "https://example.test/accounting", "https://example.test/a.PDF", "ftp://example.test/x", "https://localhost/x", "http://10.0.0.8/", "http://172.20.1.1/",
                    "http://172.40.1.1/", "https://box.internal/", "http://192.168.1.7:8080/", "https://8.8.8.8/", "http://example.test/", "http://224.0.0.1/", "https://example.test/notre-blog/blog/x",
                    "https://example.test/mentions-legales", "https://example.test/faq.html", "https://example.test/faq", "https://example.test/%C3%A9v%C3%A9nements/2", "https://example.test/projets/a",
                ),
            )
        ],
        "url string, normalized string",
    ),
    "url_site_counts": f"SELECT {_HOST} AS site, count(*) AS n_pages, count(DISTINCT {_NORM_URL}) AS n_urls FROM pages GROUP BY 1",
    "url_relevance_rank": f"""SELECT site, rank::INT AS rank, url, relevant FROM (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY relevant DESC, length(url), url) AS rank FROM (SELECT {_HOST} AS site, url, {_REL} AS relevant FROM pages)) WHERE rank <= 5""",
    "url_filters": f"""SELECT url, {_REL} AS relevant, {_EXC} AS excluded, {_NON} AS non_html,
  length(regexp_replace(url, '/+$', '')) - length(replace(regexp_replace(url, '/+$', ''), '/', '')) <= 2 AS home_page FROM {_BOTH}""",
    "url_safety": rf"""SELECT url, scheme IN ('http', 'https') AND NOT contains(auth, '@') AND NOT (h IN ('', 'localhost') OR regexp_matches(h, '\.(localhost|local|internal)$') OR (a IS NOT NULL AND
  (a IN (0, 10, 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127) OR a >= 224))) AS safe
FROM (SELECT url, h, scheme, auth, CASE WHEN regexp_matches(h, '^\d+\.\d+\.\d+\.\d+$') THEN string_split(h, '.')[1]::INT END AS a,
  CASE WHEN regexp_matches(h, '^\d+\.\d+\.\d+\.\d+$') THEN string_split(h, '.')[2]::INT END AS b
  FROM (SELECT url, {_HOST} AS h, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS auth FROM {_BOTH}))""",
    "page_kind_mix": f"""SELECT {_KIND} AS kind, count(*) AS n FROM (
  SELECT list_transform(list_filter(string_split(url_decode({_PATH}), '/'), lambda x: x <> ''), lambda x: {_norm_sql("replace(x, '-', ' ')")}) AS seg FROM {_BOTH}) GROUP BY 1""",
    "url_attribution": r"""SELECT name, value, count(*) AS n FROM (SELECT string_split(p, '=')[1] AS name, string_split(p, '=')[2] AS value FROM (
  SELECT unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) AS p FROM pages)) WHERE name IN ('oppref', 'utm_source', 'utm_medium', 'utm_campaign', 'utm_content', 'utm_term') GROUP BY 1, 2""",
    "link_edges": f"SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY e.i) - 1)::INT AS ord, e.h AS href FROM {_LINKS}",
    "link_top_targets": f"SELECT e.h AS href, count(*) AS n_pages FROM {_LINKS} GROUP BY 1 ORDER BY n_pages DESC, href LIMIT 20",
    "link_degree_by_site": f"SELECT {_HOST} AS site, count(*) AS n_links, count(DISTINCT e.h) AS n_targets FROM {_LINKS} GROUP BY 1",
    "text_normalized": f"SELECT doc_id, md5({_norm_sql('text')}) AS normalized_md5 FROM documents",
    "phrase_context_hits": "SELECT * FROM " + fixtures.values([(i, t, h) for i, (t, _, _, h) in enumerate(fixtures.PHRASES)], "id int, text string, hit boolean"),
    "phrase_hits_by_field": " UNION ALL ".join(f"SELECT '{k}' AS field, count(*) FILTER ({_any_sql('n', p)}) AS n_documents FROM (SELECT {_norm_sql('text')} AS n FROM documents)" for k, p in _PHRASE_FIELDS.items()),
    "emails_extracted": r"SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b')) AS email FROM documents",
    "price_number": rf"""SELECT id, raw, CASE WHEN regexp_full_match(v, '\d+') THEN v
  WHEN regexp_full_match(v, '\d{{1,3}}(\.\d{{3}})+,\d{{1,2}}') THEN replace(replace(v, '.', ''), ',', '.') WHEN regexp_full_match(v, '\d{{1,3}}(,\d{{3}})+\.\d{{1,2}}') THEN replace(v, ',', '')
  WHEN regexp_full_match(v, '\d+[.,]\d{{1,2}}') THEN replace(v, ',', '.') WHEN regexp_full_match(v, '\d{{1,3}}(\.\d{{3}})+') THEN replace(v, '.', '')
  WHEN regexp_full_match(v, '\d{{1,3}}(,\d{{3}})+') THEN replace(v, ',', '') END::DOUBLE AS value
FROM (SELECT id, raw, regexp_replace(raw, '[\s\x{{00a0}}\x{{202f}}]', '', 'g') AS v FROM {fixtures.values([(i, r) for i, (r, _) in enumerate(fixtures.NUMBERS)], "id int, raw string")})""",
    "price_parse": "SELECT * FROM "
    + fixtures.values(
        [
            (i, m, 30.0 if r.startswith("20 ") else None, None if m is None else "USD" if "USD" in r else "GBP" if "£" in r else "EUR", "from" if r.lower().startswith(("from", "à partir")) else None, "monthly" if "mois" in r else "yearly" if "par an" in r else None)
            if r != "Prix 1,23,4 €" else (i, None, None, None, None, None)
            for i, (r, m) in enumerate(fixtures.PRICES)
        ],
        "id int, minimum double, maximum double, currency string, qualifier string, frequency string",
    ),
    "excerpts": """SELECT doc_id, trim(CASE WHEN pos < 0 THEN substr(text, 1, 180) ELSE substr(text, greatest(0, pos - 60) + 1, pos + 7 + 120 - greatest(0, pos - 60)) END) AS excerpt
FROM (SELECT doc_id, text, instr(lower(text), 'license') - 1 AS pos FROM documents)""",
}
_LABEL_ROWS = [(i, t) for i, t in enumerate(("Ouvert 7j/7, fermeture temporaire en août", "Permanently closed", "produit indisponible", "en stock, paiement unique", "rupture de stock", "abonnement mensuel", "12 € par an", "selon la saison", "rien", ""))]
ORACLES["commercial_labels"] = f"""SELECT id, {_label_sql('n', L.COMMERCIAL_STATUS)} AS status, {_label_sql('n', L.AVAILABILITY_LABELS)} AS availability, {_label_sql('n', L.FREQUENCY_LABELS)} AS frequency
FROM (SELECT id, {_norm_sql('text')} AS n FROM {fixtures.values(_LABEL_ROWS, 'id int, text string')})"""
