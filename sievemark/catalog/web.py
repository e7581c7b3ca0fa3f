"""The crawl over a small web of stored responses, made by a fixed rule: hosts with robots, sitemaps, links, other content and failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules
from ..plans import siteaudit, sitecrawl
from ..sources import web

N_HOSTS, N_PAGES = 5, 60
NAMES = ("p", "contact/p", "product/p", "en/p", "faq/p", "docs/p.pdf?k=", "account/p")


def page_url(h: int, k: int) -> str:
    return f"https://h{h}.test/{NAMES[k % len(NAMES)]}{k}" if k else f"https://h{h}.test/"


def page_links(h: int, k: int) -> list[str]:
    out = [page_url(h, (k * m + c) % N_PAGES) for m, c in ((2, 1), (3, 2), (5, h + 1), (1, 1))][: 1 + (k + h) % 4]
    return out + [f"https://h{(h + 1) % N_HOSTS}.test/", page_url(h, k) + "#top"] + (["mailto:x@y.test"] if k % 5 == 0 else [])


def made_responses() -> list[tuple]:
    """Rows of ``web.RESPONSE``: of host h0 nothing answers but its pages, h1 has robots rules, h2 a sitemap index, h3 a broken sitemap, h4 both."""
    rows = []
    for h in range(N_HOSTS):
        base = f"https://h{h}.test"
        if h in (1, 4):
            rows.append((f"{base}/robots.txt", None, 200, "text/plain", f"User-agent: *\nDisallow: /contact\nDisallow: /{NAMES[4]}4\n{'Sitemap: ' + base + '/map.xml' if h == 4 else ''}".encode(), None))
        if h == 2:
            rows.append((f"{base}/sitemap.xml", None, 200, "text/xml", f"<?xml version='1.0'?><sitemapindex xmlns='x'><sitemap><loc> {base}/a.xml </loc></sitemap><sitemap><loc>https://elsewhere.test/b.xml</loc></sitemap></sitemapindex>".encode(), None))
            rows.append((f"{base}/a.xml", None, 200, "text/xml", ("<urlset>" + "".join(f"<url><loc><![CDATA[{page_url(h, k)}]]></loc></url>" for k in range(40, 60)) + "<!-- <url><loc>no</loc></url> --></urlset>").encode(), None))
        if h == 3:
            rows.append((f"{base}/sitemap.xml", None, 200, "text/xml", b"<urlset><url><loc>https://h3.test/p7</loc>", None))
        if h == 4:
            rows.append((f"{base}/map.xml", None, 200, "text/xml", f"<urlset><url><loc>{page_url(h, 30)}&amp;x=1</loc></url><url><loc>{page_url(h, 31)}</loc></url></urlset>".encode(), None))
        for k in range(N_PAGES):
            if k % 13 == 7:
                rows.append((page_url(h, k), None, 503, "", None, "HTTP Error 503"))
                continue
            kind = "application/json" if k % 11 == 5 else "text/html; charset=latin-1" if k % 3 == 0 else "text/html"
            words = f"Page {k} of host {h}, café. " * (1 + k % 9 * 3)
            body = f"<html><head><title>P{k}</title></head><body><h1>H{k}</h1><p>{words}</p>{''.join(f'<a href={u!r}>to</a>' for u in page_links(h, k))}</body></html>"
            rows.append((page_url(h, k), None, 200, kind, body.encode("latin-1" if k % 3 == 0 else "utf-8"), None))
    return rows


def small_web(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(made_responses(), web.RESPONSE)


def seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"https://h{h}.test",) for h in range(N_HOSTS)] + [("ftp://x.test/",)], "url string")


def made_rendering(wanted: DataFrame) -> DataFrame:
    body = F.encode(F.concat(F.lit("<html><head><title>Rendered</title></head><body><h1>R</h1><p>"), F.repeat(F.lit("rendered words of the page "), F.lit(10)), F.lit("</p></body></html>")), "UTF-8")
    return wanted.select("url", F.when(~F.endswith("url", F.lit("1")), body).alias("body"), F.when(F.endswith("url", F.lit("1")), "Timeout").alias("fetch_error"))


def _crawl(spark: SparkSession, pages: int = 12, depth: int = 2) -> sitecrawl.SiteCrawl:
    return sitecrawl.crawl(seeds(spark), sitecrawl.stored(small_web(spark)), pages, depth, made_rendering, 3)


def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crawl(spark).pages.select("site_id", "page_ord", "asked", "depth", "status", "title", "fetch_method", F.md5("text").alias("text_md5"))


def crawl_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crawl(spark).reach


def crawl_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl to audit: coverage judged by what the crawl met, and the final issues."""
    a = siteaudit.audit_crawl(_crawl(spark))
    issues = rules.final_issues(a.issues, a.conflicts).groupBy("site_id").agg(F.count("*").alias("n_issues"), F.max_by("rule_id", -F.col("place")).alias("first_issue"))
    return a.coverage.select("site_id", "coverage_confidence", "coverage_status", "adjusted_readiness", F.array_join("coverage_reasons", "|").alias("reasons")).join(issues, "site_id", "left")


QUERIES = {f.__name__: f for f in (crawl_pages, crawl_reach, crawl_coverage)}
ORACLES: dict[str, str] = {}
