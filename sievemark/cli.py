"""``python -m sievemark.cli URL... [--json OUT] [--html OUT]`` crawls and audits sites; ``--pages TABLE`` audits a Parquet table of crawled pages instead."""

from __future__ import annotations

import argparse
import sys
from functools import partial

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import rules
from .plans import siteaudit, sitecrawl
from .sources import web


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sievemark")
    p.add_argument("urls", nargs="*", help="seeds of the sites to crawl and audit")
    p.add_argument("--pages", help="Parquet with page_id, url, html, in place of a crawl")
    p.add_argument("--json", help="folder for scores as JSON")
    p.add_argument("--html", help="folder for one HTML report per site, as text")
    p.add_argument("--max-pages", type=int, default=40)
    p.add_argument("--max-depth", type=int, default=3)
    p.add_argument("--timeout", type=int, default=web.TIMEOUT)
    p.add_argument("--as-of", default=siteaudit.AS_OF)
    return p


def main(argv: list[str] | None = None, get: sitecrawl.Get | None = None) -> int:
    args = parser().parse_args(argv)
    if bool(args.urls) == bool(args.pages):
        print("give URLs or --pages", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("sievemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if args.pages:
            a = siteaudit.audit(siteaudit.parsed_pages(spark.read.parquet(args.pages)), args.as_of)
        else:
            seeds = spark.createDataFrame([(u,) for u in args.urls], "url string")
            get = get or partial(web.fetch_pages, fetch=partial(web.fetch_url, timeout=args.timeout))
            a = siteaudit.audit_crawl(sitecrawl.crawl(seeds, get, args.max_pages, args.max_depth), args.as_of)
            if a.pages.isEmpty():
                raise ValueError("no page could be read")
        if args.json:
            web.write_json(a.scores.join(a.profiles, "site_id").join(a.coverage.drop("readiness"), "site_id"), args.json)
        if args.html:
            web.report_html(a.scores, rules.final_issues(a.issues, a.conflicts), a.facts, a.offers, a.results).select("html").write.mode("overwrite").text(args.html)
    except Exception as e:  # the exit code is the tool's contract
        print(e, file=sys.stderr)
        return 2
    a.scores.join(a.coverage.select("site_id", "coverage_confidence", "adjusted_readiness"), "site_id").orderBy(F.desc("ai_readiness"), "site_id").show(20, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
