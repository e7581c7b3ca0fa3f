"""Bounded crawl of many sites at once: robots, sitemaps, waves of pages, and what a site's coverage is judged by.

How pages come is the caller's: ``get`` turns a table of URLs into responses (``web.fetch_pages`` over the network, ``stored`` over responses
at hand), ``render`` does the same for rendered HTML. A site is a host. Its queue is first in, first out: the seed, the sitemaps' pages,
then the links of each page visited, relevant and short ones first. All sites go through their queues together, a wave at a time (a wave
holds what the pages of the one before linked to), and within a wave in runs of as many URLs as a site's page budget has left, so no
page is fetched that the budget wouldn't allow. Each run is a written table; a site's queue is bounded by its budget times its pages' links.

A failed response is a page without text and counts against the budget; what isn't HTML or may not be fetched doesn't.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import lexicons as L
from ..functions import urls
from ..operators import crawl as C
from ..scratch import written
from ..sources import html, web
from .siteaudit import under_render_reason

Get = Callable[[DataFrame], DataFrame]
RENDERED = 8


@dataclass
class SiteCrawl:
    #: Parsed pages with site_id, page_id, page_ord, depth, fetch_error, render_reason and fetch_method.
    pages: DataFrame
    #: Per site: robots_accessible, n_blocked, n_sitemaps, pages_analyzed, pages_discovered, page_limit_reached, headless_needed, headless_used, headless_budget_reached, non_html_skipped.
    reach: DataFrame
    #: (site_id, url, reason) of URLs that robots.txt keeps away.
    blocked: DataFrame


def stored(responses: DataFrame) -> Get:
    """Responses at hand (the columns of ``web.RESPONSE``) in place of a network; other URLs fail."""

    def get(wanted: DataFrame) -> DataFrame:
        found = wanted.select("url").distinct().join(responses, "url", "left")
        missing = F.col("status").isNull()
        return found.withColumn("final_url", F.coalesce("final_url", "url")).withColumn("fetch_error", F.when(missing, F.lit("URLError: not stored")).otherwise(F.col("fetch_error"))).withColumn("status", F.coalesce("status", F.lit(0)))

    return get


@F.pandas_udf(T.StringType())
def _decoded(bodies: pd.Series, types: pd.Series) -> pd.Series:
    def one(body: bytes | None, kind: str | None) -> str | None:
        if body is None:
            return None
        try:
            return body.decode(html.strip_charset(kind or ""), "replace")
        except LookupError:
            return body.decode("utf-8", "replace")

    return pd.Series([one(b, t) for b, t in zip(bodies, types)], dtype=object)


def _per_site(part: DataFrame, *aggregates: Column) -> DataFrame:
    return part.groupBy("site_id").agg(*aggregates)


def _sitemaps(start: DataFrame, get: Get) -> tuple[DataFrame, DataFrame]:
    """(site_id, url, raw) of pages in sitemaps, and (site_id, sitemap) of those read."""
    level = start.select("site_id", "origin", F.explode(C.sitemaps_of(F.coalesce("robots_txt", F.lit("")), F.col("origin"))).alias("sitemap"))
    found, read = [], []
    for depth in range(C.SITEMAP_DEPTH + 1):
        got = get(level.select(F.col("sitemap").alias("url")).distinct()).where("fetch_error is null").select(F.col("url").alias("sitemap"), _decoded("body", F.lit("")).alias("xml")).select("sitemap", C.sitemap_entries(F.col("xml")).alias("e")).where("e.is_index is not null")
        here = written(level.join(got, "sitemap"), "sitemaps")
        read.append(here.select("site_id", "sitemap"))
        goes_on = F.col("e.is_index") & F.lit(depth < C.SITEMAP_DEPTH)
        pages = here.where(~goes_on).select("site_id", "origin", F.explode("e.pages").alias("raw"))
        found.append(pages.where(urls.same_site(F.col("raw"), F.col("origin"))).select("site_id", urls.normalize(F.col("raw")).alias("url")))
        children = here.where(goes_on).select("site_id", "origin", F.explode(F.slice("e.children", 1, C.CHILDREN)).alias("sitemap"))
        level = children.where(urls.same_site(F.col("sitemap"), F.col("origin"))).distinct()
    union = lambda parts: reduce(DataFrame.unionByName, parts).distinct()
    return written(union(found), "sitemap-pages"), written(union(read), "sitemaps-read")


def _fetched(run: DataFrame, get: Get) -> DataFrame:
    """Responses of a run of (site_id, url, depth, ord), with html decoded and whether they count as pages."""
    got = run.join(get(run.select("url").distinct()), "url")
    failed, is_html = F.col("fetch_error").isNotNull(), F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("text/html"))
    return got.withColumn("is_page", failed | is_html).withColumn("html", F.when(is_html & ~failed, _decoded("body", "content_type"))).drop("body")


def _parsed(pages: DataFrame) -> DataFrame:
    h = F.col("html")
    n_js = reduce(lambda a, b: a + b, (F.coalesce(h.rlike(f"(?i){m}"), F.lit(False)).cast("int") for m in L.JS_APP_MARKERS))
    ready = pages.withColumn("n_js", n_js).withColumn("n_scripts", F.coalesce(F.regexp_count(h, F.lit(r"(?i)<script\b")), F.lit(0)))
    keep = ["site_id", "asked", "url", "depth", "ord", "status", "fetch_error", "n_js", "n_scripts"]
    named = ready.withColumnRenamed("url", "asked").withColumnRenamed("final_url", "url")
    return under_render_reason(html.parse(named, keep)).withColumn("render_reason", F.when(F.col("fetch_error").isNull(), F.col("render_reason")))


def _rendered(pages: DataFrame, used: DataFrame, render: Get | None, budget: int) -> DataFrame:
    """``pages`` with what rendering made of those that need it, as far as a site's budget goes; adds ``fetch_method`` and ``tried``."""
    plain = pages.withColumn("fetch_method", F.lit("http")).withColumn("tried", F.lit(False))
    if render is None:
        return plain
    needy = pages.where("render_reason is not null").join(used, "site_id", "left")
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy("ord"))
    tried = written(needy.withColumn("r", rank + F.coalesce("n_used", F.lit(0))).where(F.col("r") <= budget).select("site_id", "asked", "url"), "rendering")
    got = tried.join(render(tried.select("url").distinct()).where("fetch_error is null").select("url", F.decode("body", "UTF-8").alias("html")), "url")
    made = html.parse(got, ["site_id", "asked"], "url").withColumn("fetch_method", F.lit("headless"))
    own = [c for c in made.columns if c not in ("site_id", "asked", "fetch_method")]
    new = made.select("site_id", "asked", "fetch_method", *(F.col(c).alias(f"_{c}") for c in own))
    joined = pages.join(new, ["site_id", "asked"], "left").join(tried.select("site_id", "asked", F.lit(True).alias("t")), ["site_id", "asked"], "left")
    here = F.col("fetch_method").isNotNull()
    cells = [F.when(here, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in pages.columns]
    return joined.select(*cells, F.coalesce("fetch_method", F.lit("http")).alias("fetch_method"), F.coalesce("t", F.lit(False)).alias("tried"))


def crawl(seeds: DataFrame, get: Get, max_pages: int = 40, max_depth: int = 3, render: Get | None = None, max_rendered: int = RENDERED, agent: str = web.AGENT) -> SiteCrawl:
    """Crawls the sites of ``seeds`` (url); of several seeds of a host the first in order of their spelling counts."""
    max_pages, max_depth, max_rendered = C.bounds(max_pages, max_depth, max_rendered)
    seed = urls.normalize(F.col("url"))
    start = seeds.select(seed.alias("url")).where(urls.scheme(F.col("url")).isin("http", "https") & (urls.host(F.col("url")) != ""))
    start = start.groupBy(urls.host(F.col("url")).alias("site_id")).agg(F.min("url").alias("url")).withColumn("origin", F.concat(urls.part(F.col("url"), 1), F.lit("://"), urls.part(F.col("url"), 2)))
    asked = start.withColumn("robots_url", F.concat("origin", F.lit("/robots.txt")))
    got = get(asked.select(F.col("robots_url").alias("url"))).where("fetch_error is null").select(F.col("url").alias("robots_url"), _decoded("body", F.lit("")).alias("robots_txt"))
    start = written(asked.join(got, "robots_url", "left"), "sites")
    listed, sitemaps = _sitemaps(start, get)

    site = start.select("site_id", "origin")
    # Each robots.txt becomes rules once; waves join those, never its text.
    rules = written(C.robots_rules(start, agent), "robots")
    queue_order = Window.partitionBy("site_id").orderBy((~urls.relevant(F.col("url"))).cast("int"), F.length("url"), "url")
    first = listed.withColumn("ord", F.row_number().over(queue_order)).where(F.col("ord") <= 3 * max_pages)
    wave = start.select("site_id", "url", F.lit(0).alias("ord"), F.lit(0).alias("depth")).unionByName(first.select("site_id", "url", "ord", F.lit(1).alias("depth")))
    discovered = start.select("site_id", "url").unionByName(listed.where(~urls.non_html(F.col("url"))))
    visited, pages, skipped, blocked, left_over = None, [], [], [], []
    number = 0
    while True:
        wave = written(wave, "wave")
        if wave.isEmpty():
            break
        # Each URL once, at its first place; what is off-site or excluded is passed over.
        todo = wave.groupBy("site_id", "url").agg(F.min(F.struct("ord", "depth")).alias("m")).select("site_id", "url", "m.ord", "m.depth").join(site, "site_id")
        todo = todo.where(urls.same_site(F.col("url"), F.col("origin")) & ~urls.excluded(F.col("url")))
        if visited is not None:
            todo = todo.join(visited, ["site_id", "url"], "left_anti")
        todo = written(C.may_fetch(todo, rules).select("site_id", "url", "ord", "depth", "allowed"), "todo")
        counts = lambda: reduce(DataFrame.unionByName, pages).groupBy("site_id").agg(F.count("*").alias("n"), F.count_if("tried").alias("n_used")) if pages else None  # noqa: E731, B023
        place, mine = None, []
        while True:
            have = counts()
            room = site.select("site_id") if have is None else site.select("site_id").join(have, "site_id", "left")
            room = room.select("site_id", (F.lit(max_pages) - (F.lit(0) if have is None else F.coalesce("n", F.lit(0)))).alias("room")).where("room > 0")
            rest = todo.join(room, "site_id")
            if place is not None:
                rest = rest.join(place, "site_id", "left").where(F.col("ord") > F.coalesce("last", F.lit(-1))).drop("last")
            run = rest.where("allowed").withColumn("r", F.row_number().over(Window.partitionBy("site_id").orderBy("ord"))).where(F.col("r") <= F.col("room")).select("site_id", "url", "depth", "ord")
            run = written(run, "run")
            if run.isEmpty():
                break
            fetched = written(_fetched(run, get), "responses")
            used = have.select("site_id", "n_used") if have is not None else site.select("site_id", F.lit(0).alias("n_used"))
            read = written(_rendered(_parsed(fetched.where("is_page")), used, render, max_rendered).withColumn("wave", F.lit(number)), "read")
            pages.append(read)
            mine.append(read)
            skipped.append(fetched.where("not is_page").select("site_id", "url"))
            ends = run.groupBy("site_id").agg(F.max("ord").alias("last"))
            place = written(ends if place is None else place.unionByName(ends).groupBy("site_id").agg(F.max("last").alias("last")), "place")
        # Where the budget is met the queue was left at the last page; elsewhere it was emptied.
        have = counts()
        full = None if have is None else have.where(F.col("n") >= max_pages).select("site_id", F.lit(True).alias("full"))
        ended = site.select("site_id").withColumn("full", F.lit(False)) if full is None else site.select("site_id").join(full, "site_id", "left")
        ended = ended.withColumn("last", F.lit(-1)) if place is None else ended.join(place, "site_id", "left")
        upto = F.when(F.coalesce("full", F.lit(False)), F.coalesce("last", F.lit(-1))).otherwise(F.lit(1 << 30))
        ended = written(ended.select("site_id", upto.alias("upto")), "ended")
        gone = written(todo.join(ended, "site_id").where(F.col("ord") <= F.col("upto")).select("site_id", "url", "allowed"), "gone")
        blocked.append(gone.where("not allowed").select("site_id", "url"))
        left_over.append(wave.join(ended, "site_id").where(F.col("ord") > F.col("upto")).select("site_id"))
        visited = gone.select("site_id", "url") if visited is None else visited.unionByName(gone.select("site_id", "url"))
        if not mine:
            break
        # Links in the order of their pages, the relevant and short ones of a page first.
        linked = reduce(DataFrame.unionByName, mine).where(F.col("depth") < max_depth).select("site_id", F.col("ord").alias("parent"), (F.col("depth") + 1).alias("depth"), F.posexplode("links").alias("k", "raw")).join(site.select("site_id", "origin"), "site_id")
        fit = urls.same_site(F.col("raw"), F.col("origin")) & ~urls.excluded(F.col("raw")) & ~urls.non_html(F.col("raw"))
        order = Window.partitionBy("site_id").orderBy("parent", (~urls.relevant(F.col("raw"))).cast("int"), F.length("raw"), "k")
        wave = written(linked.where(fit).select("site_id", urls.normalize(F.col("raw")).alias("url"), "depth", F.row_number().over(order).alias("ord")), "links")
        discovered = discovered.unionByName(wave.select("site_id", "url"))
        if full is not None:
            left_over.append(wave.join(full, "site_id", "left_semi").select("site_id"))
            wave = wave.join(full, "site_id", "left_anti")
        number += 1
    return _result(start, pages, skipped, blocked, left_over, discovered, sitemaps, max_rendered, render is not None)


def _result(start: DataFrame, pages: list[DataFrame], skipped: list[DataFrame], blocked: list[DataFrame], left_over: list[DataFrame], discovered: DataFrame, sitemaps: DataFrame, max_rendered: int, renders: bool) -> SiteCrawl:
    union = lambda parts, like: reduce(DataFrame.unionByName, parts) if parts else like.where("false")
    none = start.select("site_id", "url")
    kept = reduce(DataFrame.unionByName, pages).withColumn("page_ord", F.row_number().over(Window.partitionBy("site_id").orderBy("wave", "ord"))) if pages else None
    stopped = union(blocked, none).distinct()
    reach = start.select("site_id", F.col("robots_txt").isNotNull().alias("robots_accessible"))
    parts = {
        "n_blocked": _per_site(stopped, F.count("*").alias("n_blocked")), "n_sitemaps": _per_site(sitemaps, F.count("*").alias("n_sitemaps")), "pages_discovered": _per_site(discovered.distinct(), F.count("*").alias("pages_discovered")),
        "non_html_skipped": _per_site(union(skipped, none), F.count("*").alias("non_html_skipped")), "left": _per_site(union(left_over, none.select("site_id")), F.count("*").alias("left")),
    }
    if kept is not None:
        used = F.count_if(F.col("fetch_method") == "headless")
        parts["pages"] = _per_site(kept, F.count("*").alias("pages_analyzed"), F.count_if(F.col("render_reason").isNotNull()).alias("headless_needed"), used.alias("headless_used"))
    for part in parts.values():
        reach = reach.join(part, "site_id", "left")
    if kept is None:
        reach = reach.withColumns({c: F.lit(0) for c in ("pages_analyzed", "headless_needed", "headless_used")})
        kept = html.parse(start.select("site_id", "url", F.lit(0).alias("status"), F.lit("").alias("html")), ["site_id", "url", "status"]).where("false").withColumn("page_ord", F.lit(0))
    reach = reach.fillna(0).withColumn("page_limit_reached", F.col("left") > 0).withColumn("headless_budget_reached", F.lit(renders) & (F.col("headless_needed") > max_rendered)).drop("left")
    return SiteCrawl(written(kept.withColumn("page_id", F.monotonically_increasing_id()), "crawl"), written(reach, "reach"), stopped)
