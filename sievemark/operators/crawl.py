"""The crawl as relations: bounded breadth-first search over a link table, robots rules, sitemaps. No network here.

One pass of the loop per depth (at most ``MAX_DEPTH``): the frontier joins the links, new URLs are those not seen. Only the number of new rows comes
to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls

MAX_PAGES, MAX_DEPTH = 200, 8
SITEMAPS, CHILDREN, SITEMAP_DEPTH = 5, 20, 2


def bounds(max_pages: int, max_depth: int, headless: int) -> tuple[int, int, int]:
    pages = max(1, min(max_pages, MAX_PAGES))
    return pages, max(0, min(max_depth, MAX_DEPTH)), max(0, min(headless, pages))


def breadth_first(seeds: DataFrame, links: DataFrame, max_depth: int = 3, max_pages: int = 40) -> DataFrame:
    """(origin, url, depth, place, visited): URLs a crawl of each origin meets, and which fit its page budget.

    ``seeds``: (origin); ``links``: (src, dst, ord). Off-site, excluded and non-HTML targets are not followed; among links of a page
    relevant ones come first, then short ones, then in their order.
    """
    max_pages, max_depth, _ = bounds(max_pages, max_depth, 0)
    norm = lambda c: urls.normalize(F.col(c))
    edges = links.select(norm("src").alias("src"), F.col("dst").alias("raw"), norm("dst").alias("dst"), "ord").where(~urls.excluded(F.col("raw")) & ~urls.non_html(F.col("raw")))
    seen = seeds.select("origin", norm("origin").alias("url"), F.lit(0).alias("depth"), F.array(F.lit(0).cast("bigint")).alias("path"))
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.select("origin", F.col("url").alias("src"), "path").join(edges, "src").where(urls.same_site(F.col("raw"), F.col("origin")))
        rank = F.row_number().over(Window.partitionBy("origin", "src").orderBy((~urls.relevant(F.col("raw"))).cast("int"), F.length("raw"), "ord")).cast("bigint")
        found = step.select("origin", F.col("dst").alias("url"), F.lit(depth).alias("depth"), F.concat("path", F.array(rank)).alias("path"))
        found = found.groupBy("origin", "url", "depth").agg(F.min("path").alias("path")).join(seen.select("origin", "url"), ["origin", "url"], "left_anti").checkpoint()
        if found.isEmpty():
            break
        seen, frontier = seen.unionByName(found), found
    order = Window.partitionBy("origin").orderBy("depth", "path", "url")
    return seen.withColumn("place", F.row_number().over(order)).select("origin", "url", "depth", "place", (F.col("place") <= max_pages).alias("visited"))


def sitemaps_of(robots_txt: Column, origin: Column) -> Column:
    """Sitemaps that robots.txt declares, each once and the first five; else the usual place."""
    lines = F.filter(F.split(robots_txt, r"\r?\n"), lambda x: F.startswith(F.lower(x), F.lit("sitemap:")))
    named = F.array_distinct(F.transform(lines, lambda x: F.trim(F.substring(x, 9, 1 << 20))))
    return F.slice(F.when(F.size(named) > 0, named).otherwise(F.array(F.concat(origin, F.lit("/sitemap.xml")))), 1, SITEMAPS)


_LOCATIONS = "url array<struct<loc:string>>, sitemap array<struct<loc:string>>, _corrupt_record string"


def sitemap_entries(xml: Column) -> Column:
    """(is_index, pages, children) of a sitemap's XML; null if it isn't well-formed, or if it declares entities or a document type,
    which sitemaps have no use for."""
    text = F.regexp_replace(xml, "^\ufeff", "")
    read = F.from_xml(text, _LOCATIONS, {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    # The first element after declarations and comments.
    root = F.regexp_extract(text, r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*)*<(?:[^\s<>/:]+:)?([^\s<>/:]+)", 1)
    locs = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<struct<loc:string>>")), lambda x: F.regexp_replace(x["loc"], r"^\s+|\s+$", "")), lambda u: F.coalesce(u != "", F.lit(False)))
    good = (root != "") & ~text.rlike("<!(DOCTYPE|ENTITY)")
    made = T.let(read, lambda r: F.when(r.isNotNull() & r["_corrupt_record"].isNull(), F.struct(F.endswith(root, F.lit("sitemapindex")).alias("is_index"), locs(r["url"]).alias("pages"), locs(r["sitemap"]).alias("children"))))
    return F.when(good, made)


def sitemap_pages(start: DataFrame, documents: DataFrame) -> DataFrame:
    """(origin, sitemap, url): same-site page URLs of sitemaps and of the sitemaps that indexes name, two levels down.

    ``start``: (origin, sitemap); ``documents``: (sitemap, xml).
    """
    known = documents.select("sitemap", sitemap_entries(F.col("xml")).alias("e")).where("e.is_index is not null")
    level, out = start.select("origin", "sitemap"), None
    for depth in range(SITEMAP_DEPTH + 1):
        read = level.join(known, "sitemap")
        goes_on = F.col("e.is_index") & F.lit(depth < SITEMAP_DEPTH)
        pages = read.where(~goes_on).select("origin", "sitemap", F.explode("e.pages").alias("raw")).where(urls.same_site(F.col("raw"), F.col("origin")))
        pages = pages.select("origin", "sitemap", urls.normalize(F.col("raw")).alias("url"))
        out = pages if out is None else out.unionByName(pages)
        level = read.where(goes_on).select("origin", F.explode(F.slice("e.children", 1, CHILDREN)).alias("sitemap")).where(urls.same_site(F.col("sitemap"), F.col("origin")))
    return out.distinct()


# -- robots ------------------------------------------------------------------------------------------------------------

_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]"


def _unquoted(c: Column) -> Column:
    """Percent escapes decoded; a plus and a lone percent sign stay."""
    return F.try_url_decode(F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25"))


def _quoted(c: Column) -> Column:
    """Everything escaped but letters, digits and ``_ . - ~ /``."""
    out = F.url_encode(c)
    for raw, name in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def _reparsed(c: Column) -> Column:
    """Without markers of parameters, queries and fragments that are empty."""
    bare = F.regexp_replace(c, r"^([^#]*)#$", "$1")
    bare = F.regexp_replace(bare, r"^([^?#]*)\?(?=#|$)", "$1")
    return F.regexp_replace(bare, r"^((?:[^?#]*/)?[^;/?#]*);(?=[?#]|$)", "$1")


def robots_rules(sites: DataFrame, agent: str) -> DataFrame:
    """(site_id, ord, path, allow): the rules of each site's robots.txt (site_id, robots_txt) that hold for ``agent``, in order.

    A group is a run of agents and the rules after it; a blank line ends it, and rules before any agent don't count. The first group that names
    a part of the agent's name holds, else the first for all agents. Native: lines are rows.
    """
    lines = sites.where(F.col("robots_txt").isNotNull()).select("site_id", F.posexplode(F.split("robots_txt", _LINE_END)).alias("n", "raw"))
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    said = strip(F.regexp_replace("raw", "(?s)#.*$", ""))
    parts = F.split(said, ":", 2)
    key = F.when(F.size(parts) == 2, F.lower(strip(parts[0])))
    kind = F.when(F.col("raw") == "", "blank").when(key == "user-agent", "agent").when(key.isin("allow", "disallow", "crawl-delay", "request-rate"), key)
    told = lines.select("site_id", "n", kind.alias("kind"), F.when(F.size(parts) == 2, _unquoted(strip(parts[1]))).alias("value")).where("kind is not null")
    order = Window.partitionBy("site_id").orderBy("n")
    told = told.withColumn("part", F.sum((F.col("kind") == "blank").cast("int")).over(order)).where("kind <> 'blank'")
    in_part = Window.partitionBy("site_id", "part").orderBy("n")
    told = told.withColumn("named", F.max((F.col("kind") == "agent").cast("int")).over(in_part)).where("named = 1")
    begins = (F.col("kind") == "agent") & (F.coalesce(F.lag("kind").over(in_part), F.lit("")) != "agent")
    told = told.withColumn("group", F.sum(begins.cast("int")).over(order))
    name = agent.split("/")[0].lower()
    is_agent = F.col("kind") == "agent"
    # One small row a group: does it hold for this agent, or for all?
    groups = told.groupBy("site_id", "group").agg(
        F.count_if(~is_agent).alias("rules"), F.coalesce(F.bool_or(F.when(is_agent, F.col("value") == "*")), F.lit(False)).alias("all"),
        F.coalesce(F.bool_or(F.when(is_agent, F.contains(F.lit(name), F.lower("value")))), F.lit(False)).alias("ours"),
    )
    chosen = groups.where("rules > 0 and (`all` or ours)").groupBy("site_id").agg(F.min(F.struct("all", "group")).alias("g")).select("site_id", F.col("g.group").alias("group"))
    allow = (F.col("kind") == "allow") | (F.col("value") == "")
    rules = told.where("kind in ('allow', 'disallow')").join(chosen, ["site_id", "group"])
    return rules.select("site_id", F.col("n").alias("ord"), _quoted(_reparsed(F.col("value"))).alias("path"), allow.alias("allow"))


def robots_path(url: Column) -> Column:
    """What of a URL rules are held against."""
    path = F.regexp_replace(F.regexp_replace(_unquoted(url), r"^[A-Za-z][A-Za-z0-9+.\-]*:", ""), r"^//[^/?#]*", "")
    path = _reparsed(path)
    return F.coalesce(F.nullif(_quoted(F.when(F.startswith(path, F.lit("//")), F.concat(F.lit("//"), path)).otherwise(path)), F.lit("")), F.lit("/"))


def may_fetch(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``allowed`` to (site_id, url, ...): what the first of the site's rules says whose path the URL's begins with; true without one."""
    asked = pages.select("site_id", "url").distinct().withColumn("target", robots_path(F.col("url")))
    met = asked.join(rules, "site_id").where(F.startswith("target", F.col("path")))
    verdict = met.groupBy("site_id", "url").agg(F.min_by("allow", "ord").alias("allowed"))
    return pages.join(verdict, ["site_id", "url"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))
