"""Robots rules and sitemaps over the given tables: every supplier as a site whose robots.txt and sitemap come from its line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crawl

AGENT = "sievemark"
#: Line items of a supplier that become lines of its robots.txt.
LINES = 40


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, n, part, flag, status): the first line items of each supplier, numbered."""
    from pyspark.sql import Window

    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("s"), "l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    order = Window.partitionBy("s").orderBy("l_orderkey", "l_linenumber", "part")
    return t.withColumn("n", F.row_number().over(order)).where(F.col("n") <= LINES).select("s", "n", "part", "flag", "status")


def robots_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site_id, robots_txt): returns are disallowed, other lines allowed, with agents, blank lines and comments in between."""
    n, path = F.col("n"), F.concat(F.lit("/p/"), (F.col("part") % 50).cast("string"))
    agent = F.when(n % 22 == 1, "User-agent: other").when((F.col("s") + n) % 3 == 0, "User-Agent: *").otherwise("user-agent: SieveMark")
    line = F.when(n % 11 == 1, agent).when(n % 11 == 0, "").when(F.col("part") % 17 == 0, "# nothing").when(F.col("flag") == "R", F.concat(F.lit("Disallow: "), path)).when(F.col("flag") == "A", F.concat(F.lit("Allow:"), path, F.lit("  # ok"))).otherwise(F.concat(F.lit("disallow: "), path, F.lit("/old")))
    listed = _items(spark, sf_dir).groupBy("s").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("l"))
    return listed.select(F.concat(F.lit("s"), F.col("s").cast("string")).alias("site_id"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("robots_txt"))


def robots_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that hold for one agent, per site and in order."""
    return crawl.robots_rules(robots_files(spark, sf_dir), AGENT)


def robots_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages of each site the agent may fetch: those of all its line items' parts."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("site_id"), F.concat(F.lit("https://x.test/p/"), (F.col("l_partkey") % 60).cast("string"), F.lit("/old/"), F.col("l_linenumber").cast("string")).alias("url")).distinct()
    return crawl.may_fetch(t, crawl.robots_rules(robots_files(spark, sf_dir), AGENT)).groupBy("site_id").agg(F.count("*").alias("n_urls"), F.count_if("allowed").alias("n_allowed"))


def sitemap_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that the sitemaps of a site list, by way of an index; every seventh sitemap is broken."""
    s = F.col("s").cast("string")
    site = F.concat(F.lit("https://s"), s, F.lit(".test"))
    items = _items(spark, sf_dir)
    page = F.concat(F.lit("<url><loc> "), site, F.lit("/p/"), F.col("part").cast("string"), F.lit("?a=1&amp;b=2 </loc></url>"))
    name = F.concat(site, F.lit("/map"), (F.col("n") % 3).cast("string"), F.lit(".xml"))
    body = items.groupBy("s", name.alias("sitemap")).agg(F.array_join(F.array_sort(F.collect_list(page)), "").alias("x"), F.min(F.col("n") % 3).alias("k"))
    close = F.when((F.col("s") + F.col("k")) % 7 == 0, "</url>").otherwise("</urlset>")
    maps = body.select("sitemap", F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "x", close).alias("xml"))
    listed = body.groupBy("s").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "sitemap", F.lit("</loc></sitemap>")))), "").alias("x"))
    index = listed.select(F.concat(site, F.lit("/index.xml")).alias("sitemap"), F.concat(F.lit("<sitemapindex>"), "x", F.lit("</sitemapindex>")).alias("xml"))
    start = listed.select(site.alias("origin"), F.concat(site, F.lit("/index.xml")).alias("sitemap"))
    return crawl.sitemap_pages(start, maps.unionByName(index))


QUERIES = {f.__name__: f for f in (robots_rule_table, robots_verdicts, sitemap_listing)}

_ITEMS = f"""WITH i AS MATERIALIZED (SELECT * FROM (SELECT l_suppkey AS s, l_partkey AS part, l_returnflag AS flag, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n <= {LINES})"""
#: The same file as lines, and the same rules by its grammar: a line is an agent, a rule, blank, or nothing.
_RULES = rf"""{_ITEMS},
f AS (SELECT 's' || s AS site_id, string_agg(CASE WHEN n % 11 = 1 THEN CASE WHEN n % 22 = 1 THEN 'User-agent: other' WHEN (s + n) % 3 = 0 THEN 'User-Agent: *' ELSE 'user-agent: SieveMark' END WHEN n % 11 = 0 THEN '' WHEN part % 17 = 0 THEN '# nothing'
    WHEN flag = 'R' THEN 'Disallow: /p/' || part % 50 WHEN flag = 'A' THEN 'Allow:/p/' || part % 50 || '  # ok' ELSE 'disallow: /p/' || part % 50 || '/old' END, chr(10) ORDER BY n) AS txt FROM i GROUP BY s),
l AS (SELECT site_id, unnest(range(len(string_split(txt, chr(10)))))::INT AS n, unnest(string_split(txt, chr(10))) AS raw FROM f),
p AS (SELECT site_id, n, raw = '' AS blank, lower(trim(string_split(regexp_replace(raw, '#.*', ''), ':')[1])) AS key, trim(string_split(regexp_replace(raw, '#.*', ''), ':')[2]) AS value FROM l),
q AS (SELECT *, CASE WHEN blank THEN 'blank' WHEN key = 'user-agent' THEN 'agent' WHEN key IN ('allow', 'disallow') THEN 'rule' END AS kind, count(*) FILTER (blank) OVER (PARTITION BY site_id ORDER BY n) AS part FROM p),
w AS (SELECT *, count(*) FILTER (kind = 'agent') OVER (PARTITION BY site_id, part ORDER BY n) AS agents, lag(kind) OVER (PARTITION BY site_id, part ORDER BY n) AS prev FROM q WHERE kind IN ('agent', 'rule')),
g AS (SELECT *, count(*) FILTER (kind = 'agent' AND prev IS DISTINCT FROM 'agent') OVER (PARTITION BY site_id ORDER BY n) AS grp FROM w WHERE agents > 0),
h AS (SELECT site_id, grp, bool_or(kind = 'agent' AND value = '*') AS for_all, bool_or(kind = 'agent' AND contains('{AGENT}', lower(value))) AS ours FROM g GROUP BY 1, 2 HAVING count(*) FILTER (kind = 'rule') > 0),
c AS (SELECT site_id, arg_min(grp, for_all::INT * 1000 + grp) AS grp FROM h WHERE for_all OR ours GROUP BY 1),
r AS MATERIALIZED (SELECT g.site_id, g.n AS ord, g.value AS path, g.key = 'allow' AS allow FROM g JOIN c USING (site_id, grp) WHERE kind = 'rule')"""

ORACLES = {
    "robots_rule_table": f"{_RULES} SELECT * FROM r",
    "robots_verdicts": f"""{_RULES},
u AS (SELECT DISTINCT 's' || l_suppkey AS site_id, '/p/' || l_partkey % 60 || '/old/' || l_linenumber AS path FROM lineitem),
v AS (SELECT u.site_id, u.path, arg_min(r.allow, r.ord) AS allow FROM u LEFT JOIN r ON r.site_id = u.site_id AND starts_with(u.path, r.path) GROUP BY 1, 2)
SELECT site_id, count(*) AS n_urls, count(*) FILTER (coalesce(allow, true)) AS n_allowed FROM v GROUP BY 1""",
    "sitemap_listing": f"""{_ITEMS} SELECT DISTINCT 'https://s' || s || '.test' AS origin, 'https://s' || s || '.test/map' || n % 3 || '.xml' AS sitemap, 'https://s' || s || '.test/p/' || part || '?a=1&b=2' AS url FROM i WHERE (s + n % 3) % 7 <> 0""",
}
