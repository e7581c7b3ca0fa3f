"""Robots rules against the standard library's parser, sitemaps against the standard library's XML."""

import random
from urllib.robotparser import RobotFileParser
from xml.etree import ElementTree

from pyspark.sql import functions as F

from sievemark.operators import crawl

PATHS = ["/", "", "/a", "/a/b", "/a b", "/a%20b", "/é", "/%C3%A9", "/x?y=1", "/x?", "/x#", "/x;", "/x;p", "*", "/*", "/a+b", "/~u", "/50%", "/a%2Fb", "/q?#f", "//d", "/Z.html"]
AGENTS = ["*", "sievemark", "Sieve", "other", "", "sievemark/2.0", "*bot"]


def robots(rng):
    lines = []
    for _ in range(rng.randrange(0, 16)):
        kind = rng.randrange(10)
        if kind < 3:
            lines.append(rng.choice(["User-agent:", "user-agent :", "USER-AGENT:"]) + rng.choice([" ", ""]) + rng.choice(AGENTS))
        elif kind < 7:
            lines.append(rng.choice(["Disallow:", "Allow:", "disallow :", "allow:"]) + rng.choice([" ", "", "\t"]) + rng.choice(PATHS) + rng.choice(["", "", " # note", "  "]))
        elif kind == 7:
            lines.append(rng.choice(["", "", " ", "# c"]))
        else:
            lines.append(rng.choice(["Crawl-delay: 3", "Request-rate: 1/2", "Sitemap: https://a.test/s.xml", "nonsense", "Host: x"]))
    return rng.choice(["\n", "\r\n"]).join(lines)


def test_rules_equal_the_standard_parser(spark):
    rng = random.Random(4)
    files = [(f"s{k}", robots(rng)) for k in range(400)] + [("none", None), ("empty", "")]
    urls = [f"https://h.test{p}" for p in PATHS if p != "*"] + ["http://h.test", "https://h.test/a/b/c?x=2#y", "https://h.test/x;p?q", "https://h.test/%7Eu/1"]
    sites = spark.createDataFrame(files, "site_id string, robots_txt string")
    asked = sites.select("site_id", F.explode(F.array(*map(F.lit, urls))).alias("url"))
    got = {(r.site_id, r.url): r.allowed for r in crawl.may_fetch(asked, crawl.robots_rules(sites, "sievemark/1.0")).collect()}
    wrong = []
    for site, text in files:
        parser = RobotFileParser()
        parser.parse((text or "").splitlines())
        wrong += [(text, u) for u in urls if got[site, u] != parser.can_fetch("sievemark/1.0", u)]
    assert not wrong, wrong[:3]
    assert len(set(got.values())) == 2
    plan = crawl.may_fetch(asked, crawl.robots_rules(sites, "x"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_sitemaps_equal_the_standard_xml(spark):
    space = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    bodies = [
        f'<?xml version="1.0" encoding="UTF-8"?>\n<!-- c --><urlset {space}><url><loc> https://a.test/1 </loc><lastmod>2024</lastmod></url><url><loc>https://a.test/2?x=1&amp;y=2</loc></url><url/></urlset>',
        f"<sitemapindex {space}><sitemap><loc>https://a.test/s1.xml</loc></sitemap><sitemap><loc><![CDATA[https://a.test/s2.xml]]></loc></sitemap></sitemapindex>",
        "<s:urlset xmlns:s='http://www.sitemaps.org/schemas/sitemap/0.9'><s:url><s:loc>https://a.test/p</s:loc></s:url></s:urlset>", "<urlset></urlset>", "<urlset/>", "<urlset><url><loc>x</loc></urlset>", "no xml", "", None,
        "<urlset><url><loc>https://a.test/one</loc></url></urlset>",
    ]
    got = {r.id: r.e for r in spark.createDataFrame(list(enumerate(bodies)), "id int, xml string").select("id", crawl.sitemap_entries(F.col("xml")).alias("e")).collect()}
    for k, body in enumerate(bodies):
        try:
            root = ElementTree.fromstring(body)
        except (ElementTree.ParseError, TypeError):
            assert got[k] is None, body
            continue
        locs = lambda kind: [n.text.strip() for n in root.findall(f".//{{*}}{kind}/{{*}}loc") if n.text]  # noqa: B023, E731
        assert (got[k].is_index, got[k].pages, got[k].children) == (root.tag.endswith("sitemapindex"), locs("url"), locs("sitemap")), body
    bomb = '<!DOCTYPE x [<!ENTITY a "aaaa"><!ENTITY b "&a;&a;">]><urlset><url><loc>&b;</loc></url></urlset>'
    assert spark.createDataFrame([(bomb,)], "xml string").select(crawl.sitemap_entries(F.col("xml")).alias("e")).first().e is None
