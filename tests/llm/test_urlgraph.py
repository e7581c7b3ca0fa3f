"""Verdicts of hosts that have links to them."""

import pytest

pytest.importorskip("sievemark.llm.queries")

from sievemark.llm import urlfilter  # noqa: E402
from sievemark.llm.queries import URL_RULES  # noqa: E402


def test_hosts_with_links_to_them(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts)
    rows = [("https://bad.net/", ""), ("https://farm.test/", link("bad.net")), ("https://sat.test/", link("farm.test"))]
    rows += [("https://two.net/", ""), ("https://one.test/", link("two.net")), ("https://other.test/", link("two.net"))]
    rows += [(f"https://example.com/de/{k}", "") for k in range(9)] + [("https://example.com/en/", ""), ("https://fan.test/", link("example.com"))]
    rows += [("https://wide.test/", link("bad.net", *(f"h{k}.test" for k in range(20))))]
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id bigint, url string, html string")
    got = {r.host + r.path: r.verdict for r in urlfilter.judge(pages, URL_RULES).collect()}
    assert {h for h, v in got.items() if v == "block" and ".test" in h} == {"farm.test/", "one.test/", "other.test/", "fan.test/"}
    assert got["example.com/en/"] == "block" and got["sat.test/"] == got["wide.test/"] == "allow"


def test_propagation_against_its_sql(spark):
    import duckdb

    from sievemark.llm.queries import ORACLES, QUERIES

    got = sorted((r.host, r.mass) for r in QUERIES["host_propagation"](spark, "").collect())
    assert got == sorted(duckdb.sql(ORACLES["host_propagation"]).fetchall()) and len(got) == 14


def test_rounds_go_on_until_nothing_moves(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, n bigint")
    ranks = {r.host: r.mass for r in urlfilter.propagate(edges, spark.createDataFrame([("a", 1.0)], "host string, seed double"), tolerance=1e-8).collect()}
    assert abs(ranks["a"] - 0.15 / (1 - 0.85**2)) < 1e-6 and abs(ranks["b"] - 0.85 * ranks["a"]) < 1e-6
    alone = urlfilter.propagate(edges.where("false"), spark.createDataFrame([("a", 0.5)], "host string, seed double")).collect()
    assert [(r.host, r.mass) for r in alone] == [("a", 0.5)]
