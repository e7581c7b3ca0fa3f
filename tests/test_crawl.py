"""The crawl of many sites against a plain first-in-first-out crawl of one site after another."""

from collections import deque
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from sievemark import lexicons as L
from sievemark.catalog import web as made
from sievemark.plans import sitecrawl
from sievemark.sources import html, web


def clean(url):
    """Normalised form; the made URLs need no more than this."""
    s = urlsplit(url)
    path = s.path.rstrip("/") or "/"
    return f"{s.scheme}://{s.netloc}{path}" + (f"?{s.query}" if s.query else "")


def relevance(url):
    return (not any(t in url.lower() for t in L.RELEVANT_TOKENS), len(url))


def fits(url, host):
    s = urlsplit(url)
    return s.scheme in ("http", "https") and s.hostname == host and not any(t in s.path.lower() for t in L.EXCLUDED_TOKENS)


def one_site(host, responses, max_pages, max_depth):
    base, get = f"https://{host}", lambda u: responses[u][4] if u in responses and responses[u][5] is None else None
    robot, raw = RobotFileParser(), get(f"{base}/robots.txt")
    robot.parse(raw.decode().splitlines() if raw else [])
    maps = [x.split(":", 1)[1].strip() for x in (raw or b"").decode().splitlines() if x.lower().startswith("sitemap:")] or [f"{base}/sitemap.xml"]
    listed, read = [], set()

    def sitemap(url, depth):
        body = get(url)
        try:
            root = ElementTree.fromstring(body or "")
        except ElementTree.ParseError:
            return
        read.add(url)
        if root.tag.endswith("sitemapindex") and depth < 2:
            for n in root.findall(".//{*}sitemap/{*}loc"):
                if urlsplit(n.text.strip()).hostname == host:
                    sitemap(n.text.strip(), depth + 1)
        else:
            listed.extend(clean(n.text.strip()) for n in root.findall(".//{*}url/{*}loc") if urlsplit(n.text.strip()).hostname == host)

    for m in maps[:5]:
        sitemap(m, 0)
    dull = lambda u: any(urlsplit(u).path.lower().endswith(t) for t in L.NON_HTML_EXTENSIONS)
    queue = deque([(f"{base}/", 0)] + [(u, 1) for u in sorted(sorted(set(listed)), key=relevance)[: 3 * max_pages]])
    seen, pages, blocked, skipped = set(), [], set(), 0
    found = {f"{base}/"} | {u for u in listed if not dull(u)}
    while queue and len(pages) < max_pages:
        url, depth = queue.popleft()
        url = clean(url)
        if url in seen or not fits(url, host):
            continue
        seen.add(url)
        if raw and not robot.can_fetch(web.AGENT, url):
            blocked.add(url)
            continue
        status, kind, body, error = (responses[url][k] for k in (2, 3, 4, 5)) if url in responses else (0, "", None, "missing")
        if error:
            pages.append((url, depth, status))
            continue
        if "text/html" not in kind:
            skipped += 1
            continue
        pages.append((url, depth, status))
        if depth < max_depth:
            for link in sorted(html.parse_one(url, body.decode("latin-1" if "latin" in kind else "utf-8"))["links"], key=relevance):
                if fits(link, host) and not dull(link):
                    found.add(clean(link))
                    queue.append((link, depth + 1))
    return pages, blocked, skipped, len(found), bool(queue) and len(pages) >= max_pages, len(read), bool(raw)


@pytest.mark.parametrize("max_pages, max_depth", [(12, 2), (1, 3), (200, 8)])
def test_crawl_against_one_site_after_another(spark, max_pages, max_depth):
    responses = {r[0]: r for r in made.made_responses()}
    got = sitecrawl.crawl(made.seeds(spark), sitecrawl.stored(made.small_web(spark)), max_pages, max_depth)
    pages, reach, blocked = (x.collect() for x in (got.pages, got.reach, got.blocked))
    assert len(reach) == made.N_HOSTS
    for r in reach:
        want = one_site(r.site_id, responses, max_pages, max_depth)
        mine = sorted((p for p in pages if p.site_id == r.site_id), key=lambda p: p.page_ord)
        assert [(p.asked, p.depth, p.status) for p in mine] == want[0]
        assert {b.url for b in blocked if b.site_id == r.site_id} == want[1]
        assert (r.non_html_skipped, r.pages_discovered, r.page_limit_reached, r.n_sitemaps, r.robots_accessible, r.n_blocked) == (*want[2:], len(want[1]))
        assert r.pages_analyzed == len(mine) and not r.headless_budget_reached
    assert any("café" in p.text for p in pages if p.status == 200)  # both charsets


def test_rendering_keeps_its_budget(spark):
    got = sitecrawl.crawl(made.seeds(spark), sitecrawl.stored(made.small_web(spark)), 12, 2, made.made_rendering, 2)
    by_site = {}
    for p in got.pages.collect():
        by_site.setdefault(p.site_id, []).append(p)
    for r in got.reach.collect():
        needy = sorted((p for p in by_site[r.site_id] if p.render_reason), key=lambda p: p.page_ord)
        assert r.headless_needed == len(needy) and r.headless_budget_reached == (len(needy) > 2)
        done = [p for p in needy if p.fetch_method == "headless"]
        assert [p.asked for p in done] == [p.asked for p in needy[:2] if not p.url.endswith("1")] and r.headless_used == len(done)
        assert all("rendered words" in p.text for p in done)


def test_failures_are_rows(spark):
    import gzip
    import http.client
    import zlib

    errors = [EOFError(), zlib.error("bad"), http.client.IncompleteRead(b""), gzip.BadGzipFile(), OSError("down"), ValueError("no")]
    for e in errors:
        def fetch(url, e=e):
            raise e
        row = web.response_row("https://a.test/", fetch)
        assert row[2] == 0 and type(e).__name__ in row[5]
    assert web.response_row("http://127.0.0.1/", lambda u: (200, "text/html", b"x", u))[5].startswith("UnsafeURL")
    assert web.unpacked(gzip.compress(b"x" * 10_000_000), 1000) == b"x" * 1000
    assert spark.range(1).select(F.lit(web.public("https://8.8.8.8/"))).first()[0]
    assert not any(map(web.public, ("ftp://a.test/", "https://u:p@a.test/", "https://x.local/", "http://10.1.2.3/", "http://[::1]/", "nonsense")))


def test_bounded_fetch():
    hops = {"https://a.test/": (301, {"Location": "/b"}, b""), "https://a.test/b": (200, {"Content-Type": "text/html"}, b"<p>ok</p>"), "https://a.test/loop": (302, {"Location": "/loop"}, b""), "https://a.test/in": (302, {"Location": "http://10.0.0.1/"}, b""),
            "https://a.test/403": (403, {}, b""), "https://a.test/500": (500, {}, b""), "https://a.test/pdf": (200, {"Content-Type": "application/pdf"}, b"x"), "https://a.test/big": (200, {"Content-Type": "text/html"}, b"x" * 750_001), "https://a.test/no": (302, {}, b"")}
    get = lambda url: web.bounded_row(url, lambda u: hops[u])
    ok = get("https://a.test/")
    assert ok["final_url"] == "https://a.test/b" and ok["status"] == 200 and ok["html"] == "<p>ok</p>" and not ok["blocked"] and ok["error"] is None
    assert get("https://a.test/403")["blocked"] and get("https://a.test/403")["error"] is None
    want = {"loop": "too_many_redirects", "in": "unsafe_url", "500": "http_error", "pdf": "not_html", "big": "too_large", "no": "bad_redirect"}
    assert {k: get(f"https://a.test/{k}")["error"] for k in want} == want
    assert get("https://localhost/")["error"] == "unsafe_url"


def test_command_line(spark, tmp_path, capsys):
    from sievemark import cli

    get = sitecrawl.stored(made.small_web(spark))
    assert cli.main(["https://h2.test", "--max-pages", "4", "--max-depth", "1", "--json", str(tmp_path / "j"), "--html", str(tmp_path / "h")], get) == 0
    page = spark.read.text(str(tmp_path / "h")).first().value
    assert all(f"<h2>{x}</h2>" in page for x in ("Issues", "Facts", "Offers", "Rules")) and "DISC.LINKS.006" in page
    row = spark.read.json(str(tmp_path / "j")).first()
    assert row.site_id == "h2.test" and row.page_limit_reached and row.pages_analyzed == 4 and row.coverage_confidence <= 74
    assert cli.main([]) == 2 and cli.main(["https://gone.test"], sitecrawl.stored(made.small_web(spark).where("false"))) == 0
    args = cli.parser().parse_args(["https://a.test"])
    assert (args.max_pages, args.max_depth, args.timeout) == (40, 3, 12)
