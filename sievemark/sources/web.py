"""Connectors: a batch data source over fetchers, and sinks of reports.

The fetcher is injected, as a crawl's network is not the engine's business: any function from a URL to (status, content type, body,
final URL) will do, such as one over ``urllib``. Every task reads its own URLs; a failure is a row, not an error.
"""

from __future__ import annotations

import ipaddress
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import escaped
from ..shipping import ship

Fetch = Callable[[str], tuple[int, str, bytes, str]]
BODY_BYTES, TIMEOUT = 5_000_000, 12
AGENT = "sievemark/0.1"
RESPONSE = "url string, final_url string, status int, content_type string, body binary, fetch_error string"


#: Bounds of a single page's audit: bytes, seconds, redirects; the statuses that mean a page is kept away.
PAGE_BYTES, PAGE_TIMEOUT, REDIRECTS, BLOCKED = 750_000, 6, 3, (401, 403, 429, 451)
PAGE = "url string, final_url string, status int, html string, blocked boolean, error string"


def public(url: str) -> bool:
    """Whether a fetcher may go to a URL; the same test as ``urls.safe_public``, for where there is no column. Names aren't resolved here."""
    from urllib.parse import urlsplit

    try:
        parts = urlsplit(url)
        name = (parts.hostname or "").lower()
    except ValueError:
        return False
    if parts.scheme not in ("http", "https") or "@" in parts.netloc or not name or name == "localhost" or name.endswith((".localhost", ".local", ".internal")):
        return False
    try:
        ip = ipaddress.ip_address(name)
    except ValueError:
        return True
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return ip.is_global and not ip.is_multicast


def unpacked(body: bytes, most: int) -> bytes:
    """Up to ``most`` bytes of a gzip body; the rest is never unpacked."""
    return zlib.decompressobj(zlib.MAX_WBITS | 16).decompress(body, most)


def fetch_url(url: str, timeout: float = TIMEOUT) -> tuple[int, str, bytes, str]:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": AGENT, "Accept": "text/html,*/*;q=0.1"}), timeout=timeout) as r:
        body = r.read(BODY_BYTES)
        return r.status, r.headers.get("Content-Type", ""), unpacked(body, BODY_BYTES) if r.headers.get("Content-Encoding", "").lower() == "gzip" else body, r.geturl()


def response_row(url: str, fetch: Fetch) -> tuple:
    import http.client
    from urllib.error import HTTPError

    if not public(url):
        return url, url, 0, "", None, "UnsafeURL: not a public http(s) URL"
    try:
        status, kind, body, final = fetch(url)
        if not public(final):
            return url, final, 0, "", None, "UnsafeURL: redirected to a URL that isn't public"
        return url, final, status, kind, bytes(body[:BODY_BYTES]), None
    except HTTPError as e:
        return url, url, e.code, "", None, str(e)
    except (OSError, ValueError, EOFError, zlib.error, http.client.HTTPException) as e:
        return url, url, 0, "", None, f"{type(e).__name__}: {e}"


def open_url(url: str, timeout: float = PAGE_TIMEOUT) -> tuple[int, dict, bytes]:
    """(status, headers, body) of one request; redirects aren't followed, and one byte more than a page may have is read."""
    import http.client
    from urllib.parse import urlsplit

    parts = urlsplit(url)
    kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
    c = kind(parts.netloc, timeout=timeout)
    try:
        c.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers={"User-Agent": AGENT, "Accept": "text/html,application/xhtml+xml"})
        r = c.getresponse()
        return r.status, dict(r.headers), r.read(PAGE_BYTES + 1)
    finally:
        c.close()


def bounded_row(url: str, opener: Callable[[str], tuple[int, dict, bytes]] = open_url) -> dict:
    """One page within bounds: each redirect is tested anew, a refusing status is a blocked page, all else that is no HTML page an error code."""
    import http.client
    from urllib.parse import urljoin

    out = {"url": url, "final_url": url, "status": None, "html": None, "blocked": False, "error": None}
    at = url
    for hop in range(REDIRECTS + 1):
        if not public(at):
            return out | {"error": "unsafe_url"}
        try:
            status, headers, body = opener(at)
        except TimeoutError:
            return out | {"error": "timeout"}
        except (OSError, ValueError, EOFError, http.client.HTTPException):
            return out | {"error": "unreachable"}
        headers = {k.lower(): v for k, v in headers.items()}
        out |= {"final_url": at, "status": status}
        if status in (301, 302, 303, 307, 308):
            if not headers.get("location"):
                return out | {"error": "bad_redirect"}
            at = urljoin(at, headers["location"])
            continue
        if status in BLOCKED:
            return out | {"html": "", "blocked": True}
        if not 200 <= status <= 299:
            return out | {"error": "http_error"}
        if not any(t in headers.get("content-type", "").lower() for t in ("text/html", "application/xhtml+xml")):
            return out | {"error": "not_html"}
        if len(body) > PAGE_BYTES or int(headers.get("content-length") or 0) > PAGE_BYTES:
            return out | {"error": "too_large"}
        return out | {"html": body.decode("utf-8", "replace")}
    return out | {"error": "too_many_redirects"}


def bounded_pages(urls: DataFrame, opener: Callable[[str], tuple[int, dict, bytes]] = open_url) -> DataFrame:
    """``bounded_row`` of each URL of a table, where the rows are."""
    import pyarrow as pa

    kinds = pa.schema([("url", pa.string()), ("final_url", pa.string()), ("status", pa.int32()), ("html", pa.string()), ("blocked", pa.bool_()), ("error", pa.string())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([bounded_row(u, opener) for u in b.column("url").to_pylist()], kinds)

    ship(urls.sparkSession)
    return urls.select("url").mapInArrow(run, PAGE)


class Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class PageReader(DataSourceReader):
    def __init__(self, urls: list[str], size: int, fetch: Fetch):
        self.urls, self.size, self.fetch = urls, size, fetch

    def partitions(self) -> list[Urls]:
        return [Urls(self.urls[k : k + self.size]) for k in range(0, len(self.urls), self.size)]

    def read(self, partition: Urls) -> Iterator[tuple]:
        for url in partition.urls:
            yield response_row(url, self.fetch)


class WebPages(DataSource):
    """``spark.read.format("web_pages").option("urls", "a b c")``: one row per URL."""

    fetch: Fetch = staticmethod(fetch_url)

    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return RESPONSE

    def reader(self, schema) -> PageReader:
        return PageReader(self.options.get("urls", "").split(), int(self.options.get("perPartition", "20")), type(self).fetch)


def fetch_pages(urls: DataFrame, fetch: Fetch = fetch_url) -> DataFrame:
    """The same for a table of URLs of any size: fetched where the rows are, without the driver."""
    import pyarrow as pa

    names = ["url", "final_url", "status", "content_type", "body", "fetch_error"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string()]

    def run(batches):
        for b in batches:
            rows = [response_row(u, fetch) for u in b.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    ship(urls.sparkSession)
    return urls.select("url").mapInArrow(run, RESPONSE)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(WebPages)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


#: Proofs of one fact in a report at most.
PROOFS = 8


def _rows(df: DataFrame, order: list[Column], *cells: Column) -> DataFrame:
    """(site_id, rows): one HTML table row per row of a site, in order; all cells escaped."""
    row = F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), escaped(F.coalesce(c.cast("string"), F.lit(""))), F.lit("</td>")) for c in cells), F.lit("</tr>"))
    keyed = df.select("site_id", F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order)), row.alias("x")).alias("i"))
    return keyed.groupBy("site_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda x: x["x"]), "").alias("rows"))


def report_html(scores: DataFrame, issues: DataFrame, facts: DataFrame | None = None, offers: DataFrame | None = None, results: DataFrame | None = None) -> DataFrame:
    """(site_id, html): a page per site with scores, issues and, where given, facts with proofs, offers and rules. Values are escaped; text stays in the JVM."""
    proofs = lambda: F.array_join(F.transform(F.slice("evidence", 1, PROOFS), lambda e: F.concat_ws(": ", e["url"], e["excerpt"])), " | ")
    c = F.col
    parts: dict[str, tuple[DataFrame, tuple[str, ...]]] = {
        "Issues": (_rows(issues, [-c("impact"), c("issue_id") if "issue_id" in issues.columns else c("rule_id")], c("priority"), c("title"), c("impact"), *([proofs()] if "evidence" in issues.columns else [])), ("Priority", "Issue", "Impact", *(["Proof"] if "evidence" in issues.columns else []))),
    }
    if facts is not None:
        parts["Facts"] = _rows(facts.where("state <> 'unknown'"), [c("field")], c("field"), c("state"), F.array_join("values", ", "), c("confidence"), proofs()), ("Fact", "State", "Values", "Confidence", "Proof")
    if offers is not None:
        parts["Offers"] = _rows(offers, [c("rank")], c("name"), c("offer_type"), c("price"), c("availability"), c("cta"), c("url"), proofs()), ("Offer", "Kind", "Price", "Availability", "Next step", "Page", "Proof")
    if results is not None:
        told = [proofs()] if "evidence" in results.columns else []
        parts["Rules"] = _rows(results, [c("ord")], c("rule_id"), c("status"), c("points_awarded"), c("points_possible"), *told), ("Rule", "Status", "Points", "Of", *(["Proof"] if told else []))
    joined, body = scores, []
    for name, (rows, heads) in parts.items():
        joined = joined.join(rows.withColumnRenamed("rows", name), "site_id", "left")
        head = "".join(f"<th>{h}</th>" for h in heads)
        body += [F.lit(f"<h2>{name}</h2><table><tr>{head}</tr>"), F.coalesce(name, F.lit("")), F.lit("</table>")]
    card = lambda s: F.concat(F.lit(f"<p>{s}: "), c(s).cast("string"), F.lit("</p>"))
    html = F.concat(F.lit("<!doctype html><html><body><h1>"), escaped(c("site_id")), F.lit("</h1>"), *map(card, ("ai_readiness", "ai_discoverability", "understanding", "buyability")), *body, F.lit("</body></html>"))
    return joined.select("site_id", html.alias("html"))


def summary(audits: DataFrame) -> DataFrame:
    """The projection that tools get of a page audit."""
    return audits.select("url", "status", "acquisition", "visibility", "understanding", "buyability", "observed_readiness", F.transform("next_actions", lambda a: a["title"]).alias("next_actions"))
