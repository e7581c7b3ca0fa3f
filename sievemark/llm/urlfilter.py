"""URL filter: allow and block rules, and link-graph propagation for what no rule decides.

A rule names a host (with its subdomains) and the beginning of a path; the longest fitting rule decides. Other pages take
their host's verdict: trust flows by personalised PageRank along links from hosts that rules allow, distrust along reversed
links from hosts that rules block, each seeded with the share of the host's pages so ruled. What reaches a host is divided by what
would reach it if every host had seed 1: the share of the arriving mass that comes from such hosts, between 0 and 1 however the
graph is linked. A host's trust or distrust is the larger of that share and the share of its own pages. A host is blocked if its
distrust is at least ``THRESHOLD`` and above its trust. Without links the shares of its own pages alone decide.

Pages become one row per host and per host edge by partial aggregation before anything is shuffled; ranks live in written
tables, one per round; rounds stop when no rank moves by ``TOLERANCE``. They do stop: what all ranks together move shrinks by ``DAMPING`` from
round to round. Nothing grows on the driver.

Edge cases: a null url or one without ``://`` has host and path empty, fits no rule and is allowed by default; null html has
no links; repeated pages each count; rules of equal length: block before allow.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING = 0.85
TOLERANCE = 1e-4
THRESHOLD = 0.5
#: Rules in one column expression; more are joined by host suffix.
MAX_INLINE = 200


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    rule: str  # host, then a path from its first slash

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return self.rule[len(self.host) :]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _ordered(rules: list[UrlRule]) -> list[UrlRule]:
    return sorted(rules, key=lambda r: (-len(r.rule), r.verdict != "block", r.rule))


def _inline(rules: list[UrlRule], host: Column, path: Column) -> Column:
    """The first fitting rule, longest first, as struct(rule, verdict)."""
    kind = "struct<rule:string,verdict:string>"
    out = F.lit(None).cast(kind)
    for r in reversed(_ordered(rules)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def judged_by_rules(pages: DataFrame, rules: list[UrlRule], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, ruled): rule and its verdict are null where none fits."""
    slim = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if len(rules) <= MAX_INLINE:
        return slim.withColumn("_r", _inline(rules, F.col("host"), F.col("path"))).select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("ruled"))
    spark = pages.sparkSession
    listed = spark.createDataFrame([(r.host, r.path, r.rule, r.verdict, -len(r.rule), r.verdict != "block") for r in rules], "h string, p string, rule string, verdict string, o1 int, o2 boolean")
    keyed = materialize(slim.withColumn("row", F.monotonically_increasing_id()), "pages")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fits = keyed.select("row", "path", F.explode(suffixes).alias("h")).join(listed, "h").where(F.startswith("path", "p"))
    best = fits.groupBy("row").agg(F.min(F.struct("o1", "o2", "rule", "verdict")).alias("b"))
    return keyed.join(best, "row", "left").select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.col("b.verdict").alias("ruled"))


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, counted."""
    found = F.explode(F.regexp_extract_all(F.col(html), F.lit(r"""(?i)href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^\s"'<>]+)"""), F.lit(1)))
    each = pages.where(F.col(html).contains("//")).select(host_of(F.col(url)).alias("src"), found.alias("link"))
    full = F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))
    return each.select("src", host_of(full).alias("dst")).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, rounds: int | None = None) -> DataFrame:
    """Personalised PageRank: (host, mass) for ``edges`` (src, dst, n) and ``seeds`` (host, seed).

    A node without outgoing edges keeps the mass that reaches it, so without edges the seeds are the fixed point. ``rounds``: exactly so many.
    """
    return _ranks(edges, seeds, damping, tolerance, rounds).select("host", "mass")


def _ranks(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, rounds: int | None = None) -> DataFrame:
    """(host, mass, come, all_come): ``come`` is what reaches a host from others, ``all_come`` the same if each host had seed 1."""
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    shares = materialize(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("p")), "shares")
    nodes = seeds.select("host", "seed").unionByName(shares.select(F.col("src").alias("host"), F.lit(0.0).alias("seed"))).unionByName(shares.select(F.col("dst").alias("host"), F.lit(0.0).alias("seed")))
    nodes = nodes.groupBy("host").agg(F.sum("seed").alias("seed"))
    zero, one = F.lit(0.0), F.lit(1.0)
    nodes = nodes.join(out.select(F.col("src").alias("host"), F.lit(True).alias("gives")), "host", "left")
    nodes = materialize(nodes.select("host", "seed", F.coalesce("gives", F.lit(False)).alias("gives"), F.col("seed").alias("mass"), one.alias("all_mass"), zero.alias("come"), zero.alias("all_come")), "nodes")
    for _ in range(rounds) if rounds else count():
        given = shares.join(nodes.select(F.col("host").alias("src"), "mass", "all_mass"), "src")
        sent = given.groupBy("dst").agg(F.sum(F.col("mass") * F.col("p")).alias("got"), F.sum(F.col("all_mass") * F.col("p")).alias("all_got"))
        moved = nodes.join(sent.withColumnRenamed("dst", "host"), "host", "left")
        kept = lambda c: F.when(F.col("gives"), zero).otherwise(F.col(c))
        come, all_come = (damping * (F.coalesce(g, zero) + kept(c)) for g, c in (("got", "come"), ("all_got", "all_come")))
        new = (1 - damping) * F.col("seed") + damping * (F.coalesce("got", zero) + kept("mass"))
        new_all = (1 - damping) + damping * (F.coalesce("all_got", zero) + kept("all_mass"))
        step = F.greatest(F.abs(new - F.col("mass")), F.abs(new_all - F.col("all_mass")))
        nodes = materialize(moved.select("host", "seed", "gives", new.alias("mass"), new_all.alias("all_mass"), come.alias("come"), all_come.alias("all_come"), step.alias("step")), "ranks")
        # Both masses have gone the same rounds, so their ratio is a weighted mean of seeds at any round.
        if rounds is None and (nodes.agg(F.max("step")).first()[0] or 0.0) < tolerance:
            break
        nodes = nodes.drop("step")
    return nodes.select("host", "mass", "come", "all_come")


def _arriving(edges: DataFrame, seeds: DataFrame, name: str) -> DataFrame:
    """(host, name): the larger of a host's own seed and the share of the mass arriving from others that comes from seeds."""
    ranks = _ranks(edges, seeds)
    share = F.when(F.col("all_come") > 0, F.col("come") / F.col("all_come")).otherwise(F.lit(0.0))
    return seeds.join(ranks, "host", "left").select("host", F.greatest("seed", F.coalesce(share, F.lit(0.0))).alias(name))


def judge(pages: DataFrame, rules: list[UrlRule], page_id: str = "page_id", url: str = "url", html: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page."""
    judged = materialize(judged_by_rules(pages, rules, page_id, url), "judged")
    share = lambda v: F.avg(F.coalesce(F.col("ruled") == v, F.lit(False)).cast("int"))
    hosts = materialize(judged.groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")), "hosts")
    edges = materialize(host_links(pages, url, html), "links")
    trust = _arriving(edges, hosts.select("host", F.col("allowed").alias("seed")), "trust")
    distrust = _arriving(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), hosts.select("host", F.col("blocked").alias("seed")), "distrust")
    ranked = materialize(hosts.select("host").join(trust, "host", "left").join(distrust, "host", "left"), "host-ranks")
    whole = judged.join(ranked, "host", "left")
    bad = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust")) & (F.col("host") != "")
    verdict = F.coalesce("ruled", F.when(bad, F.lit("block")).otherwise(F.lit("allow")))
    return whole.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
