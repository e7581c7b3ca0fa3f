"""URL expressions of the crawl and of the audits. Native columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicons import EXCLUDED_TOKENS, GENERAL_KIND, NON_HTML_EXTENSIONS, PAGE_KINDS, RELEVANT_TOKENS
from .text import let, normalized, plain

_WHOLE = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
TRACKING = ("utm_", "fbclid", "gclid")
ATTRIBUTION = ("oppref", "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term")


def part(url: Column, k: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query; empty where absent."""
    return F.regexp_extract(url, _WHOLE, k)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    """Lower-case host without user and port; empty where there is none."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), "^.*@", ""), r":\d*$", ""))


def path(url: Column) -> Column:
    return part(url, 3)


def normalize(url: Column) -> Column:
    """One spelling of a URL: default scheme, lower-case host, no default port, user, parameters, fragment or tracking."""
    full = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))
    name, port = host(full), F.regexp_extract(part(full, 2), r":(\d+)$", 1)
    default = ((scheme(full) == "https") & (port == "443")) | ((scheme(full) == "http") & (port == "80")) | (port == "")
    bare = F.regexp_replace(part(full, 3), ";[^/]*$", "")
    clean = F.when(bare.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(bare, "/+$", ""))
    pairs = F.filter(F.split(part(full, 4), "&"), lambda p: p.rlike("^[^=]*=.+$"))
    key = lambda p: F.lower(decoded(F.regexp_extract(p, "^([^=]*)=", 1)))
    kept = F.filter(pairs, lambda p: ~reduce(lambda a, b: a | b, (F.startswith(key(p), F.lit(t)) for t in TRACKING)))
    again = F.transform(kept, lambda p: F.concat(encoded(decoded(F.regexp_extract(p, "^([^=]*)=", 1))), F.lit("="), encoded(decoded(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)))))
    query = F.array_join(again, "&")
    return F.concat(scheme(full), F.lit("://"), name, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), clean, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def decoded(value: Column) -> Column:
    return F.coalesce(F.try_url_decode(value), value)


def encoded(value: Column) -> Column:
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def same_site(url: Column, origin: Column) -> Column:
    return scheme(url).isin("http", "https") & (host(url) == host(origin))


def _any_contains(text: Column, tokens: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(t)) for t in tokens))


def relevant(url: Column) -> Column:
    return _any_contains(F.lower(url), RELEVANT_TOKENS)


def excluded(url: Column) -> Column:
    return _any_contains(F.lower(path(url)), EXCLUDED_TOKENS)


def non_html(url: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.endswith(F.lower(path(url)), F.lit(t)) for t in NON_HTML_EXTENSIONS))


def home_page(url: Column) -> Column:
    """At most two slashes once the trailing ones are gone."""
    bare = F.regexp_replace(url, "/+$", "")
    return F.length(bare) - F.length(F.replace(bare, F.lit("/"), F.lit(""))) <= 2


def path_segments(url: Column) -> Column:
    return F.transform(F.filter(F.split(decoded(F.replace(path(url), F.lit("+"), F.lit("%2B"))), "/"), lambda s: s != ""), lambda s: normalized(F.replace(s, F.lit("-"), F.lit(" "))))


def page_kind(url: Column) -> Column:
    """The first kind one of whose names equals a path segment."""
    def first(segments: Column) -> Column:
        out = None
        for kind, names in PAGE_KINDS:
            hit = F.arrays_overlap(segments, F.array(*(F.lit(plain(n)) for n in names)))
            out = F.when(hit, kind) if out is None else out.when(hit, kind)
        return out.otherwise(GENERAL_KIND)

    return let(path_segments(url), first)


def path_words(url: Column) -> Column:
    return normalized(F.translate(decoded(F.replace(path(url), F.lit("+"), F.lit("%2B"))), "/-", "  "))


def offer_key(url: Column, canonical: Column) -> Column:
    """Page an offer belongs to: without fragment and trailing slashes, through the page's canonical URL, without ``.html``."""
    bare = lambda u: F.coalesce(F.nullif(F.regexp_replace(F.split(u, "#", 2)[0], "/+$", ""), F.lit("")), u)
    result = bare(F.coalesce(canonical, bare(url)))
    return F.when(F.lower(result).endswith(".html"), F.regexp_replace(result, r"(?i)\.html$", "")).otherwise(result)


def safe_public(url: Column) -> Column:
    """Whether an audit may fetch the URL: http(s), no user, no local or private host."""
    name = F.regexp_replace(host(url), r"^\[|\]$", "")
    four = name.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$")
    octet = lambda k: F.try_element_at(F.split(name, r"\."), F.lit(k)).try_cast("int")
    a, b = octet(1), octet(2)
    mapped = F.regexp_extract(name, r"^::ffff:(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    ma, mb = F.split(mapped, r"\.")[0].try_cast("int"), F.try_element_at(F.split(mapped, r"\."), F.lit(2)).try_cast("int")

    def private(x: Column, y: Column) -> Column:
        return x.isin(0, 10, 127) | ((x == 169) & (y == 254)) | ((x == 172) & y.between(16, 31)) | ((x == 192) & (y == 168)) | ((x == 100) & y.between(64, 127)) | (x >= 224)

    local = name.isin("", "localhost", "::1", "::") | name.rlike(r"\.(localhost|local|internal)$") | (F.contains(name, F.lit(":")) & name.rlike("^(fc|fd|fe80:)"))
    blocked = local | (four & F.coalesce(private(a, b), F.lit(True))) | ((mapped != "") & F.coalesce(private(ma, mb), F.lit(True)))
    return scheme(url).isin("http", "https") & ~F.contains(part(url, 2), F.lit("@")) & ~blocked


def with_scheme(value: Column) -> Column:
    """What a visitor typed, with https:// where the scheme is missing."""
    text = F.trim(F.coalesce(value, F.lit("")))
    return F.when(text == "", "").when(text.rlike(r"(?i)^https?://"), text).otherwise(F.concat(F.lit("https://"), text))


def attribution(url: Column) -> Column:
    """Map of the campaign parameters present in a URL."""
    pairs = F.filter(F.split(part(url, 4), "&"), lambda p: p.rlike("^[^=]*=.+$") & F.substring_index(p, "=", 1).isin(*ATTRIBUTION))
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), decoded(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v")))
    first = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda x: x["k"]), e["k"]) == i + 1)
    return F.map_from_entries(first)
