"""Small constant tables: signals that a crawl may lack, as rows for Spark and as ``VALUES`` for a SQL twin."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: (page_id, url, html) of single pages with commercial signals.
PAGES = [
    (900001, "https://shop.example.test/lamp", """<!doctype html><html><head><title>Lamp shop</title><meta name="description" content="Desk lamps made by hand"></head><body><h1>Desk lamp</h1><h2>Brass desk lamp</h2><p>€ 48.50 and in stock today.</p><button>Add to cart</button><p>Shipping to every region in four days.</p><h2>Other lamps</h2><p>See the whole range of lamps for home and office, with bulbs and shades that fit every one of them.</p></body></html>"""),
    (900002, "https://atelier.example.test/services", """<!doctype html><html><head><title>Atelier Nord</title><meta content="Tables and shelves to measure" name="description"><link rel="canonical" href="https://atelier.example.test/services"></head><body><h1>Woodwork service</h1><h2>Consultation at your place</h2><p>We plan and build. From 120 € with delivery in the county. Visa welcome.</p><a href="/ask">Request a quote</a><h2>How it goes</h2><p>Tell us what you need, we answer within two days with drawings and a proposal that fits the room.</p></body></html>"""),
    (900003, "https://yoga.example.test/classes", """<html><head><title>Yoga studio</title></head><body><h1>Yoga appointments</h1><p>Calm sessions for beginners and for those who practise daily, in small groups with a teacher who knows every name and every back.</p><a href="https://yoga.example.test/book">Book an appointment</a><a href="mailto:hi@yoga.example.test">Write</a><p>Bring a mat or borrow one of ours, tea is served after each session in the garden.</p></body></html>"""),
    (900004, "https://app.example.test/", """<html><head><title>App</title><script src="/a.js"></script><script src="/b.js"></script><script src="/c.js"></script><script src="/d.js"></script><script src="/e.js"></script></head><body><div id="root"></div></body></html>"""),
    (900005, "https://js.example.test/", """<html><head><title>Wait</title></head><body><p>Please enable JavaScript to go on.</p></body></html>"""),
    (900006, "https://notes.example.test/city", """<html><head><title>City notes</title><meta name="description" content="Essays on streets and archives"></head><body><h1>Notes on the old streets</h1><h2>Latest essay</h2><p>The archive prints essays, sources and reading notes for students and for people who like to walk with a map in hand.</p><h2>About the notes</h2><p>They record the history of the quarter in open and free texts, with sources for each claim and a list of books.</p></body></html>"""),
    (900007, "https://guard.example.test/", """<html><head><title>Just a moment</title></head><body><p>Checking your browser before you proceed. Captcha follows.</p></body></html>"""),
    (900008, "https://deli.example.test/carte", """<html><head><title>Épicerie</title></head><body><h1>Épicerie fine</h1><p>Paniers à 1 250,00 EUR, disponibilité sur demande.</p><button title="Commander">OK</button></body></html>"""),
    (900009, "https://schema.example.test/x", """<html><head><title>Course</title><script type="application/ld+json">{"@type": "Course", "name": "Weaving"}</script><link rel="shortlink canonical" href="/x"></head><body><h1>Weaving</h1><form action="/inscription" id="f"></form><p>Ten evenings at the loom with all yarn included, for hands that never wove and for hands that did, every second Tuesday from autumn on until the first warm days, in a bright room by the river with good lamps.</p></body></html>"""),
    (900010, "https://blank.example.test/", ""),
]

PRICES = [
    ("9,90 €", 9.90), ("9.90 €", 9.90), ("1 140 €", 1140.0), ("1 140 €", 1140.0), ("1.140,50 €", 1140.5), ("1,140.50 €", 1140.5), ("20 à 30 €", 20.0), ("9 € / mois", 9.0),
    ("À partir de 1 140 € par an", 1140.0), ("12.50 USD", 12.5), ("Prix 1,23,4 €", None), ("from 15 £", 15.0), ("sans prix", None), ("€ 29", None),
]

NUMBERS = [
    ("9,90", 9.9), ("9.90", 9.9), ("1 140", 1140.0), ("1 140", 1140.0), ("1.140,50", 1140.5), ("1,140.50", 1140.5), ("1.140", 1140.0), ("1,140", 1140.0), ("1,23,4", None),
    ("1.2.3", None), ("12,345", 12345.0), ("1234,567", None), ("12", 12.0), ("", None), ("x", None), ("1.000.000", 1000000.0), ("1,000.000,5", None), ("0,5", 0.5),
]

URLS = [
    ("HTTP://User:pw@Example.TEST:80/Path/;v=1?b=2&utm_source=x&a=%20c&empty=#top",), ("example.test",), ("https://example.test:8443/a//",), ("https://example.test:443",),
    ("https://example.test/a/b;p/c;q?fbclid=1",), ("http://example.test/?q=a+b&gclid=3",), ("https://example.test/contact",), ("https://example.test/accounting",),
    ("https://example.test/a.PDF",), ("ftp://example.test/x",), ("https://localhost/x",), ("http://10.0.0.8/",), ("http://172.20.1.1/",), ("http://172.40.1.1/",), ("https://box.internal/",),
    ("http://192.168.1.7:8080/",), ("https://8.8.8.8/",), ("http://user@example.test/",), ("http://224.0.0.1/",), ("https://example.test/notre-blog/blog/x",), ("https://example.test/mentions-legales",),
    ("https://example.test/faq.html",), ("https://example.test/faq",), ("https://example.test/%C3%A9v%C3%A9nements/2",), ("https://example.test/projets/a",),
]

PHRASES = [
    ("devise", "devis", "quote", False), ("notre devise", "devis", "quote", False), ("demandez un devis gratuit", "devis", "quote", True),
    ("le site se réserve le droit de modifier", "réserver", "booking", False), ("réserver une table", "réserver", "booking", True),
    ("se retourner contre le vendeur", "retour", "returns", False), ("retour sous 30 jours", "retour", "returns", True), ("Retour à la page d'accueil", "retour", "returns", False),
    ("retour à la page. " + "x " * 60 + "retour gratuit", "retour", "returns", True), ("Paiement PayPal", "paypal", None, True), ("", "paypal", None, False),
]

#: site_id, page order, order in the page, field, value, confidence, url
FACTS = [
    ("s1", 1, 1, "contact_email", "Info@x.test", 0.95, "u1"), ("s1", 1, 2, "contact_email", "info@x.test", 0.9, "u1"), ("s1", 2, 1, "contact_email", "sales  @x.test", 0.8, "u2"),
    ("s1", 1, 3, "commercial_status", "open", 1.0, "u1"), ("s1", 2, 2, "commercial_status", "temporarily_closed", 1.0, "u2"), ("s1", 1, 4, "availability", "open", 1.0, "u1"),
    ("s2", 1, 1, "address", "  ", 0.7, "u3"), ("s2", 1, 2, "address", "12 rue X", 0.75, "u3"), ("s2", 1, 3, "address", "12 RUE X", 1.0, "u4"), ("s2", 1, 4, "commercial_status", "seasonal", 1.0, "u3"),
] + [("s3", 1, k, "faq", f"value {k % 15}", round(0.5 + k / 100, 2), f"u{k}") for k in range(40)]

#: offer rows: site_id, ord, name, url, offer_type, candidate_role, cta, price, price_value, availability, description, confidence
OFFERS = [
    ("s1", 1, "Réserver un cours", "https://s1.test/a", "reservation", "booking", "Réserver", None, None, None, "a", 0.6),
    ("s1", 2, "Réserver un cours", "https://s1.test/b", "reservation", "booking", "Réserver", None, None, None, "b", 0.6),
    ("s1", 3, "Réserver un cours", "https://s1.test/c", "reservation", "booking", "Réserver", "20 €", 20.0, "open", "c", 0.7),
    ("s2", 1, "Lampe Nord", "https://s2.test/lampe", "product", "product", "Acheter", "30 €", 30.0, "in_stock", "d", 0.9),
    ("s2", 2, "Lampe Nord", "https://s2.test/autre", "product", "product", "Acheter", "30 €", 30.0, None, "e", 0.8),
    ("s2", 3, "Échange & diagnostic", "https://s2.test/lampe#offer-2", "service", "commercial_offer", None, None, None, None, "f", 0.5),
    ("s2", 4, "Table Sud", "https://s2.test/table", "product", "product", None, "90 €", 90.0, None, None, 0.85),
    ("s3", 1, "Massage", "https://s3.test/soin.html", "service", "service", None, None, None, None, "g", 0.6),
    ("s3", 2, "Massage", "https://s3.test/soin/", "service", "service", None, None, None, "available", "h", 0.55),
    ("s3", 3, "Pierres chaudes", "https://s3.test/soin#offer-3", "service", "service", None, None, None, None, "i", 0.5),
]

#: label, pages analysed, discovered, page limit, headless needed, used, budget reached, offers detected, kept, readiness, non-HTML skipped
COVERAGE = [
    ("complete", 10, 10, False, 0, 0, False, 3, 3, 91, 0), ("capped", 40, 400, True, 0, 0, False, 5, 5, 80, 3), ("headless", 8, 8, False, 12, 8, True, 4, 4, 75, 0),
    ("offers", 20, 22, False, 2, 1, False, 80, 50, 66, 1), ("empty", 0, 0, False, 0, 0, False, 0, 0, 0, 0), ("half", 5, 20, False, 1, 1, False, 2, 2, 50, 0),
]

#: session, time, url, score, readiness state, may be monitored
HISTORY = [
    ("a", "2024-01-01 10:00:00", "u1", 70, "observed", True), ("a", "2024-01-02 10:00:00", "u1", 64, "observed", True), ("a", "2024-01-03 10:00:00", "u1", None, "insufficient_evidence", True),
    ("a", "2024-01-04 10:00:00", "u1", 80, "observed", True), ("a", "2024-01-05 10:00:00", "u2", 55, "observed", True), ("a", "2024-01-06 10:00:00", "u2", 55, "observed", False),
    ("b", "2024-01-01 09:00:00", "u3", 90, "observed", True), ("b", "2024-01-09 09:00:00", "u3", 95, "observed", True), ("c", "2024-02-01 00:00:00", "u4", 59, "observed", True),
]

#: ord, email, url, readiness, visibility, understanding, buyability, status
LEADS = [
    (1, "Sarah@example.test ", "https://example.test/services", "72", "80", "70", "66", "complete"), (2, "sarah@example.test", "https://example.test/services", "75", "82", "71", "70", "Complete"),
    (3, "no-at.example.test", "https://example.test/", "1", None, None, None, "limited"), (4, "x@y.test", "ftp://example.test/", None, None, None, None, "limited"),
    (5, "x@y.test", "https://z.test/", None, None, None, None, "blocked"), (6, "x@y.test", "https://z.test/", "101", None, None, None, "blocked"),
    (7, "x@y.test", "https://z.test/", "7.5", None, None, None, "blocked"), (8, "x@y.test", "http://10.0.0.8/", "5", None, None, None, "limited"), (9, "a@b.test", "https://c.test/", "5", "6", "7", "8", "done"),
    (10, None, "https://c.test/", "5", "6", "7", "8", "complete"),
]

#: ord, event id, type, subscription, customer, status, lead id
EVENTS = [
    (1, "e1", "checkout.session.completed", "sub1", "c1", None, "l1"), (2, "e2", "customer.subscription.created", "sub1", "c1", "incomplete", "l1"), (3, "e3", "invoice.paid", "sub1", "c1", None, None),
    (4, "e3", "invoice.paid", "sub1", "c1", None, None), (5, "e4", "customer.subscription.updated", "sub2", "c2", "active", "l2"), (6, "e5", "invoice.payment_failed", "sub2", "c2", "past_due", None),
    (7, "e6", "customer.subscription.deleted", "sub3", "c3", None, "l3"), (8, "e7", "customer.subscription.created", "sub3", "c3", "trialing", "l3"), (9, "e8", "invoice.paid", "sub9", "c9", None, None),
    (10, "e9", "customer.subscription.deleted", "sub1", "c1", "canceled", "l1"),
]

#: title, reason, action id, category
ACTIONS = [
    ("Make key commercial information agent-accessible", "r", None, None), ("Explain price or the quote process", "r", None, None), ("Add a clear commercial next step", "r", None, None),
    ("State availability or timing", "r", None, None), ("Make the main offer explicit", "r", None, None), ("Clarify the organization and its purpose", "", None, None),
    ("Anything", "r", "schema", None), ("Anything", "r", None, "booking_path"), ("Whatever", "r", None, "buyability"), ("Book a slot", "r", None, None),
]

#: site, from, to, order on the page; a graph with a cycle, a foreign site, excluded and non-HTML targets
LINKS = [
    ("https://g.test/", "https://g.test/a", 1), ("https://g.test/", "https://g.test/product", 2), ("https://g.test/", "https://other.test/", 3), ("https://g.test/", "https://g.test/login", 4),
    ("https://g.test/a", "https://g.test/b", 1), ("https://g.test/a", "https://g.test/", 2), ("https://g.test/b", "https://g.test/c", 1), ("https://g.test/c", "https://g.test/d", 1),
    ("https://g.test/product", "https://g.test/x.pdf", 1), ("https://g.test/product", "https://g.test/faq", 2), ("https://g.test/d", "https://g.test/e", 1),
]

ROBOTS = [
    ("g1", "User-agent: *\nDisallow: /private\nAllow: /private/open\nSitemap: https://g1.test/map.xml\nSitemap: https://g1.test/map.xml\nsitemap: https://g1.test/news.xml"),
    ("g2", "User-agent: sievemark\nDisallow: /\n"), ("g3", ""), ("g4", "Sitemap:https://g4.test/1.xml\nSitemap: 2\nSitemap: 3\nSitemap: 4\nSitemap: 5\nSitemap: 6"),
]

SITEMAPS = [
    ("https://g1.test", "https://g1.test/map.xml", '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="http://x/i"><url><loc> https://g1.test/a/ </loc><image:image><image:loc>https://g1.test/p.jpg</image:loc></image:image></url><url><loc>https://else.test/b</loc></url><url><loc>https://g1.test/c?utm_source=z</loc></url></urlset>'),
    ("https://g1.test", "https://g1.test/index.xml", "<sitemapindex><sitemap><loc>https://g1.test/map.xml</loc></sitemap><sitemap><loc>https://else.test/m.xml</loc></sitemap></sitemapindex>"),
    ("https://g1.test", "https://g1.test/broken.xml", "<urlset><url>"),
]

JSONLD = [
    (1, '{"@type":"Product","name":"Gourde","offers":{"@type":"Offer","price":"29.00","priceCurrency":"EUR","availability":"InStock"}}'),
    (2, '{"@graph":[{"@type":["Organization","Store"],"name":"Acme","address":{"streetAddress":"1 rue A","addressLocality":"Paris"}},{"@type":"FAQPage"}]}'),
    (3, '[{"@type":"Event","name":"Old","endDate":"2020-01-01"},{"@type":"Event","name":"New","startDate":"2999-01-01T10:00:00Z"}]'), (4, "{broken"), (5, '{"@type":"Course","name":"Loom","offers":[{"price":10,"priceCurrency":"USD"}]}'),
]


def table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def literal(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, list):
        return "[" + ", ".join(map(literal, value)) + "]::VARCHAR[]"
    return "'" + str(value).replace("'", "''") + "'"


def values(rows: list[tuple], schema: str) -> str:
    """The same rows as a SQL relation with the same column names and types."""
    kinds = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "array<string>": "VARCHAR[]"}
    columns = [c.split() for c in schema.split(",")]
    listed = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    names = ", ".join(f"{n}" for n, _ in columns)
    casts = ", ".join(f"{n}::{kinds[k]} AS {n}" for n, k in columns)
    return f"(SELECT {casts} FROM (VALUES {listed}) AS v({names}))"
