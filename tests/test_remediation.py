"""Plans for actions, and rendered readings of pages that repeat a URL."""

from pyspark.sql import functions as F

from sievemark import fixtures
from sievemark import lexicons as L
from sievemark.operators import state
from sievemark.plans import pageaudit

MAP = "map<string,array<struct<label:string,excerpt:string>>>"


def brute(action, audit, meta):
    title, reason = (action[1] or "").strip(), (action[2] or "").strip()
    evidence = {} if audit is None or audit[1] is None else audit[1]
    items = [x for v in evidence.values() for x in v or [] if x[0] or x[1]]
    words = title.lower().split()[:3] or [""]
    relevant = [x for x in items if any(w in f"{x[0] or ''} {x[1] or ''}".lower() for w in words)]
    affected = [d for d in state.DIMENSIONS if not evidence.get(d) or (d == "buyability" and "OBSERVED" not in ((audit and audit[2]) or ""))]
    template = next((r[0] for r in L.REMEDIATIONS if r[0] == meta[0]), None) or next((r[0] for r in L.REMEDIATIONS if r[1] == meta[1]), "unknown")
    return template, relevant, affected, template == "unknown" or not reason


def test_remediation_plan(spark):
    actions = [(1, *a) for a in fixtures.ACTIONS] + [(2, " State  the price now ", " ", None, None), (3, "Nothing fits", "r", None, None), (4, None, None, None, None), (2, "x", "r", "odd", "booking_path"), (5, "a.b (c", "r", None, None)]
    audits = [(1, {"visibility": [("Title", "Make it")], "understanding": [], "buyability": [("", "Price 5"), ("", "")]}, "OBSERVED"), (2, {"visibility": [("price", None)], "acquisition": [(None, "state of things")]}, None), (4, None, "OBSERVED"), (5, {"visibility": [("x", "A.B")], "buyability": [("(c", "")]}, "NOT")]
    a = spark.createDataFrame(actions, "audit_id int, title string, reason string, action_id string, category string")
    got = state.remediation_plan(a, spark.createDataFrame(audits, f"audit_id int, evidence {MAP}, conversion string")).collect()
    known = {x[0]: x for x in audits}
    assert len(got) == len(actions)
    for r in got:
        want = brute((r.audit_id, r.title, r.reason), known.get(r.audit_id), (r.meta_action, r.meta_category))
        assert (r.template, sorted(map(repr, (tuple(x) for x in r.relevant))), list(r.affected), r.insufficient) == (want[0], sorted(map(repr, (tuple(x) for x in want[1]))), want[2], want[3])
        assert r.located == bool(want[1])


def test_rendered_readings_do_not_multiply(spark):
    page = next(r for r in fixtures.PAGES if r[0] == 900001)
    thin = "<html><body><div id='root'></div><script src='a.js'></script></body></html>"
    pages = spark.createDataFrame([(1, "https://a.test/", thin), (2, "https://a.test/", thin), (3, "https://b.test/", thin)], "page_id bigint, url string, html string")
    rendered = spark.createDataFrame([(k, "https://a.test/", page[2]) for k in (1, 2)], "page_id bigint, url string, html string")
    out = pageaudit.with_rendered(pageaudit.inspect(pages), pageaudit.inspect(rendered, method="rendered"))
    assert out.count() == 3 and {r.url: r.n for r in out.groupBy("url").agg(F.count("*").alias("n")).collect()} == {"https://a.test/": 2, "https://b.test/": 1}


def test_plans_audit_each_page_once(spark):
    """Once audited, pages aren't read again, and audits aren't sent whole to the driver."""
    from sievemark.catalog.state import remediation_plans

    plan = remediation_plans(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan and "Broadcast" not in plan
