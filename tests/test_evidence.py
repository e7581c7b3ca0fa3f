"""Proofs of rules reach issues and reports."""

from pyspark.sql import functions as F

from sievemark.catalog import branches
from sievemark.operators import rules
from sievemark.sources import web

EVIDENCE = "array<struct<url:string,kind:string,excerpt:string,selector:string>>"


def test_proofs_reach_issues_and_report(spark):
    proof = lambda u: [(u, "visible_text", f"<{u}>", None)]
    facts = spark.createDataFrame([("s", "pricing", "conflicting", proof("a") * 12), ("s", "payment", "conflicting", proof("b") * 3), ("s", "address", "unknown", proof("c")), ("s", "returns", "known", proof("r"))], f"site_id string, field string, state string, evidence {EVIDENCE}")
    offers = spark.createDataFrame([("s", k, proof(f"o{k}")) for k in range(30, 0, -1)] + [("s", 0, [])], f"site_id string, rank int, evidence {EVIDENCE}")
    rows = [("s", k, r, f, st, 0.0, 10, p) for k, (r, f, st, p) in enumerate([("UNDR.OFFERS.003", "understanding", "partial", rules.OFFERS), ("UNDR.CONSISTENCY.007", "understanding", "partial", rules.CONFLICTS), ("BUY.PAYMENT.005", "buyability", "partial", "payment"), ("DISC.META.007", "ai_discoverability", "fail", None), ("BUY.AREA.004", "buyability", "fail", "address")])]
    results = rules.with_evidence(spark.createDataFrame(rows, "site_id string, ord int, rule_id string, score string, status string, points_awarded double, points_possible int, proof string"), facts, offers)
    got = {r.rule_id: [e.url for e in r.evidence] for r in results.collect()}
    assert got["UNDR.OFFERS.003"] == [f"o{k}" for k in range(1, 11)] and got["BUY.PAYMENT.005"] == ["b"] * 3 and got["DISC.META.007"] == got["BUY.AREA.004"] == []
    order = sorted(("pricing", "payment"), key=lambda f: __import__("sievemark.lexicons", fromlist=["FACT_FIELDS"]).FACT_FIELDS.index(f))
    assert got["UNDR.CONSISTENCY.007"] == (["a"] * 10 if order[0] == "pricing" else ["b"] * 3 + ["a"] * 7)
    issues = rules.recommendations(spark, results).withColumn("contradiction", F.lit(None).cast("string"))
    none = spark.createDataFrame([], f"site_id string, url string, evidence {EVIDENCE}")
    final = {r.rule_id: [e.url for e in r.evidence] for r in rules.final_issues(issues, none).collect()}
    assert final and all(final[r] == got[r] for r in final)
    scores = spark.createDataFrame([("s", 1, 2, 3, 4)], "site_id string, ai_readiness int, ai_discoverability int, understanding int, buyability int")
    page = web.report_html(scores, rules.final_issues(issues, none), results=results).first().html
    assert "o1: &lt;o1&gt;" in page and "<th>Proof</th>" in page


def test_every_branch_is_met(spark):
    seen = {(r.rule_id, r.status) for r in branches.rule_branches(spark, "/root/testdata/sf0.01").select("rule_id", "status").distinct().collect()}
    assert len({r for r, _ in seen}) == 21 and len(seen) >= 55
