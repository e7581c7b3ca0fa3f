"""The audit engine: golden values, parser rules, and each registered query against its SQL twin on the smallest tables."""

import datetime
import glob
import os

import pytest
from pyspark.sql import functions as F

from sievemark import catalog, fixtures
from sievemark.catalog import state as state_catalog
from sievemark.functions import money, text, urls
from sievemark.operators import state
from sievemark.plans import pageaudit
from sievemark.sources import html, web
from sievemark.streaming import stateful

SF = "/root/testdata/sf0.001"
#: Long on small machines; each has a part tested on its own or a run in the driver's comparison.
SLOW = {"site_audit_signals", "facts_long", "offer_extraction", "crawl_pages", "crawl_reach", "crawl_coverage"}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLES) - SLOW))
def test_query_equals_its_sql_twin(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cur = duck.execute(catalog.ORACLES[name])
    columns = sorted(c[0] for c in cur.description)
    assert columns == sorted(df.columns)
    place = {c[0]: k for k, c in enumerate(cur.description)}
    want = sorted(repr(tuple(plain(r[place[c]]) for c in columns)) for r in cur.fetchall())
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert got == want and got


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - SLOW))
def test_other_queries_have_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_golden_scores(spark):
    got = {r.page_id: r for r in pageaudit.inspect(fixtures.table(spark, fixtures.PAGES, "page_id bigint, url string, html string")).collect()}
    assert got[900001].buyability == 90 and got[900001].journey == "purchase"
    assert got[900002].buyability == 85 and got[900002].acquisition == "full"
    assert got[900004].buyability is None and got[900004].status == "limited" and got[900005].hard_limited
    assert got[900007].status == "blocked" and set(got[900007].capabilities.values()) == {"INSUFFICIENT_EVIDENCE"}
    assert "State availability or timing" in [a.title for a in got[900003].next_actions]


def test_audit_plan_has_neither_shuffle_nor_python(spark):
    plan = pageaudit.inspect(spark.read.parquet(f"{SF}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "ReadSchema" in plan


def test_parser_rules():
    row = html.parse_one("https://a.test/x/", """<html><head><title> A &amp; B </title><meta name=description content=" d "><meta name="og:description" content="e">
      <meta name="robots" content="NoIndex, follow"><link rel="canonical" href="/c"></head><body>before<h1 id=h>One</h1><p>t1 <script>hid()</script></p></section><h2></h2>
      <h2>Two</h2><a href="../y" aria-label="Go">See</a><button title="T">B</button><form action="/f"></form><input value="V"><svg>no</svg>end
      <script type="application/ld+json">[{"@graph":[{"@type":"X"}]},{"@type":["Y","Z"],"a":{"@type":"W"}}]</script><script type="application/ld+json">{bad</script></body>""")
    assert row["title"] == "A & B" and row["description"] == "d" and row["robots"] == ["noindex", "follow"] and row["canonical"] == "https://a.test/c"
    assert row["headings"] == ["One", "Two"] and [b["heading"] for b in row["blocks"]] == ["One", "Two"] and "before" not in row["blocks"][0]["text"]
    assert row["links"] == ["https://a.test/y"] and row["actions"] == ["Go", "See", "T", "B", "https://a.test/f", "V"] and "hid" not in row["text"] and "no" not in row["text"].split()
    assert [n["types"] for n in row["nodes"]] == [["X"], ["Y", "Z"], ["W"]] and row["blocks"][1]["ancestors"][-1]["tag"] == "h2"
    assert html.parse_one(None, None)["text"] == ""


def test_money_and_urls(spark):
    one = spark.range(1)
    assert one.select(money.number(F.lit("1.140,50"))).first()[0] == 1140.5
    got = one.select(money.prices(F.lit("dès 1 140 € par an, 20 à 30 €, budget 5 USD"))).first()[0]
    assert [(p.minimum, p.maximum, p.currency, p.qualifier, p.frequency) for p in got] == [(1140, None, "EUR", "from", "yearly"), (20, 30, "EUR", None, None), (5, None, "USD", None, None)]
    assert one.select(urls.normalize(F.lit("a.test/x/?utm_a=1&k=v w"))).first()[0] == "https://a.test/x?k=v+w"
    assert one.select(text.normalized(F.lit("  Ça-va? STRAßE_1 "))).first()[0] == "ca va strasse_1" == text.plain("  Ça-va? STRAßE_1 ")
    assert one.select(text.normalized(F.lit(None).cast("string"))).first()[0] is None


def test_data_source_and_report(spark):
    rows = {"https://a.test/": (200, "text/html", b"<h1>x</h1>", "https://a.test/")}
    got = web.fetch_pages(spark.createDataFrame([("https://a.test/",), ("https://b.test/",)], "url string"), lambda u: rows[u] if u in rows else (_ for _ in ()).throw(OSError("down"))).collect()
    assert {(r.url, r.status, r.fetch_error is None) for r in got} == {("https://a.test/", 200, True), ("https://b.test/", 0, False)}
    scores = spark.createDataFrame([("a<b", 1, 2, 3, 4)], "site_id string, ai_readiness int, ai_discoverability int, understanding int, buyability int")
    issues = spark.createDataFrame([("a<b", "R", "x & y", 5, "high")], "site_id string, rule_id string, title string, impact int, priority string")
    page = web.report_html(scores, issues).first().html
    assert "a&lt;b" in page and "x &amp; y" in page


def run_stream(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streaming_equals_batch(spark, tmp_path):
    history = fixtures.table(spark, fixtures.HISTORY, state_catalog.HISTORY_SCHEMA).withColumn("at", F.to_timestamp("at"))
    # A row far ahead lets the watermark pass all others.
    end = history.limit(1).withColumn("session", F.lit("~")).withColumn("at", F.to_timestamp(F.lit("2100-01-01 00:00:00")))
    history.unionByName(end).coalesce(1).write.parquet(str(tmp_path / "h"))
    live = run_stream(stateful.monitoring(spark.readStream.schema(history.schema).parquet(str(tmp_path / "h")).withWatermark("at", "1 hour")), "slots", "append").where("session <> '~'")
    key = lambda r: repr((r.session, r.at, r.eligible, r.previous_score, r.delta, r.alert))
    assert sorted(map(key, live.collect())) == sorted(map(key, state.monitoring(history).collect()))
    events = fixtures.table(spark, fixtures.EVENTS, state_catalog.EVENT_SCHEMA).withColumn("at", F.timestamp_seconds(F.col("ord") + 1_700_000_000))
    end = events.limit(1).withColumn("subscription", F.lit("~")).withColumn("at", F.to_timestamp(F.lit("2100-01-01 00:00:00")))
    state.deduplicated(events).unionByName(end).coalesce(1).write.parquet(str(tmp_path / "e"))
    live = run_stream(stateful.subscription_states(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")).withWatermark("at", "1 hour")), "subs", "update").where("subscription <> '~'")
    last = {r.subscription: (r.status, r.customer, r.lead_id) for r in sorted(live.collect(), key=lambda r: r.place)}
    assert last == {r.subscription: (r.status, r.customer, r.lead_id) for r in state.subscription_states(events).collect()}


def test_streaming_dedup(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.unionByName(e.where("event_id % 3 = 0")).coalesce(1).write.parquet(str(tmp_path / "d"))
    live = run_stream(stateful.deduplicated(spark.readStream.schema(e.schema).parquet(str(tmp_path / "d")), delay="60 days"), "once", "append")
    assert live.count() == e.count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_streaming_upsert_and_windows(spark, tmp_path):
    leads = spark.createDataFrame([(k, f"k{k % 5}", k * 10) for k in range(20)], "ord int, key string, value int")
    for part in range(2):
        leads.where(f"ord div 10 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(leads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.writeStream.foreachBatch(stateful.upsert_into(str(tmp_path / "log"), ("key",), "ord")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, stateful.current(spark, str(tmp_path / "log"), ("key",), "ord").select("ord", "key", "value").collect()))
    assert got == sorted(map(tuple, state.upserted(leads, ("key",)).collect()))
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    live = run_stream(stateful.windowed_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")), delay="0 seconds"), "windows", "append")
    whole = {(r.window.start, r.event_type): r.n for r in e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).collect()}
    seen = {(r.window.start, r.event_type): r.n for r in live.collect()}
    assert seen and all(whole[k] == n for k, n in seen.items())


def test_recheck_of_null_and_equal_titles(spark):
    first = spark.createDataFrame([(1, None, "pricing", None), (1, "Same", "booking", None), (1, "Same", "cta", None)], "audit_id int, title string, action_id string, category string")
    audits = spark.createDataFrame([(1, "complete", "full", "meaningful")], "audit_id int, status string, acquisition string, score_status string")
    after = spark.createDataFrame([(1, "x", "pricing", None), (1, "y", "cta", None)], "audit_id int, title string, action_id string, category string")
    got = state.recheck(first, audits, after).collect()
    assert sorted((r.title or "", r.state) for r in got) == [("", "STILL_DETECTED"), ("Same", "RESOLVED"), ("Same", "STILL_DETECTED")]


def test_summary_of_a_page_audit(spark):
    got = web.summary(pageaudit.inspect(fixtures.table(spark, fixtures.PAGES, "page_id bigint, url string, html string"))).collect()
    assert len(got) == len(fixtures.PAGES) and set(got[0].asDict()) == {"url", "status", "acquisition", "visibility", "understanding", "buyability", "observed_readiness", "next_actions"}


def test_evidence_groups(spark):
    got = {r.page_id: r.evidence for r in pageaudit.inspect(fixtures.table(spark, fixtures.PAGES, "page_id bigint, url string, html string")).select("page_id", "evidence").collect()}
    labels = lambda page, group: [x.label for x in got[page][group]]
    assert labels(900001, "visibility")[:3] == ["page", "title", "description"] and "price" in labels(900001, "understanding") and "action" in labels(900001, "buyability")
    assert [x.excerpt for x in got[900007].acquisition] == ["challenge_page"] and not got[900007].visibility and [x.excerpt for x in got[900005].acquisition] == ["javascript_required"]
    assert {x.excerpt for x in got[900004].acquisition} <= {"thin_text", "script_shell"} and got[900004].acquisition and not got[900001].acquisition
