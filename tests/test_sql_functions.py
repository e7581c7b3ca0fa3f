"""Functions called from SQL against their DataFrame forms."""

from pyspark.sql import functions as F

from sievemark import fixtures, sql
from sievemark.sources import html

SF = "/root/testdata/sf0.001"


def test_column_functions_equal_their_dataframe_form(spark):
    names = sql.register(spark)
    assert len(names) == len(sql.COLUMNS) + 2
    values = [r[0] for r in fixtures.URLS] + [r[0] for r in fixtures.PRICES] + [r[0] for r in fixtures.NUMBERS] + ["Été à 12,50 € par mois, tél +33 1 23 45 67 89, a.b@c.test", "It's \\ \"quoted\" <b>", "", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    df.createOrReplaceTempView("sql_values")
    for name, fn in sql.COLUMNS.items():
        got = [r.y for r in spark.sql(f"SELECT i, {name}(s) AS y FROM sql_values ORDER BY i").collect()]
        assert got == [r.y for r in df.select("i", fn(F.col("s")).alias("y")).orderBy("i").collect()], name
    plan = spark.sql("SELECT prices_in(s), phones_in(s) FROM sql_values")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_table_functions(spark):
    sql.register(spark)
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    pages.unionByName(fixtures.table(spark, fixtures.PAGES, "page_id bigint, url string, html string")).createOrReplaceTempView("sql_pages")
    got = spark.sql("SELECT page_id, h.title, h.text, h.headings, h.links, h.jsonld, size(h.nodes) AS n FROM sql_pages, LATERAL parse_html(url, html) h").collect()
    want = html.parse(spark.table("sql_pages"), ["page_id"]).select("page_id", "title", "text", "headings", "links", "jsonld", F.size("nodes").alias("n")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and got
    rows = spark.sql("SELECT t.s, p.minimum, p.currency FROM VALUES ('dès 1 140 € par an, 20 à 30 €'), ('none') AS t(s), LATERAL parse_prices(t.s) p ORDER BY p.minimum").collect()
    assert [(r.minimum, r.currency) for r in rows] == [(20.0, "EUR"), (1140.0, "EUR")]
