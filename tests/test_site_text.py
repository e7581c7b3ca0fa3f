"""The site audit's work on texts: done once, and the same as by the plain way."""

import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

from sievemark.functions import money
from sievemark.functions import text as T
from sievemark.operators import facts, offers
from sievemark.plans import siteaudit
from sievemark.sources import html

PAGES = f"page_id bigint, site_id string, url string, status int, page_ord int, {html.PARSED_DDL}"


def test_no_filter_of_the_offers_computes_texts_again(spark):
    lines = offers.page_offers(spark.createDataFrame([], PAGES))._jdf.queryExecution().optimizedPlan().toString().split("\n")
    filters = [x for x in lines if x.lstrip(" :+-").startswith("Filter")]
    assert len(filters) >= 5 and not [x for x in filters if "regexp_" in x or "translate" in x]


def test_text_is_normalised_once_for_both_searches(spark):
    lines = facts.text_candidates(spark.createDataFrame([], PAGES))._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert sum(x.count("lower(text#") for x in lines if "translate(" in x and "AS n#" in x) == 1
    assert not [x for x in lines if "concat_ws( , text#" in x]


def test_normalised_texts_equal_the_plain_way(spark):
    rng = random.Random(4)
    signs = "aZé ß́İǄ_9٣,-\t\n 😀Ωσς中ﬁ\u0000" + " " * 6
    rows = [("".join(rng.choices(signs, k=rng.randrange(40))), i) for i in range(2000)] + [("", -1), (None, -2), (" a", -3), ("a  b - c", -4)]
    source, target = T._fold_table()
    folded = F.translate(F.regexp_replace(F.replace(F.lower("t"), F.lit("ß"), F.lit("ss")), "[̀-ͯ]", ""), source, target)
    df = spark.createDataFrame(rows, "t string, i int")
    assert df.where(~T.normalized(F.col("t")).eqNullSafe(F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}_]+", " ")))).count() == 0


def test_what_is_found_doesnt_hang_on_the_cheap_test(spark):
    texts = ["mail a@b.test or +33 1 22 33 44 55", "12-34-56-78", "dès 5 eur", "9 uſd", "5 £ par mois", "no sign 5", "€", "a@b", "1 2 3", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(0))
    assert df.where(~T.emails(F.col("t")).eqNullSafe(whole(T.EMAIL_RE))).count() == 0
    assert df.where(~F.size(money.prices(F.col("t"))).eqNullSafe(F.size(whole(money.PRICE)))).count() == 0
    assert df.where(~F.size(T.all_of(F.col("t"), T.PHONE_RE, F.col("t").rlike(r"\d\d"))).eqNullSafe(F.size(whole(T.PHONE_RE)))).count() == 0
    assert [r[0] for r in df.select(F.size(money.prices(F.col("t")))).collect()][2:5] == [1, 1, 1]


def test_plain_links_are_joined_as_others():
    for base in ("https://a.b/c/d?x#y", "HTTP://A.b", "", "mailto:x@y", "//h/p", "http://[bad/", "x/y", "http://h:80/."):
        for link in ("/a", "/a,b", "/ä-b", "/a.b", "/a/b", "//a", "/", "/a;b", "/a:b", "/..", "/a b"):
            try:
                wanted = urljoin(base, link)
            except ValueError:
                wanted = link
            assert html.parse_one(base, f"<a href='{link}'>x</a>")["links"] == [wanted]


def test_pages_are_written_in_files_that_spread(spark, monkeypatch):
    monkeypatch.setattr(siteaudit, "FILE_PAGES", 8)
    pages = spark.createDataFrame([(k, f"https://s.test/{k}", f"<title>t</title><p>word {k}") for k in range(50)], "page_id bigint, url string, html string")
    audit = siteaudit.audit(siteaudit.parsed_pages(pages))
    assert len(audit.pages.inputFiles()) >= 7 and audit.pages.count() == 50
