"""Faults found in round 4, each by a case that showed it."""

import random
from datetime import datetime

from pyspark.sql import functions as F

import __spark_entry__


def orders(spark, tmp_path, keys):
    rows = [(k, k % 7, datetime(1995, 1 + i % 12, 1 + i % 28)) for i, k in enumerate(keys)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").withColumns({"o_orderstatus": F.lit("F"), "o_orderpriority": F.lit("x"), "o_totalprice": F.lit(1.0)}).write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


def test_pages_with_the_number_of_an_index_page(spark, tmp_path, duck, same):
    """260915.html is an index page in one folder; any page whose number ends so was taken for it."""
    from minuteloom.functions import urls

    d = orders(spark, tmp_path, [260915, 1260915, 7])
    sql = __spark_entry__.oracle_sql()["html_subpages"].replace("FROM orders", f"FROM '{d}/orders.parquet/*.parquet'")
    same(__spark_entry__.queries()["html_subpages"](spark, d), duck.sql(sql))
    known = spark.createDataFrame([("https://www.fsa.go.jp/news/r8/202609/260915.html#sp_summary",), ("https://www.fsa.go.jp/news/r8/202609/1260915.html",)], "u string")
    assert [r[0] for r in known.select(urls.is_generic_index(F.col("u"), F.lit(""))).collect()] == [True, False]


def test_references_are_joined_to_a_base_that_is_read_once():
    """Addresses are those of urljoin, whatever the base and the reference."""
    from urllib.parse import urljoin

    from minuteloom.sources import links

    rng = random.Random(4)
    bits = ["a", "b.html", "/", "/", ".", "..", "//", "?q=1", "#f", ":", "http://x.go.jp/", "%20", " ", ";p", "～", "-", "_", "~", "E"]
    bases = ["https://e.go.jp/a/b.html", "https://E.go.jp", "http://e.go.jp/x//y/", "", "ftp://x/y", "https://e.go.jp/a/../b/c", "https://e.go.jp/a/b?x=/c/", "//e.go.jp/a", "/a/b", "https://e.go.jp/a;b/c", "HTTPS://e.go.jp:80/q/"]
    for base in bases:
        full_of = links.resolver(base)
        for _ in range(3000):
            href = "".join(rng.choices(bits, k=rng.randrange(1, 6)))
            assert full_of(href)[0] == urljoin(base, href).replace(" ", "%20"), (base, href)


def test_texts_that_are_in_python_get_the_normal_form_there(spark):
    """no column of a link's context goes to Python once more, and the form is that of normal_text."""
    from minuteloom.functions import text

    rng = random.Random(5)
    signs = "第１回 \u3000\t\n\xa0\u2003\u2028ｶﾞ①㈱⺠⻑が\u3099A（）ﬁ\x1c\u200b\x85 "
    said = ["".join(rng.choices(signs, k=rng.randrange(0, 160))) for _ in range(2000)] + [""]
    rows = spark.createDataFrame([(s, text.normal(s)) for s in said], "s string, mine string")
    assert rows.filter(~text.normal_text(F.col("s")).eqNullSafe(F.col("mine"))).collect() == []


def test_meetings_are_judged_where_their_page_is_read(spark):
    """rows and sections of a page are judged in the task that read it; they met in joins and were written out with all their links."""
    from minuteloom.sources import meetings

    table = "<table><tr><th>回数</th><th>開催日</th><th>資料</th></tr><tr><td>第1回</td><td>令和6年4月2日</td><td><a href='dai1/1.pdf'>資料1</a><a href='dai1/index.html'>会議</a></td></tr><tr><td>第1回</td><td>同日</td><td><a href='dai1/x.html'>議事</a><a href='dai1/2.pdf'>PDF</a></td></tr></table>"
    sections = "<h2>第3回</h2><p><a href='3.pdf'>資料</a></p><h2>第4回（令和6年5月1日）</h2><h3>報告書</h3><p><a href='r.pdf'></a></p><h2>第5回</h2><p>準備中</p>"
    pages = spark.createDataFrame([(1, "https://e.go.jp/k/", table), (2, "https://e.go.jp/s/", sections), (3, "https://e.go.jp/n/", None), (None, "https://e.go.jp/n/", table)], "page_id long, url string, html string")
    of = lambda df: sorted(((r.page_id, r.round, r.date, tuple((m.name, m.type) for m in r.materials)) for r in df.collect()), key=repr)
    rows, parts = meetings.table_meetings(pages, "2026-01-01"), meetings.section_meetings(pages, "2026-01-01")
    assert of(rows) == [(1, 1, "2024/04/02", (("資料1", "PDF"), ("第1回 同日", "PDF")))]
    assert of(parts) == [(2, 3, None, (("資料", "PDF"),)), (2, 4, "2024/05/01", (("報告書", "PDF"),))]
    for df in (rows, parts):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert "Exchange" not in parts._jdf.queryExecution().executedPlan().toString()


def test_texts_of_links_are_made_once_before_they_are_judged(spark):
    """each of many words was looked for in a text that was trimmed anew."""
    from minuteloom.sources import links

    pages = spark.createDataFrame([(1, "https://e.go.jp/a/", "<a href='dai1.html'> 第1回委員会 </a><a href='dai2.html'>1. 委員名簿</a><a href='x.PDF?a'>第3回</a><a href='x.pdf.html'>第4回</a>")], "page_id long, url string, html string")
    found = links.subpages(pages)
    assert sorted(r.url for r in found.collect()) == ["https://e.go.jp/a/dai1.html", "https://e.go.jp/a/x.pdf.html"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("trim(text#") == 1


def test_news_and_materials_go_to_python_once(spark):
    """pages are read in Python and nothing goes there again; links in frames are left out there, and texts are read up to the first day."""
    from minuteloom.sources import links

    page = "<nav><a href='n.html'>第9回委員会</a></nav><ul><li>⺠間 ３月４日 <a href='/n/1.html'>検討会（第１回）</a><li>5月6日 <a href='r.pdf'>PDF</a></ul>"
    pages = spark.createDataFrame([(1, "https://e.go.jp/a/", page)], "page_id long, url string, html string")
    news, papers = links.news_items(pages, F.lit("2001/02/01")), links.page_materials(pages)
    assert [(r.position, r.title, r.date) for r in news.collect()] == [(1, "検討会(第1回)", "2001/03/04")]
    assert [(r.position, r.name) for r in papers.collect()] == [(2, "5月6日")]
    for df in (news, papers):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "EvalPython" not in plan and plan.count("MapInArrow") == 1


def test_materials_of_a_base_that_is_no_address(spark):
    """a page whose address can't be read ended the whole job; its links are left out, and a base that can't be read counts for nothing."""
    from minuteloom.sources import links

    pages = spark.createDataFrame([(1, "http://[bad", "<base href='x/'><a href='https://e.go.jp/1.pdf'>資料1</a>"), (2, "https://e.go.jp/", "<base href='http://[bad'><a href='2 b.pdf'>資料2</a>")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.url) for r in links.page_materials(pages).collect()) == [(2, "https://e.go.jp/2 b.pdf")]
