from datetime import date

from pyspark.sql import functions as F

from minuteloom import schema
from minuteloom.functions import dates, text, urls
from minuteloom.operators import merge, portal, quality
from minuteloom.sources import documents, html, meetings
from minuteloom.streaming import crawl

DATE_TEXTS = ["令和6年4月1日", "令和元年5月1日", "平成30年11月28日", "2024年12月3日", "2024/2/29", "R3.12.6", "H30.11.28", "08.8.13", "18.3.7", "令和６年１０月１５日", "令和元年11年15日", "4月 2026年4月13～17日", "2026年2月30日", "なし"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_era_dates(spark):
    want = [date(2024, 4, 1), date(2019, 5, 1), date(2018, 11, 28), date(2024, 12, 3), date(2024, 2, 29), date(2021, 12, 6), date(2018, 11, 28), date(2026, 8, 13), date(2006, 3, 7), date(2024, 10, 15), date(2019, 11, 15), date(2026, 4, 13), None, None]
    rows = spark.createDataFrame(list(enumerate(DATE_TEXTS)), "i int, t string").select("i", dates.parse_era_date(F.col("t")).alias("d")).orderBy("i").collect()
    assert [r.d for r in rows] == want


def test_date_ranges(spark):
    ref = "2026-09-16 00:00:00"
    pairs = [("2026/09/12", "7D", True), ("2026/09/01", "7D", False), ("2026/09/01", "30D", True), ("2026/08/01", "30D", False), ("2025/10/01", "PAST_YEAR", True), ("2025/08/01", "PAST_YEAR", False), ("2026/05/01", "YEAR", True), ("2025/05/01", "YEAR", False), ("2025/05/01", "PREV_YEAR", True), ("2026/05/01", "PREV_YEAR", False), ("-", "7D", False), ("", "7D", False), ("2026/09/20", "7D", False), ("-", "ALL", True)]
    for value, code, want in pairs:
        assert one(spark, dates.in_range(dates.date_of(F.lit(value)), code, ref)) is want, (value, code)


def test_search_text(spark):
    for raw, want in [("ＡＩ推進", "ai推進"), ("ＷＧ", "wg"), ("第１回", "第1回"), ("⼈⼯知能", "人工知能"), ("１２⽉２７⽇", "12月27日"), (None, "")]:
        assert one(spark, text.search_text(F.lit(raw).cast("string"))) == want
    assert one(spark, text.normal_text(F.lit(" ⻑ 　官\n"))) == "長 官"
    assert text.terms("Ａ　b  c") == ["a", "b", "c"]


def test_small_text_functions(spark):
    assert one(spark, text.csv_field(F.lit("=1+1"))) == "'=1+1"
    assert one(spark, text.capitalize(F.lit("hello"))) == "Hello"
    assert one(spark, text.bigrams(F.lit("第3回 会議体"))) == ["会議", "議体"]
    assert one(spark, text.bigrams(F.lit("会"))) == ["会"]
    assert one(spark, text.sessions(F.lit("第１０回 dai3"))) == [10, 3]
    assert one(spark, text.escape_html(F.lit('<a href="x">&'))) == "&lt;a href=&quot;x&quot;&gt;&amp;"


def test_urls(spark):
    u = "http://WWW.Example.go.jp/a/index.html?b=2&a=1#x"
    assert one(spark, urls.canonical_url(F.lit(u))) == "https://www.example.go.jp/a?a=1&b=2"
    assert one(spark, urls.clean_key(F.lit("https://WWW.e.jp/a/"))) == "www.e.jp/a"
    assert one(spark, urls.plain_url(F.lit("https://e.jp/a/?q=1"))) == "https://e.jp/a"
    assert one(spark, urls.safe_url(F.lit("java\x00script:alert(1)"))) == "#"
    assert one(spark, urls.numbers(F.lit("https://e.jp/2026/04/dai3"))) == [2026, 4, 3]
    assert one(spark, dates.date_from_url(F.lit("https://e.jp/r060401/"))) == date(2024, 4, 1)


def test_breaker_and_diff(spark):
    before = spark.createDataFrame([("a", 2), ("b", 1)], "id string, n int")
    after = spark.createDataFrame([("a", 5), ("c", 4)], "id string, n int")
    rows = {r.id: (r.change, r.added) for r in merge.snapshot_diff(before, after, "id", "n").collect()}
    assert rows == {"a": ("kept", 3), "b": ("removed", 0), "c": ("new", 4)}
    assert merge.breaker(5, 100, 90, 100, 20) == ["ministries_failed", "shrunk", "blocked"] and merge.breaker(4, 100, 96, 100, 19) == []


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, s string")
    new = spark.createDataFrame([(2, "B", None), (3, "c", "z")], "k int, v string, s string")
    once = merge.upsert(old, new, ["k"], keep_old=("s",))
    assert sorted(map(tuple, once.collect())) == [(1, "a", "x"), (2, "B", "y"), (3, "c", "z")]
    assert sorted(map(tuple, merge.upsert(once, new, ["k"], keep_old=("s",)).collect())) == sorted(map(tuple, once.collect()))


def test_html(spark):
    page = """<html><head><base href="https://e.go.jp/x/"><title>t</title></head><body><nav><a href="/n.pdf">n</a></nav><h2>第2回 会議</h2><a href="a.pdf">資料1</a><a href="a.pdf">again</a><a href="#t">top</a>
    <table><tr><th>回</th></tr><tr><td>第１回</td><td>令和6年4月1日</td><td><a href="m1.html">議事録</a></td></tr><tr><td>開催案内</td></tr></table></body></html>"""
    assert [(m["url"], m["type"]) for m in html.parse_materials(page, "https://e.go.jp/i.html")] == [("https://e.go.jp/x/a.pdf", "PDF"), ("https://e.go.jp/x/m1.html", "HTML")]
    pages = spark.createDataFrame([(1, "https://e.go.jp/i.html", page), (2, "https://e.go.jp/", None)], "page_id long, url string, html string")
    assert html.materials_of(pages).count() == 2
    found = meetings.meetings_of(pages, "2026-01-01").collect()
    assert [(r.page_id, r.round, r.date, [m.url for m in r.materials]) for r in found] == [(1, 1, "2024/04/01", ["https://e.go.jp/x/m1.html"])]
    assert [(r.round, r.date, [m.name for m in r.materials]) for r in meetings.section_meetings(pages, "2026-01-01").collect()] == [(2, None, ["議事録"])]  # a link beside the heading is in no element of its own
    assert html.decode("会議".encode("cp932")) == "会議" and html.decode("会議".encode("euc-jp"), "euc-jp") == "会議"
    assert html.parse_text_minutes("第3回\n24/5/1") == {"date_text": "2024/5/1", "round": 3}


def test_store(spark, tmp_path):
    documents.init_store(spark, str(tmp_path / "db"))
    assert spark.read.parquet(str(tmp_path / "db/councils")).columns == [f.name for f in schema.COUNCILS]
    rows = spark.createDataFrame([("m1", "2026/04/01"), ("m2", "2020/04/01"), ("m3", "-"), ("m4", "2099/01/01")], "id string, date string")
    documents.export(rows, str(tmp_path / "out"), "2026-09-16")
    back = {r.id: r.segment for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert back == {"m1": "active", "m2": "archive", "m3": "archive", "m4": "active"}
    for v in ("v1", "v2", "v3"):
        documents.save_versioned(rows.limit(int(v[1])), str(tmp_path / "versions"), v, keep=2)
    assert documents.versions(spark, str(tmp_path / "versions")) == ["v3", "v2"]
    assert documents.rollback(spark, str(tmp_path / "versions")).count() == 2
    assert documents.evolve(rows.withColumn("odd", F.lit(1)), schema.MEETINGS).columns == [f.name for f in schema.MEETINGS]
    assert one(spark, documents.tags_of(F.lit("[broken"))) in (None, [])


def test_portal_defaults(spark):
    rows = spark.createDataFrame([(1, "2026-09-10")], "council_id int, date string")
    assert portal.filter_meetings(rows, portal.PortalQuery()).count() == 1


def test_verdicts(spark):
    v = quality.crawl_verdict(*(F.lit(x) for x in (2, 0, 0, 0)), F.lit(False))
    assert one(spark, v) == "partial"
    route = quality.news_route(F.lit(True), F.lit(False), F.lit(True), F.lit(True), F.lit(False), F.lit(0), F.lit(False))
    assert one(spark, route) == "direct"


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 10:00:00", 1, "error"), ("2024-01-01 11:00:00", 1, "view"), ("2024-01-05 00:00:00", 1, "view")], "ts string, council_id long, kind string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = crawl.daily_failures(crawl.attempts_stream(spark, str(tmp_path / "in"), rows.schema))
    q = stream.writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.attempts, r.failures) for r in spark.table("daily").collect()) == [(1, 0), (2, 1)]
