"""Findings of round 3."""

from pyspark.sql import functions as F

import __spark_entry__
from minuteloom.batches import spread
from minuteloom.functions import text
from minuteloom.plans import forms


def test_sizes_of_label_forms_end_at_mb(spark, tmp_path, duck):
    """keys from 3,030 on give sizes of over 1 GB, which the query tells in MB."""
    spark.sql("SELECT id * 1500 AS s_suppkey, concat('Supplier#', id) AS s_name FROM range(1, 6)").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {r.k: r.size for r in forms.label_forms(spark, str(tmp_path)).collect()}
    sql = __spark_entry__.oracle_sql()["label_forms"].replace("FROM supplier", f"FROM '{tmp_path}/supplier.parquet/*.parquet'")
    assert got == {r[0]: r[1] for r in duck.sql(f"SELECT k, size FROM ({sql})").fetchall()}
    assert got[7500] == "6276.37 MB"
    assert spark.range(1).select(text.bytes_label(text.F.lit(7500 * 7500 * 117))).first()[0] == "6.13 GB"


def test_page_titles_keep_other_references(spark, tmp_path, duck):
    """references but those of <, > and & stay as they are written, whole or cut off."""
    said = ["x token = &quot;0b96", "Ly. Onesnd and&amp", "a &amp;amp; b&lt;i&gt;", "&copy; and &#65; &x"]
    spark.createDataFrame([(i, f"https://e.go.jp/{i}", f"<title>t</title><h1>{s}</h1>") for i, s in enumerate(said)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {(r.page_id, r.title) for r in __spark_entry__.queries()["page_titles"](spark, str(tmp_path)).collect()}
    sql = __spark_entry__.oracle_sql()["page_titles"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == set(duck.sql(sql).fetchall())


def test_rows_are_spread_before_work_in_python(spark, sf_dir):
    """A file with one row group is read by one task; pages and texts are worked on by several for each core."""
    from minuteloom.plans import crawl

    assert spark.read.parquet(f"{sf_dir}/orders.parquet").rdd.getNumPartitions() == 1
    for pages in (crawl._pages(spark, sf_dir), crawl._page(spark, sf_dir, text.F.lit("<p>"))):
        assert pages.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    few = spread(spark.range(1000).coalesce(1), "id")
    assert few.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and few.count() == 1000


def test_trigrams_of_a_long_text(spark, tmp_path):
    """by places in the text, 2 million characters would take some 10^12 steps."""
    long = "".join(chr(97 + i * i % 23) if i % 1000 else "\U0001f600É" for i in range(2_000_000))
    spark.createDataFrame([(1, long), (2, "ab"), (3, "aB\U0001f600"), (4, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.trigram) for r in __spark_entry__.queries()["trigram_index"](spark, str(tmp_path)).collect()}
    assert got == {(1, long[i : i + 3].lower()) for i in range(len(long) - 2)} | {(3, "ab\U0001f600")}


def test_councils_of_many_alike_names_meet_few(spark):
    """names that differ in numbers alone share all their pairs of characters; names that are equal are one candidate."""
    from pyspark.sql import functions as F

    from minuteloom.operators import entity

    n = F.lpad(F.col("id").cast("string"), 9, "0")
    councils = spark.range(40_000).select(F.col("id").alias("council_id"), F.lit("m").alias("ministry"), F.concat(F.lit("Customer#"), F.lpad((F.col("id") % 20_000).cast("string"), 9, "0"), F.lit("成長会議")).alias("name"), F.concat(F.lit("https://e.go.jp/"), "id").alias("official_url"), (F.col("id") < 10).alias("is_closed"))
    title = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Customer#"), n, F.lit("成長会議の資料"))).otherwise(F.concat(F.lit("【Customer#"), n, F.lit("】と【成長】")))
    items = spark.range(20_000).select(F.col("id").alias("item_id"), F.lit("m").alias("ministry"), title.alias("title"), F.lit("https://e.go.jp/news/x").alias("url"))
    got = {r.item_id: (r.council_id, r.reason) for r in entity.match_councils(items, councils).collect()}
    # Of equal names the open one, then the smaller id. 成長 is in every name: those of one length tie, so the smallest open id wins.
    assert got == {k: (k + 20_000 if k < 10 else k, "TEXT_CONTAINS") if k % 2 == 0 else (10, "BRACKET_NAME") for k in range(20_000)}


def test_digest_of_all_news_is_one(spark, sf_dir, duck, same):
    """one hash of all items, in pieces, whatever their number; runs with columns have one each."""
    import hashlib

    from pyspark.sql import functions as F

    from minuteloom.operators import digest

    query = __spark_entry__.queries()["digest_hash"](spark, sf_dir)
    assert query.columns == ["n", "digest"] and query.count() == 1
    same(query, duck.sql(__spark_entry__.oracle_sql()["digest_hash"]))
    items = spark.range(30_000).select(F.format_string("N%03d", "id").alias("item_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("m"), F.col("id") % 3)).alias("run"), F.lit("m").alias("ministry"), F.lit("d").alias("date"), F.lit("t").alias("title"), F.lit("u").alias("url"), F.array(F.lit("s")).alias("similar_existing"))
    one = lambda k: f'{{"date":"d","id":"N{k:03d}","ministry":"m","similar_existing":["s"],"title":"t","url":"u"}}'
    of = lambda ks: (len(ks), hashlib.sha256(("[" + ",".join(map(one, ks)) + "]").encode()).hexdigest())
    got = {r.run: (r.n, r.digest) for r in digest.digest_hash(items.repartition(7), ["run"]).collect()}
    assert got == {f"m{k}" if k else None: of(range(k, 30_000, 3)) for k in range(3)}
    assert tuple(digest.digest_hash(items, []).first()) == of(range(30_000))
    assert tuple(digest.digest_hash(items.filter("false"), []).first()) == of([])


def test_plain_pages_are_read_by_one_pattern():
    """Pages of simple tags give the standard parser's tree, at a fraction of its time; others are left to it."""
    from minuteloom.sources import dom

    def tree(n):
        return n.tag, n.order, n.attrs, [c if isinstance(c, str) else tree(c) for c in n.children]

    def standard(html):
        b = dom._Builder()
        b.feed(html)
        b.close()
        return tree(b.root)

    plain = ["", "a &amp; b", "<!DOCTYPE html><!-- c --><p>1<P CLASS='x' hidden>2<br/><a href=u.html title=\"t\">3</a></p></div>", "<title>t</title><script>x = 1</script><ul><li>1<li>2</ul><td colspan=2>"]
    other = ["<a href=u/>", "<a href='?a=1&amp;b=2'>x</a>", "a < b", "<script>a < b</script>", "<title>a&amp;b</title>", "<a href = 'x'>", "<!-- a-b -->", "<a href='x'class='y'>", "<p", "<![CDATA[x]]>"]
    for html in plain + other:
        assert (dom._plain(html) is not None) == (html in plain), html
        assert tree(dom.parse(html)) == standard(html), html


def test_links_are_judged_where_they_are_found(spark):
    """what a page says goes along with its links; with a join, all of them met in the few tasks that their short rows made."""
    from pyspark.sql import functions as F

    from minuteloom.sources import links

    pages = spark.createDataFrame([(1, "https://e.go.jp/a/", "<p>3月4日 <a href='dai1.html'>第1回委員会</a>"), (None, "https://e.go.jp/b/", "<a href='dai2.html'>第2回委員会</a>"), (3, "http://[bad", "<a href='https://e.go.jp/x'>第3回</a>"), (4, None, None)], "page_id long, url string, html string")
    strict, news = links.subpages(pages, F.when(F.col("page_id") == 1, "dai[0-9]"), F.col("page_id") == 1), links.news_items(pages, F.lit("2001/02/01"))
    assert [tuple(r) for r in strict.select("page_id", "url").collect()] == [(1, "https://e.go.jp/a/dai1.html")]
    assert [tuple(r) for r in news.select("page_id", "date").collect()] == [(1, "2001/03/04")]
    for df in (strict, news):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_days_are_made_of_numbers(spark):
    """what is no day costs no exception, and days are those that try_to_date reads."""
    from pyspark.sql import functions as F

    from minuteloom.functions import dates

    said = [(y, m, d) for y in (None, 0, 96, 999, 1000, 1900, 2000, 2023, 2024, 9999, 10000) for m in (None, "", "0", "2", "02", "4", "12", "13", "x") for d in (None, "", "00", "1", "28", "29", "30", "31", "32")]
    rows = spark.createDataFrame(said, "y int, m string, d string")
    made, read = dates._made(F.col("y"), F.col("m"), F.col("d")), F.try_to_date(F.concat_ws("-", F.col("y").cast("string"), "m", "d"), "yyyy-M-d")
    assert rows.filter(~made.eqNullSafe(read)).collect() == []
    assert rows.filter(made.isNotNull()).count() > 0
    assert "gettimestamp" not in rows.select(dates.resolve_date(F.col("m"), F.col("d"), F.col("m")))._jdf.queryExecution().optimizedPlan().toString().lower()


def test_texts_of_links_are_judged_once(spark):
    """links of many releases say the same few things; names and texts are cleaned once each, null ones included."""
    from minuteloom.operators import discovery

    a, b = "https://a.go.jp/report/press/1.html", "https://a.go.jp/report/press/2.html"
    rows = [(a, "第3回 水循環検討会", 1, "https://a.go.jp/x/1", "水循環検討会について"), (a, "第3回 水循環検討会", 2, "https://a.go.jp/x/2", None), (b, None, 1, "https://a.go.jp/x/3", "水循環検討会について"), (b, None, 2, "https://a.go.jp/kaigi/4", "水循環検討会の開催状況")]
    found = discovery.parent_pages(spark.createDataFrame(rows, "press_url string, name string, position int, url string, text string"))
    assert {r.press_url: r.parent_url for r in found.collect()} == {a: "https://a.go.jp/x/1", b: "https://a.go.jp/kaigi/4"}
    assert "Aggregate [text" in found._jdf.queryExecution().optimizedPlan().toString()


def test_folders_are_made_once(spark, sf_dir):
    """A folder's name is worked out in one place of the plan each time meetings are read, however often its parts and conditions ask for it; the code of what filters by it compiles."""
    from minuteloom.plans import admin

    canonical, there = admin._folders(spark, sf_dir)
    plan = there.filter((F.col("folder") != "x") & ~F.col("folder").rlike("^[._]"))._jdf.queryExecution().executedPlan().toString()
    signs = plan.count("translate(")
    assert 0 < signs <= 3, signs  # of a ministry, a council, a meeting
    assert canonical.columns == ["meeting_id", "ministry_dir", "council_dir", "folder", "day"]


def test_folders_of_unknown_councils_and_names(spark):
    """Names as before where councils, ministries, days or titles are missing."""
    from minuteloom.functions import titles
    from minuteloom.operators import folders

    meetings = spark.createDataFrame([(1, 1, "第1回 会", "2026/01/02"), (2, 2, "会", None), (3, 3, None, "2026/01/03"), (4, None, "x", ""), (5, 4, " ", "2026")], "meeting_id long, council_id long, name string, date string")
    councils = spark.createDataFrame([(1, "会", 1), (2, None, 9), (4, " . ", None)], "council_id long, council_name string, ministry int")
    got = sorted(map(tuple, folders.canonical_folders(meetings, councils, spark.createDataFrame([(1, "省")], "ministry int, ministry_name string")).collect()))
    assert got == [(1, "省", "会", "20260102_第1回", "20260102"), (2, "9", "会議体不明", "00000000_会", ""), (3, "UNKNOWN", "会議体不明", "20260103", "20260103"), (4, "UNKNOWN", "会議体不明", "00000000_x", ""), (5, "UNKNOWN", "untitled", "2026_ ", "2026")]
    said = ["資料1（PDF：12KB）", "（PDF）", None, "資料2 － PDF 3MB", "議事－次第", "a b"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, name string").select("i", titles.material_name(F.col("name")).alias("x"))
    assert [r.x for r in rows.orderBy("i").collect()] == ["資料1", "資料", "資料", "資料2", "議事－次第", "a b"]


def test_queues_of_large_tables_have_more_tasks(spark, sf_dir, monkeypatch, duck, same):
    """F16: what is sorted for a meeting or a ministry is shared out by how much there is, not among a set number of tasks."""
    from minuteloom import batches

    monkeypatch.setattr(batches, "TASK_ROWS", 100)
    got = __spark_entry__.queries()["download_queue"](spark, sf_dir)
    same(got, duck.sql(__spark_entry__.oracle_sql()["download_queue"]))
    assert batches.sized(spark.range(1000), "id").rdd.getNumPartitions() == 10 and batches.sized(spark.range(10), "id").rdd.getNumPartitions() == 4


def test_marks_of_many_sources_are_few_calls(spark, tmp_path):
    """a call of Python with state costs milliseconds, so many sources with few attempts share one; what is kept over restarts is the same as of a walk over each source."""
    import random

    from minuteloom.streaming import crawl

    rng = random.Random(3)
    parts = [[(rng.randrange(60), i if rng.random() < 0.9 else rng.randrange(400), rng.choice([*range(-3, 3000), None]), rng.choice(["error", "error", "view", None])) for i in range(4000)] for _ in range(3)]
    parts[1] = parts[0][:1000] + parts[1]
    want, schema = {}, "t long, seq long, council_id long, kind string"
    for i, part in enumerate(parts):
        rows = spark.createDataFrame(part, schema).select((F.lit(i * 40) + F.col("t")).alias("t"), "seq", "council_id", "kind")
        rows = rows.select(F.timestamp_seconds("t").alias("ts"), "seq", "council_id", F.when(F.pmod(F.xxhash64("t", "seq", "council_id"), F.lit(3)) > 0, "error").otherwise("view").alias("kind"))
        rows.coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
        crawl.keep_marks(crawl.attempts_stream(spark, str(tmp_path / "in"), rows.schema), str(tmp_path / "cp"), str(tmp_path / "out")).awaitTermination()
        own = {}
        for r in rows.withColumn("at", F.unix_micros("ts")).collect():
            own.setdefault(r.council_id, {})[r.at, r.seq] = r.kind
        for k, seen in own.items():
            for (at, seq), kind in sorted(seen.items()):
                mark, n, failed = want.get(k, (None, 0, 0))
                if mark is None or (at, seq) > mark:
                    want[k] = (at, seq), n + 1, failed + 1 if kind == "error" else 0
    got = {r.council_id: ((r.mark, r.seq), r.attempts, r.consecutive_failures) for r in crawl.last_marks(spark, str(tmp_path / "out")).collect()}
    assert got == want and len(want) > 2000
    state = spark.read.format("statestore").load(str(tmp_path / "cp"))
    assert state.count() <= crawl.SHARES < len(want)


def _widest(df):
    """How many tasks the last shuffle of a plan has that is run."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_materials_of_large_tables_have_more_tasks(spark, sf_dir, monkeypatch, duck, same):
    """what a task sorts of lists that are replaced is bounded, so tasks are more than a shuffle's set number."""
    from minuteloom import batches

    monkeypatch.setattr(batches, "TASK_ROWS", 400)
    got = __spark_entry__.queries()["replace_materials"](spark, sf_dir)
    assert _widest(got) > 8
    same(got, duck.sql(__spark_entry__.oracle_sql()["replace_materials"]))


def test_nested_children_of_large_tables_have_more_tasks(spark, sf_dir, monkeypatch, duck, same):
    """children are gathered, joined and numbered in tasks of a bounded share of them."""
    from minuteloom import batches

    monkeypatch.setattr(batches, "TASK_ROWS", 400)
    got = __spark_entry__.queries()["flatten_children"](spark, sf_dir)
    assert _widest(got) > 8
    same(got, duck.sql(__spark_entry__.oracle_sql()["flatten_children"]))


def test_merges_of_large_tables_have_more_tasks(spark, sf_dir, monkeypatch, duck, same):
    """every join and window of a merge plan has tasks of a bounded share of the files; the caller's session keeps its settings."""
    from minuteloom import batches

    monkeypatch.setattr(batches, "TASK_ROWS", 400)
    got = __spark_entry__.queries()["folder_merge"](spark, sf_dir)
    assert _widest(got) > 8 and spark.conf.get("spark.sql.shuffle.partitions") == "4"
    same(got, duck.sql(__spark_entry__.oracle_sql()["folder_merge"]))


def test_folder_choices_read_names_that_were_made(spark, sf_dir, monkeypatch, duck, same):
    """folders' names are made and written once, not again in each join that reads them; tasks are of a bounded share of folders."""
    from minuteloom import batches

    monkeypatch.setattr(batches, "TASK_ROWS", 100)
    got = __spark_entry__.queries()["folder_choices"](spark, sf_dir)
    assert "translate(" not in got._jdf.queryExecution().executedPlan().toString()
    assert _widest(got) > 8 and spark.conf.get("spark.sql.shuffle.partitions") == "4"
    same(got, duck.sql(__spark_entry__.oracle_sql()["folder_choices"]))


def test_folder_choices_of_odd_names(spark):
    """choices equal those of a walk over all pairs: folders listed twice or that meetings have, days without digits, files of any case or none, materials, ties."""
    import random
    import re

    from minuteloom.operators import folders

    rng = random.Random(5)
    days, titles_ = ["20260101", "20260102", "2026", ""], ["", "第1回", "第2回", "Kai", "x"]
    name = lambda day, title: (day or "00000000") + ("_" + title if title else "")
    place = lambda: ("m", rng.choice("abcdef"))
    canonical = [(i, *place(), name(d, t), d) for i in range(180) for d, t in [(rng.choice(days), rng.choice(titles_))]]
    odd = ["20260101", "20260102_y第2回", "20260101_zKai第1回", "20260101_old", "20260102_old", "20260103_old", "2026_old", "202601011_x", "_20260101", ".20260101_q", "old", folders.PERMANENT, name("", "zz")]
    there = [(*place(), rng.choice(odd)) for _ in range(200)] + [c[1:4] for c in canonical[:20]]
    files = [(*p, rng.choice(["Agenda.pdf", "agenda.PDF", "kai.pdf", "第1回資料.pdf", "b.txt", None])) for p in [rng.choice(there) if rng.random() < 0.6 else rng.choice(canonical)[1:4] for _ in range(400)]]
    expected = [(rng.randrange(180), rng.choice(["agenda", "資料", "B", "", None])) for _ in range(80)]
    first, want = {}, {}
    for i, m, c, folder, day in canonical:
        if day:
            first.setdefault((m, c, day), {}).setdefault(folder, i)
    known = {x[1:4] for x in canonical}
    for m, c, folder in there:
        at = re.match("([0-9]{8})(?:_|$)", folder)
        if (m, c, folder) in known or not at or (m, c, at[1]) not in first:
            continue

        def rank(target, i):
            title = target.partition("_")[2]
            if title and title in folder:
                return 0, 0, i
            points, own = 0, {f[3].lower() for f in files if f[:3] == (m, c, target) and f[3]}
            for f in files:
                if f[:3] == (m, c, folder) and f[3]:
                    low = f[3].lower()
                    points += 3 * (low in own) + 2 * len({w.lower() for j, w in expected if j == i and w and w.lower() in low}) + bool(title and title.lower() in low)
            return 1, -points, i

        targets = first[m, c, at[1]]
        want[m, c, folder] = min(targets, key=lambda t: rank(t, targets[t]))
    where = "ministry_dir string, council_dir string, folder string"
    got = folders.choose_canonical(
        spark.createDataFrame(there, where), spark.createDataFrame(files, f"{where}, file string"), spark.createDataFrame(canonical, f"meeting_id long, {where}, day string"), spark.createDataFrame(expected, "meeting_id long, material string")
    ).collect()
    assert len(got) == len(want) > 20 and {tuple(r)[:3]: r.target for r in got} == want
