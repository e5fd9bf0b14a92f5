"""Pages, their links and days, and the merge of scraped pages into a council's meetings."""

import random

import pytest
from pyspark.sql import functions as F

from minuteloom import rounds
from minuteloom.functions import dates, names, text, titles, urls
from minuteloom.operators import admin, analytics, digest, folders, rules, sync
from minuteloom.sources import documents, dom, html, links


COUNCIL = ("cas-kaigi", "CAS", "成長検討会", "https://www.cas.go.jp/kaigi/index.html")
STORED = [
    ("cas-kaigi", "cas-kaigi-20260401-001", "第1回 成長検討会", "2026/04/01", False, "https://www.cas.go.jp/kaigi/dai1/index.html", [("資料1", "https://www.cas.go.jp/kaigi/dai1/1.pdf", "PDF")], False),
    ("cas-kaigi", "cas-kaigi-20260501-002", "第2回 成長検討会", "2026/05/01", False, "https://www.cas.go.jp/kaigi/index.html", [], False),
    ("cas-kaigi", "cas-kaigi-20240601-003", "第3回 成長検討会", "2024/06/01", False, "https://www.cas.go.jp/kaigi/r6/dai3.html", [("議事録", "https://www.cas.go.jp/kaigi/r6/3.pdf", "PDF")], True),
]
SCRAPED = [
    (1, "https://www.cas.go.jp/kaigi/dai1/index.html", "第1回 成長検討会", ["令和8年4月1日"], [("資料1", "https://www.cas.go.jp/kaigi/dai1/1.pdf", "PDF"), ("PDF", "https://www.cas.go.jp/kaigi/dai1/gijiroku.pdf", "PDF")]),
    (2, "https://www.cas.go.jp/kaigi/dai2/", "第2回 成長検討会", ["令和8年5月1日"], [("資料", "https://www.cas.go.jp/kaigi/dai2/2.pdf", "PDF"), ("閉じる", "https://www.cas.go.jp/x.pdf", "PDF")]),
    (3, "https://www.cas.go.jp/kaigi/dai3/", "第3回 成長検討会", ["令和8年6月1日"], [("資料1", "https://www.cas.go.jp/kaigi/dai3/1.pdf", "PDF")]),
    (4, "https://www.cas.go.jp/kaigi/old/dai3.html", "第3回 成長検討会", ["平成20年6月1日"], [("資料1", "https://www.cas.go.jp/kaigi/old/1.pdf", "PDF")]),
    (5, "https://www.cas.go.jp/kaigi/annai/dai5.html", "第5回 成長検討会の開催について", ["令和8年7月1日"], []),
    (6, "https://www.meti.go.jp/dai6.html", "第6回 成長検討会", ["令和8年7月1日"], [("資料1", "https://www.meti.go.jp/1.pdf", "PDF")]),
    (7, "https://www.cas.go.jp/kaigi/dai7/", "第7回 成長検討会", [], [("資料1", "https://www.cas.go.jp/kaigi/dai7/1.pdf", "PDF")]),
    (8, "https://www.cas.go.jp/kaigi/dai8/", "まったく別の話題である農産物の輸出", ["令和8年8月1日"], [("資料1", "https://www.cas.go.jp/kaigi/dai8/1.pdf", "PDF")]),
    (9, "https://www.cas.go.jp/kaigi/20260601b.html", "成長検討会", ["令和8年6月1日"], [("追加資料", "https://www.cas.go.jp/kaigi/dai3/2.pdf", "PDF")]),
]


def sync_tables(spark):
    material = "array<struct<name:string,url:string,type:string>>"
    known = spark.createDataFrame([COUNCIL], "council_id string, ministry string, name string, official_url string")
    stored = spark.createDataFrame(STORED, f"council_id string, meeting_id string, name string, date string, unconfirmed boolean, url string, materials {material}, locked boolean")
    scraped = spark.createDataFrame([(COUNCIL[0], s, u, t, None, dd, m) for s, u, t, dd, m in SCRAPED], f"council_id string, seq int, url string, title string, page_title string, found_dates array<string>, materials {material}")
    return known, stored, scraped


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def synced(spark, stored, scraped, rule=None, **options):
    known, old, new = sync_tables(spark)
    council = COUNCIL[0]
    old = spark.createDataFrame([(council, *m) for m in stored], old.schema)
    new = spark.createDataFrame([(council, i, u, t, None, d, m) for i, (u, t, d, m) in enumerate(scraped)], new.schema)
    return sync.sync_scraped(known, old, new, rule, **options)


def test_sync_by_all_rules(spark):
    got = {r.meeting_id: r for r in sync.sync_scraped(*sync_tables(spark)).collect()}
    first = got["cas-kaigi-20260401-001"]
    assert first.action == "merged" and [m.name for m in first.materials] == ["資料1", "議事録"]
    second = got["cas-kaigi-20260501-002"]
    assert second.action == "upgraded" and second.url == "https://www.cas.go.jp/kaigi/dai2" and [m.name for m in second.materials] == ["第2回 成長検討会 資料 (2.pdf)"]
    third = got["cas-kaigi-20260601-003"]
    assert third.action == "inserted" and third.name == "第3回 成長検討会 (2026年)"
    assert [m.name for m in third.materials] == ["資料1", "追加資料"]  # the other page of that day
    assert got["cas-kaigi-20240601-003"].action == "kept"
    seventh = got["cas-kaigi-20990101-007"]
    assert seventh.unconfirmed and seventh.name == "第7回 成長検討会 (開催日不明)"
    assert len(got) == 5  # no notice, no other ministry, no older period, no other subject


def test_sync_again_changes_nothing(spark):
    known, _, scraped = sync_tables(spark)
    once = sync.sync_scraped(*sync_tables(spark))
    stored = once.drop("action").persist()
    again = sync.sync_scraped(known, stored, scraped)
    assert {r.action for r in again.collect()} == {"kept"}
    assert sorted(map(repr, again.drop("action").collect())) == sorted(map(repr, stored.collect()))
    counts = sync.council_counts(known, once).first()
    assert (counts.meetings, counts.is_new) == (5, True) and sync.council_counts(known, again).first().meetings is None


def test_sync_keeps_locked_materials(spark):
    page = ("https://www.cas.go.jp/kaigi/dai4/", "第4回 成長検討会", ["令和8年9月1日"], [("新資料", "https://www.cas.go.jp/kaigi/dai4/1.pdf", "PDF")])
    locked = ("cas-kaigi-20260901-004", "第4回 成長検討会", "2026/09/01", False, COUNCIL[3], [("資料", "https://www.cas.go.jp/old.pdf", "PDF")], True)
    assert synced(spark, [locked], [page]).first().action == "kept"
    assert synced(spark, [locked], [page], keep_locked=False).first().action == "upgraded"
    bare = (*locked[:5], [], True)
    assert synced(spark, [bare], [page]).first().action == "upgraded"


def test_sync_rules_of_a_council(spark):
    page = lambda n: (f"https://www.cas.go.jp/kaigi/dai{n}/", f"第{n}回 成長検討会", [f"令和8年{n}月1日"], [])
    rule = spark.createDataFrame([(COUNCIL[0], True, ["/dai2/x", "DAI3"], ["第4回"], ["/kaigi/"])], "council_id string, no_self boolean, not_urls array<string>, not_titles array<string>, only_urls array<string>")
    assert sorted(r.name for r in synced(spark, [], [page(2), page(3), page(4)], rule).collect()) == ["第2回 成長検討会"]
    assert synced(spark, [], [page(2)] * 3).count() == 1
    assert synced(spark, [], []).count() == 0


def test_a_new_session_leaves_locked_ones_alone(spark):
    paper = lambda n: (f"第{n}回 次第", f"https://www.cas.go.jp/kaigi/{n}.pdf", "PDF")
    locked = ("cas-kaigi-20260324-001", "第1回 成長検討会", "2026/03/24", False, "https://www.cas.go.jp/kaigi/s1.html", [paper(1)], True)
    pages = [("https://www.cas.go.jp/kaigi/s1.html", "第1回 成長検討会", ["2026/03/24"], [paper(1)]), ("https://www.cas.go.jp/kaigi/s2.html", "第2回 成長検討会", ["2026/04/15"], [paper(2), ("配布資料 (PDF)", "https://www.cas.go.jp/kaigi/2b.pdf", "PDF")])]
    got = {r.meeting_id: r for r in synced(spark, [locked], pages).collect()}
    old, new = got["cas-kaigi-20260324-001"], got["cas-kaigi-20260415-002"]
    assert len(got) == 2 and (old.action, old.locked, len(old.materials)) == ("kept", True, 1)
    assert (new.action, new.date, [m.url for m in new.materials]) == ("inserted", "2026/04/15", ["https://www.cas.go.jp/kaigi/2.pdf", "https://www.cas.go.jp/kaigi/2b.pdf"])
    known, _, _ = sync_tables(spark)
    assert sync.council_counts(known, spark.createDataFrame(list(got.values()), sync.SYNCED)).first().meetings == 2


def test_a_page_of_its_own_takes_the_place_of_the_councils(spark):
    """A meeting that was stored before its day, with the council's page and no materials, gets both, under another spelling of its title."""
    before = ("cas-kaigi-20260828-263", "第263回 成長検討会", "2026/08/28", False, COUNCIL[3], [], False)
    page = ("https://www.cas.go.jp/stf/newpage_75439.html", "第263回成長検討会（web会議）資料", ["令和8年8月28日"], [("議事次第", "https://www.cas.go.jp/c/1.pdf", "PDF"), ("資料1", "https://www.cas.go.jp/c/2.pdf", "PDF")])
    got = synced(spark, [before], [page, page]).collect()
    assert [(r.meeting_id, r.action, r.url, [m.name for m in r.materials]) for r in got] == [(before[0], "upgraded", page[0], ["議事次第", "資料1"])]


def test_a_new_period_may_start_rounds_anew(spark):
    """A round that is stored from years ago comes anew with its year, but older periods aren't dug up, and stated terms get no year."""
    stored = [(f"cas-kaigi-{d.replace('/', '')}-{n:03d}", f"第{n}回 成長検討会", d, False, f"https://www.cas.go.jp/kaigi/{d[:4]}/{n}.html", [("資料", f"https://www.cas.go.jp/{d[:4]}/{n}.pdf", "PDF")], False) for n, d in ((1, "2025/08/26"), (4, "2019/05/10"), (6, "2026/09/04"), (7, "2022/03/24"))]
    page = lambda n, day, path, title="第{}回 成長検討会": (f"https://www.cas.go.jp/kaigi/{path}", title.format(n), [day], [("資料", f"https://www.cas.go.jp/kaigi/{path}.pdf", "PDF")])
    scraped = [page(7, "令和8年11月18日", "new7"), page(4, "平成30年4月9日", "old4"), page(1, "平成20年1月15日", "old1"), page(4, "令和8年12月1日", "new4", "成長検討会（令和8事務年度第{}回）")]
    got = [r for r in synced(spark, stored, scraped).collect() if r.action == "inserted"]
    assert sorted(r.name for r in got) == ["成長検討会(令和8事務年度第4回)", "第7回 成長検討会 (2026年)"]


def test_an_unclosed_frame_ends_with_its_parent():
    page = "<div><nav><a href='/n.html'>n</a></div><main><a href='/a.pdf'>資料</a></main>"
    assert [m["url"] for m in html.parse_materials(page, "https://e.go.jp/")] == ["https://e.go.jp/a.pdf"]
    root = dom.parse("<ul><li>a<li>b <a href=x>c</a></ul><p>d<p>e" + "<div>" * 5000 + "deep")
    assert [n.text() for n in root.find("li")] == ["a", "b c"] and len(root.find("p")) == 2 and root.text().endswith("deep")
    assert dom.parse(None).text() == "" and dom.parse("</p><br/>x</div>").text() == "x"


def test_links_keep_what_stands_around_them(spark):
    page = """<base href="https://e.go.jp/k/"><header><a href="/h.html">第1回委員会</a></header><h2>関連リンク</h2><a href="dai9.html">第9回 会議</a>
    <h2>開催状況</h2><table><tr><th>回数</th><th>資料</th><th>開催案内</th></tr><tr><td>第1回</td><td><a href="dai1.html">第1回資料</a></td><td><a href="an1.html">第1回</a></td></tr><tr><td>―</td><td><a href="pub.html">議事資料</a></td></tr></table>
    <a href="https://other.go.jp/dai2.html">第2回</a><a href="a.pdf">第3回</a><a href="#x">第4回</a><a href="dai1.html#p">第1回 again</a><a href="http://[bad">第5回</a>"""
    pages = spark.createDataFrame([(1, "https://e.go.jp/k/index.html", page), (2, "https://e.go.jp/", None), (3, None, "<a href='dai1.html'>第1回</a>")], "page_id long, url string, html string")
    assert sorted(rows_of(links.subpages(pages), "page_id", "url")) == [(1, "https://e.go.jp/h.html"), (1, "https://e.go.jp/k/dai1.html")]
    strict = links.subpages(pages, F.lit("/none/"), F.lit(True))
    assert strict.count() == 0 and links.subpages(pages, F.lit(r"dai\d"), F.lit(True)).count() == 1


def test_days_of_a_page():
    page = "<body><div class='side-menu'>2020年1月1日</div><p>最終更新：2024年5月1日</p><p>開催日時：令和6年4月２日（火）</p><p>2026年（令和8年）3月24日</p><p>2024年2月1日施行、2024/6/7</p></body>"
    assert [(d["text"], d["first"]) for d in html.date_texts(page)] == [("令和6年4月2日", True), ("2026年3月24日", False), ("2024年2月1日", False)]
    assert html.date_texts(None) == []


def test_date_notations_by_turn(spark):
    one = lambda t: spark.range(1).select(dates.parse_era_date(F.lit(t))).first()[0]
    assert str(one("2024/1/1 平成30年2月3日")) == "2018-02-03"  # an era in words goes first
    assert str(one("2026年2月30日 2024/3/4")) == "2024-03-04"  # what is no day leaves the next notation its turn
    assert one("1234567/1/1") is None and one("") is None and one(None) is None
    assert str(one("S63.4.1")) == "1988-04-01" and str(one("令和 元 年 12 月 1 日")) == "2019-12-01"


def spread(keys):
    """One by one: a key that equals the last one goes back to the last gap between other keys."""
    out = []
    for i, key in enumerate(keys):
        at = len(out)
        if out and keys[out[-1]] == key:
            at = next((j for j in range(len(out) - 1, 0, -1) if key not in (keys[out[j - 1]], keys[out[j]])), len(out))
        out.insert(at, i)
    return out


def round_robin(keys):
    sizes = {k: keys.count(k) for k in set(keys)}
    turn = {}
    rows = [(turn.setdefault(k, []).append(i) or len(turn[k]), -sizes[k], k, i) for i, k in enumerate(keys)]
    return [i for *_, i in sorted(rows)]


def test_queues_equal_a_walk(spark, monkeypatch):
    monkeypatch.setattr(analytics, "QUEUE_RANGE", 4)
    rng = random.Random(1)
    for keys in ([rng.choice("aaaaaaabbbcd") for _ in range(60)], [rng.choice("ab") for _ in range(9)], ["a"] * 5, ["b", "a", "a", "a", "c", "d", "e"], ["a"], []):
        queue = analytics.interleave(spark.createDataFrame(list(enumerate(keys)), "i int, key string"), "key", ["i"])
        order = round_robin(keys)
        assert [r.i for r in queue.orderBy("place").collect()] == order
        moved = analytics.part_neighbours(queue, "key").orderBy("repaired").collect()
        want = [order[j] for j in spread([keys[i] for i in order])]
        assert [r.i for r in moved] == want and [r.repaired for r in moved] == list(range(1, len(keys) + 1))


def test_free_numbers_equal_a_walk(spark):
    rng = random.Random(2)
    taken = {(g, rng.randint(-1, 12)) for g in "ab" for _ in range(9)} | {(None, 1)}
    rows = [(i, rng.choice(["a", "a", "b", None])) for i in range(40)]
    used, want = {g: {n for h, n in taken if h == g} for g in ("a", "b", None)}, {}
    for i, g in rows:
        n = next(n for n in range(1, 99) if n not in used[g])
        used[g].add(n)
        want[i] = n
    got = rounds.free_numbers(spark.createDataFrame(rows, "i int, g string"), spark.createDataFrame(sorted(taken, key=str), "g string, number int"), ["g"], [F.asc("i")])
    assert {r.i: r.number for r in got.collect()} == want


def test_ranks_of_a_group_over_many_ranges(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 2).alias("g")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rounds.ranks(rows, ["g"], [F.desc("id")])
        assert got.select(F.spark_partition_id()).distinct().count() > 1
        want = {}
        for i in range(4999, -1, -1):
            want.setdefault(None if i % 3 == 0 else i % 2, []).append(i)
        assert {r.id: r["rank"] for r in got.collect()} == {i: n for own in want.values() for n, i in enumerate(own, 1)}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_names_of_files_and_folders(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(titles.file_name(F.lit('a/b:c*?"<>|\\'))) == "a／b：c＊？”＜＞｜￥" and one(titles.file_name(F.lit(" .. "))) == "untitled" and one(titles.file_name(F.lit("x" * 200))) == "x" * 150
    assert one(titles.folder_name(F.lit("2025/12/13"), F.lit("第16回 成長　検討会"), F.lit("成長　検討会"))) == "20251213_第16回" and one(titles.folder_name(F.lit(None).cast("string"), F.lit("x"), F.lit("x"))) == "00000000"
    assert one(titles.is_material_page(F.lit("配付資料"), F.lit("https://e/x.html"))) and not one(titles.is_material_page(F.lit("配付資料"), F.lit("https://e/x.pdf?1")))
    assert one(names.title_stem(F.lit("(1) 第3回 会議（2026年10月開催）"))) == "(1)会議"
    assert one(urls.ministry_of_host(F.lit("https://www.cas.go.jp/x"))) == ["CAO", "CAS"]
    assert one(text.sessions(F.lit("第１０回 dai3/_12giji"))) == [10, 3, 12]


def test_export_with_a_byte_order_mark(spark, tmp_path):
    rows = spark.createDataFrame([("2026/01/01", "=1+1", 'a"b')], "day string, name string, note string")
    head, line = '"日","名","注"', '"2026/01/01","\'=1+1","a""b"'
    late = spark.createDataFrame(spark.sparkContext.parallelize([], 3).union(rows.rdd), rows.schema)
    for name, table, want in (("one", rows, [line]), ("wide", rows.repartition(3, "day"), [line]), ("none", rows.filter("false"), []), ("no_task", spark.createDataFrame([], rows.schema), []), ("late", late, [line])):
        documents.export_csv_marked(table, str(tmp_path / name), ["day", "name", "note"], ("日", "名", "注"))
        files = [f.read_bytes() for f in sorted((tmp_path / name).glob("part-*"))]
        assert files and all(f.startswith(b"\xef\xbb\xbf" + head.encode()) for f in files), name
        assert [x for f in files for x in f.decode("utf-8-sig").splitlines() if x != head] == want


def test_folder_points(spark):
    canonical = spark.createDataFrame([(1, "m", "c", "20260101_第1回", "20260101"), (2, "m", "c", "20260101_第2回", "20260101")], "meeting_id long, ministry_dir string, council_dir string, folder string, day string")
    stray = spark.createDataFrame([("m", "c", "20260101_old"), ("m", "c", "20260101_x第2回"), ("m", "c", "20250101"), ("m", "c", "00_会議体資料")], "ministry_dir string, council_dir string, folder string")
    files = spark.createDataFrame([("m", "c", "20260101_old", "Agenda.pdf"), ("m", "c", "20260101_第2回", "agenda.pdf")], "ministry_dir string, council_dir string, folder string, file string")
    expected = spark.createDataFrame([(1, "agenda")], "meeting_id long, material string")
    got = dict(rows_of(folders.choose_canonical(stray, files, canonical, expected), "folder", "target"))
    assert got == {"20260101_old": "20260101_第2回", "20260101_x第2回": "20260101_第2回"}
    two = files.withColumns({"size": F.lit(1), "digest": F.col("file")})
    plan = folders.merge_plan(two, spark.createDataFrame([("m", "c", "20260101_old", "20260101_第2回")], "ministry_dir string, council_dir string, folder string, target string"))
    assert rows_of(plan, "file", "action", "new_name") == [("Agenda.pdf", "move", "Agenda.pdf")]
    assert folders.merge_stats(plan).first().unique_files_moved == 1


def test_digest_is_the_same_in_any_order(spark):
    items = spark.createDataFrame([("A", "2026/01/01", "t1", "u1"), ("A", "", "t0", "u0"), (None, "2026/01/02", "t2", "u2")], "ministry string, date string, title string, url string").withColumn("similar_existing", F.array(F.struct(F.lit("c1").alias("id"), F.lit("n").alias("name"))))
    made = lambda df: digest.digest_hash(digest.ordinals(df, "ministry", ["date", "url", "title"]), []).first()
    assert made(items) == made(items.orderBy(F.desc("url")).repartition(3)) and made(items).n == 3
    import hashlib
    import json

    want = [{"id": f"N00{i}", "ministry": m or "", "date": d, "title": t, "url": u, "similar_existing": [{"id": "c1", "name": "n"}]} for i, (m, d, t, u) in enumerate([(None, "2026/01/02", "t2", "u2"), ("A", "", "t0", "u0"), ("A", "2026/01/01", "t1", "u1")], 1)]
    assert made(items).digest == hashlib.sha256(json.dumps(want, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_rules_and_their_index(spark):
    resolved = spark.createDataFrame([("b", {"url": "https://e.go.jp/x/"}), ("a", {"archive_url": "http://e.go.jp/x"}), ("c", {"official_url": ""})], "council_id string, rule map<string,string>")
    assert rows_of(rules.url_index(resolved), "key", "council_id") == [("e.go.jp/x", "a")]


def test_requests_keep_their_distance(spark):
    rows = spark.createDataFrame([(1, "https://www.meti.go.jp/a", 0.0), (2, "https://x.meti.go.jp/a", 0.0), (3, "https://www.meti.go.jp/b", 0.1), (4, "https://www.meti.go.jp/c", 9.0), (5, None, 2.0)], "seq int, url string, at double")
    got = {r.seq: r.starts for r in admin.request_times(rows).collect()}
    assert got == pytest.approx({1: 0.0, 2: 0.0, 3: 1.5, 4: 9.0, 5: 2.0})


def test_store_api(spark, tmp_path):
    from minuteloom import schema
    from minuteloom.api import Records

    root = str(tmp_path / "db")
    documents.init_store(spark, root)
    council = lambda i, **more: {f.name: more.get(f.name, i if f.name == "id" else "x" if f.dataType.simpleString() == "string" and not f.nullable else None) for f in schema.COUNCILS}
    rows = [council("cas-a", is_newly_discovered=True, manual_lock=True), council("cas-b", is_newly_discovered=True), council("env-c")]
    spark.createDataFrame([tuple(r.values()) for r in rows], schema.COUNCILS).write.mode("overwrite").parquet(f"{root}/councils")
    meeting = lambda i, date, new: tuple(i if f.name == "id" else date if f.name == "date" else new if f.name == "is_newly_discovered" else "x" if not f.nullable else None for f in schema.MEETINGS)
    spark.createDataFrame([meeting("m1", "2026/01/01", True), meeting("m2", "2099/01/01", True), meeting("m3", "2020/01/01", False)], schema.MEETINGS).write.mode("overwrite").parquet(f"{root}/meetings")
    records = Records(spark, root)
    target = spark.createDataFrame([("cas-b",)], "id string")
    left, gone = records.reject(target, "no council", "2026/01/01")
    assert sorted(r.id for r in left.collect()) == ["cas-a", "env-c"] and rows_of(gone, "id", "reason") == [("cas-b", "no council")]
    gone.write.mode("overwrite").parquet(f"{root}/gone")
    assert sorted(r.id for r in records.discovered_councils().collect()) == ["cas-a", "cas-b"]
    assert [r.id for r in records.new_meetings().collect()] == ["m2", "m1"] and [r.id for r in records.unconfirmed_meetings().collect()] == ["m2"]
    assert {r.id: r.manual_lock for r in records.toggle_lock("councils", target).collect()} == {"cas-a": True, "cas-b": True, "env-c": False}
    assert {r.result for r in records.crawl_states().collect()} == {"pending"} and records.rejected_councils().count() == 0
    assert {r.segment for r in records.public_data("2026-06-01").collect()} == {"active", "archive"}
    assert [(r.key, r.value) for r in records.save_config("k", "v").collect()] == [("k", "v")] and records.config("k").count() == 0
    assert records.material_states().count() == 0
    assert [(r.id, r.council_name) for r in records.new_meetings(7, "2026-01-05").collect()] == [("m2", "x"), ("m1", "x")] and records.crawler_config().first()[:5] == (True, True, 3, 10, 30)
    records.save_config("discoveryKeywords", '{"a": ["検討会", "部会"]}').unionByName(spark.createDataFrame([("crawlerConfig", '{"llm_mode": false, "discovery_llm_mode": true, "llm_budget": {"daily": 1}}')], "key string, value string")).write.mode("overwrite").parquet(f"{root}/more")
    spark.read.parquet(f"{root}/more").write.mode("overwrite").parquet(f"{root}/admin_configs")
    assert rows_of(records.discovery_keywords(), "group", "position", "keyword") == [("a", 0, "検討会"), ("a", 1, "部会")] and records.crawler_config().first()[:5] == (False, True, 1, None, None)
    log = spark.createDataFrame([(1, "a"), (2, "b")], "log_id int, line string")
    assert rows_of(records.crawler_status(log, 1), "log_id", "unconfirmed") == [(2, 1)] and records.verification_report().count() == 0
    (tmp_path / "db" / "verification_report.json").write_text('{"approved": 3}')
    assert records.verification_report().first().approved == 3
    (tmp_path / "files" / "cas").mkdir(parents=True)
    (tmp_path / "files" / "cas" / "a[1].txt").write_text("x")
    seen = records.view_material("cas/a[1].txt", str(tmp_path / "files")).first()
    assert (bytes(seen.content), seen.content_type) == (b"x", "text/plain; charset=utf-8")
    assert [records.view_material(p, str(tmp_path / "files")).count() for p in ("../db/verification_report.json", "", "cas/none.pdf", "/etc/hosts")] == [0] * 4
    for v, n in (("v1", 1), ("v2", 2)):
        records.save("councils", left.limit(n), v)
    assert records.restore_previous("councils", "v3").count() == 1 and records.restore_previous("councils", "v4").count() == 2
    assert records.backups("councils") == ["v4", "v3", "v2", "v1"]


def test_names_of_materials_from_their_context(spark):
    page = "<p>配付資料：<a href='a.pdf'>PDF</a></p><table><tr><th>第3回</th><td>令和6年</td><td><a href='b.pdf'>資料</a> 別添の表</td></tr></table><ul><li><a href='c.pdf'>（PDF：3KB）</a></li></ul>"
    pages = spark.createDataFrame([(1, "https://e.go.jp/x/", page), (2, None, None)], "page_id long, url string, html string")
    got = {r.url.rsplit("/", 1)[1]: r.name for r in links.page_materials(pages).collect()}
    assert got["b.pdf"] == "資料 別添の表" and got["c.pdf"] == "(PDF:3KB)" and got["a.pdf"] == "PDF"


def test_rows_of_queries_without_sql(spark, sf_dir):
    from difflib import SequenceMatcher

    from minuteloom import registry
    from minuteloom.schema import councils, meetings

    run = lambda name: registry.QUERIES[name](spark, sf_dir)
    known = {r.meeting_id: (r.label, r.category) for r in meetings(spark, sf_dir).join(councils(spark, sf_dir), "council_id").collect()}
    got = run("title_consistency").collect()
    assert len(got) == len(known)
    for r in got:
        ratio = SequenceMatcher(None, *known[r.meeting_id]).ratio()
        assert r.ratio == ratio and r.inconsistent == (ratio < 0.40)


def test_batches_that_come_twice(spark, tmp_path):
    """Attempts are seen once a key, and a merge by key gives the same table when a batch comes again."""
    from minuteloom.operators import merge
    from minuteloom.streaming import crawl as streams

    rows = spark.createDataFrame([("2024-01-01 10:00:00", 1, "a"), ("2024-01-01 10:00:00", 1, "a"), ("2024-01-01 11:00:00", 2, "b")], "ts string, k int, v string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    state = {"table": spark.createDataFrame([(2, "old")], "k int, v string"), "batches": 0}

    def apply(batch, _):
        for _ in range(2):
            state["table"] = spark.createDataFrame(merge.upsert(state["table"], batch.select("k", "v"), ["k"]).collect(), "k int, v string")
        state["batches"] += 1

    stream = streams.first_seen(streams.attempts_stream(spark, str(tmp_path / "in"), rows.schema), "k")
    streams.upsert_batches(stream, str(tmp_path / "cp"), apply).awaitTermination()
    assert sorted(map(tuple, state["table"].collect())) == [(1, "a"), (2, "b")] and state["batches"] >= 1


def test_similar_names_equal_all_pairs(spark):
    """Names of few common letters, so that bounds have ties to keep, and copies."""
    from minuteloom.operators import entity

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeあいう") for _ in range(rng.randint(1, 7)))
    names_ = [(j, rng.choice("xy"), rng.choice(["同じ名", word(), word(), word()])) for j in range(150)]
    items = [(i, rng.choice("xy"), word() + word() + rng.choice(["", "同じ名"])) for i in range(60)]
    grams = lambda t: {t[p : p + 2] for p in range(len(t) - 1)} or {t}
    want = []
    for i, m, t in items:
        scored = [(-len(grams(t) & grams(s)) / len(grams(s)), -len(grams(t) & grams(s)), j) for j, n, s in names_ if n == m]
        want += [(i, j, -o, -s, r) for r, (s, o, j) in enumerate(sorted(x for x in scored if x[1])[:3], 1)]
    got = entity.similar_names(spark.createDataFrame(items, "i int, m string, t string"), spark.createDataFrame(names_, "j int, m string, s string"), "i", "j", ["m"], F.col("t"), F.col("s"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_council_of_many_pages(spark):
    """200,000 pages of one council, a third of them stored: each page costs what concerns it, and doing it again changes nothing."""
    n, parent = 200_000, "https://www.cas.go.jp/kaigi/"
    known = spark.createDataFrame([COUNCIL], "council_id string, ministry string, name string, official_url string")
    k = F.col("id")
    day = F.date_add(F.lit("1500-01-01").cast("date"), k.cast("int"))
    name, page = F.concat(F.lit("第"), k, F.lit("回 成長検討会")), F.concat(F.lit(parent), F.lit("p"), k)
    paper = F.array(F.struct(F.lit("資料1").alias("name"), F.concat(page, F.lit(".pdf")).alias("url"), F.lit("PDF").alias("type")))
    rows = spark.range(1, n + 1)
    said = F.struct(day.alias("day"), name.alias("name"), page.alias("page"), paper.alias("paper"))
    # What sync_scraped prepares of each page and meeting, so that the test is of the fold.
    pages = rows.select(F.lit(COUNCIL[0]).alias("council_id"), k.alias("seq"), said.alias("x")).select("council_id", "seq", F.lit(COUNCIL[2]).alias("council"), F.lit(parent).alias("parent"), F.col("x.page").alias("url"), F.col("x.name").alias("title"), F.col("x.name").alias("shown"), F.col("x.paper").alias("materials"), F.date_format("x.day", "yyyy/MM/dd").alias("date"), F.lit(False).alias("unconfirmed"), F.array(F.col("seq").cast("int")).alias("rounds"), F.lit(COUNCIL[2]).alias("stem"), F.lit(False).alias("round_only"), F.lit(COUNCIL[2]).alias("council_stem"), *[F.lit(False).alias(c) for c in ("stock", "has_period", "wordless", "undated_word")])
    stored = rows.filter(k % 3 == 0).select(F.lit(COUNCIL[0]).alias("council_id"), F.format_string("m%09d", k).alias("meeting_id"), name.alias("name"), F.date_format(day, "yyyy/MM/dd").alias("date"), F.lit(False).alias("unconfirmed"), F.lit(parent).alias("url"), F.array().cast(f"array<{sync.MATERIAL}>").alias("materials"), F.lit(False).alias("locked"), F.array(k.cast("int")).alias("rounds"), F.lit(COUNCIL[2]).alias("stem"), F.lit(False).alias("index"))
    once = sync.folded(stored, pages, True).persist()
    assert {r.action: r["count"] for r in once.groupBy("action").count().collect()} == {"inserted": n - n // 3, "upgraded": n // 3}
    again = once.drop("action").withColumns({"rounds": F.array(F.regexp_extract("name", "第([0-9]+)回", 1).cast("int")), "stem": F.lit(COUNCIL[2]), "index": F.lit(False)})
    assert sync.folded(again, pages, True).filter("action <> 'kept'").count() == 0
    once.unpersist()
