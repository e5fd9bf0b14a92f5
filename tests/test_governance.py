from pyspark.sql import functions as F

from minuteloom.functions import names
from minuteloom.operators import discovery, governance

NAMES = ["第10回 AI戦略会議の開催について", "令和8年度 成長戦略ワーキンググループ（第3回）配付資料", "お知らせ　水循環検討会", "「原子力委員会」", "IMF国際通貨金融委員会", "大臣が現地を視察", "度", None]
LINKS = [
    ("CAO", 1, "第3回 水循環検討会", "https://www.cao.go.jp/mizu/3.html"), ("CAO", 2, "水循環検討会", "https://www.cao.go.jp/mizu/"), ("CAO", 3, "原子力委員会", "https://www.cao.go.jp/aec/"),
    ("CAO", 4, "開発・イノベーション小委員会", "https://www.cao.go.jp/inno/"), ("CAO", 5, "宇宙政策委員会", "https://www.cao.go.jp/press/2026/a.html"), ("CAO", 6, "食品安全部会", "https://www.cao.go.jp/food/"), ("CAO", 7, "大臣が検討会に出席", "https://www.cao.go.jp/x/"),
]


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_names(spark):
    n = F.col("name")
    rows = spark.createDataFrame([(x,) for x in NAMES], "name string")
    got = {r.name: r for r in rows.select("name", names.clean_name(n).alias("clean"), names.core_name(n).alias("core"), names.category(n)["code"].alias("category"), discovery.is_noise(n).alias("is_noise")).collect()}
    assert got["第10回 AI戦略会議の開催について"].clean == "AI戦略会議"
    assert got["令和8年度 成長戦略ワーキンググループ（第3回）配付資料"].clean == "成長戦略ワーキンググループ"
    assert got["令和8年度 成長戦略ワーキンググループ（第3回）配付資料"].category == "WORKING_GROUP"
    assert got["お知らせ　水循環検討会"].core == "水循環検討会" and got["「原子力委員会」"].clean == "原子力委員会"
    assert {n for n, r in got.items() if r.is_noise} == {"IMF国際通貨金融委員会", "大臣が現地を視察", "度", None}
    assert spark.range(1).select(names.category(F.lit("集い"))).first()[0] == ("COUNCIL", True)


def test_press_urls_and_news(spark):
    rows = spark.createDataFrame([("https://a.go.jp/press/2026/1.html", "白書の公表"), ("https://a.go.jp/shingi/1.zip", "第1回の検討会"), ("https://a.go.jp/shingi/", "第1回の検討会"), (None, None)], "url string, title string")
    got = rows.select(discovery.is_press_url(F.col("url")), discovery.is_no_council_news(F.col("title"), F.col("url"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, True), (False, False), (False, True)]


def test_noise_by_its_words(spark):
    said = {"総理と首脳との会談": True, "総理大臣との電話会談を実施": True, "大臣がAI戦略会議に出席": True, "代表と知事の表敬": True, "大臣のための検討会": False, "研究課題発表を行いました": True, "COP30に関する会議": True, "委員と意見を交換する検討会": False}
    rows = spark.createDataFrame([(x,) for x in said], "name string")
    assert {r.name: r.noise for r in rows.select("name", discovery.is_noise(F.col("name")).alias("noise")).collect()} == said
    news = {"長官記者会見の概要": True, "会見する総理": False, "意見公募手続の結果": True, "結果の意見公募手続": False, "労働力調査結果": True, "年次報告について": True, "年次報告書の検討会": False, "外相会談を行いました": True, "検討会の資料": False}
    rows = spark.createDataFrame([(x,) for x in news], "title string")
    assert {r.title: r.out for r in rows.select("title", discovery.is_no_council_news(F.col("title"), F.lit("https://a.go.jp/")).alias("out")).collect()} == news


def test_admitted_links(spark):
    """The later spelling of a name, known names and endings, press releases and people's doings are left out."""
    links = spark.createDataFrame(LINKS, "ministry string, position int, text string, url string")
    known = spark.createDataFrame([("CAO", "原子力委員会", "https://www.cao.go.jp/old/"), ("CAO", "イノベーション小委員会", "https://www.cao.go.jp/i/")], "ministry string, name string, official_url string")
    got = discovery.admit_links(links, known, ["検討会", "委員会", "部会"]).select("position", "name", F.col("category.code").alias("category"))
    assert rows_of(got, "position", "name", "category") == [(1, "水循環検討会", "STUDY"), (6, "食品安全部会", "SECTION")]


def test_portal_pages_of_odd_portals(spark):
    rows = [("https://a.go.jp/", None, 1, "https://a.go.jp/about.html", "概要"), ("https://b.go.jp/", "", 1, "https://b.go.jp/2026/", "2026年"), ("https://b.go.jp/", "", 2, "https://b.go.jp/x.html", "9月"), ("https://c.go.jp/", "news_menu", 1, None, None)]
    got = discovery.resolve_portals(spark.createDataFrame(rows, "portal string, pattern string, position int, url string, text string"), "2026-09-16")
    assert rows_of(got, "portal", "rank", "url") == [("https://a.go.jp/", 0, "https://a.go.jp/"), ("https://b.go.jp/", 0, "https://b.go.jp/2026/"), ("https://b.go.jp/", 1, "https://b.go.jp/x.html"), ("https://c.go.jp/", 0, "https://c.go.jp/")]


def test_parent_of_a_release_without_a_page(spark):
    rows = [("https://a.go.jp/kaiken/2.html", "会見の記録", 1, "https://a.go.jp/a/", "アクセス方法"), ("https://a.go.jp/kaiken/3.html", None, 1, None, None)]
    got = discovery.parent_pages(spark.createDataFrame(rows, "press_url string, name string, position int, url string, text string"))
    assert rows_of(got, "press_url", "parent_url") == [(u, u) for u in ("https://a.go.jp/kaiken/2.html", "https://a.go.jp/kaiken/3.html")]


def walked(found, known):
    """A sequential walk: the first of those that meet stays."""
    had = [(m or "", (n or "").replace(" ", ""), u) for m, n, u in known]
    kept = []
    body = lambda x: len(x) >= 4 and any(w in x for w in discovery.BODY_WORDS)
    ends = lambda x, y: x.endswith(y) and not x.startswith(y)
    for k, m, n, u in sorted(found):
        one = (m or "", (n or "").replace(" ", ""), u)
        if not any((u and u == o[2]) or one[0] == o[0] and (one[1] == o[1] or body(one[1]) and body(o[1]) and (ends(o[1], one[1]) or ends(one[1], o[1]))) for o in had):
            had.append(one)
            kept.append(k)
    return kept


def test_new_councils_equal_a_walk(spark):
    import random

    rng = random.Random(3)
    part = lambda: "".join(rng.choice(["甲", "乙", "総合", "特別"]) for _ in range(rng.randint(0, 3)))
    make = lambda: (rng.choice(["a", "b", None]), part() + rng.choice(["検討会", "委員会", "会議", "小委員会"]) if rng.random() < 0.97 else None, f"e.go.jp/{rng.randint(0, 150)}" if rng.random() < 0.8 else None)
    found, known = [(k, *make()) for k in range(400)], [make() for _ in range(15)]
    address = lambda u: None if u is None else f"https://{u}/"
    rows = spark.createDataFrame([(k, m, n, address(u), "x") for k, m, n, u in found], "k int, ministry string, name string, official_url string, place string")
    old = spark.createDataFrame([(m, n, address(u)) for m, n, u in known], "ministry string, name string, official_url string")
    got = discovery.keep_new(rows, old, ["k"])
    assert got.columns == rows.columns and sorted(r.k for r in got.collect()) == walked(found, known)
    assert discovery.keep_new(rows.limit(0), old, ["k"]).count() == 0 and discovery.keep_new(rows.limit(1), old.limit(0), ["k"]).count() == 1


def test_new_councils_with_many_copies(spark):
    """A third of all rows shares one name and address; chains of conflicts are decided in turn."""
    rows = spark.range(3000).select("id", F.lit("m").alias("ministry"), F.when(F.col("id") % 3 == 0, "甲検討会").otherwise(F.concat(F.lit("乙検討会"), "id")).alias("name"), F.when(F.col("id") % 3 == 0, "https://e.go.jp/x").otherwise(F.concat(F.lit("https://e.go.jp/"), F.floor(F.col("id") / 3 * 2))).alias("official_url"))
    got = sorted(r.id for r in discovery.keep_new(rows, rows.limit(0), ["id"]).collect())
    seen, want = set(), []
    for i in range(3000):
        u = "x" if i % 3 == 0 else int(i / 3 * 2)
        if u not in seen:
            seen.add(u)
            want.append(i)
    assert got == want


def test_moves_on_empty_and_repeated_targets(spark):
    councils = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    rejected = spark.createDataFrame([(2, "b", "x")], "id int, name string, reason string")
    none, twice = councils.limit(0), councils.filter("id = 2").union(councils.filter("id = 2"))
    left, gone = governance.reject(councils, rejected, none, "id", F.lit("y"))
    assert (left.count(), gone.count()) == (2, 1)
    left, gone = governance.reject(councils, rejected, twice, "id", F.lit("y"))
    assert [tuple(r) for r in left.collect()] == [(1, "a")] and [tuple(r) for r in gone.collect()] == [(2, "b", "x")]


def test_excluded_children(spark):
    children = spark.createDataFrame([("c", "https://e/a/1.pdf"), ("c", "https://e/b/1.pdf"), ("d", "https://e/a/1.pdf"), ("c", None)], "id string, url string")
    rules = spark.createDataFrame([("c", ["/a/"])], "id string, excluded array<string>")
    assert sorted((r.id, r.url or "") for r in governance.drop_children(children, rules, "id").collect()) == [("c", ""), ("c", "https://e/b/1.pdf"), ("d", "https://e/a/1.pdf")]
