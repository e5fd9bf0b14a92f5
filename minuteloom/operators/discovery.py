"""Discovery of councils: noise filters, admission of links, the newest pages of a portal, parent pages of press releases."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minuteloom.batches import spread
from minuteloom.functions import names, urls
from minuteloom.functions.titles import ends_any
from minuteloom.operators.analytics import first_per_key
from minuteloom.operators.quality import ROUND, contains_any
from minuteloom.rounds import cut, first_wins, settled

# What tells that a name is no council. Holders of office, what they do with others, other doings, foreign and other bodies, portal pages, endings and beginnings, files.
OFFICES = ("大臣", "副大臣", "政務官", "長官", "総理", "知事", "教授", "名誉教授", "代表", "委員")
ENCOUNTERS = ("会談", "面会", "意見交換", "表敬")
PRESENTED = ("意見交換", "研究課題発表")
DONE = ("を実施", "を行い")
DOINGS = ("大臣発言", "日本人初】")
OTHER_BODIES = (
    "世銀", "IMF", "FATF", "金融活動作業部会", "国際通貨金融委員会", "WTO", "CITES", "ワシントン条約", "生物多様性条約", "気候変動枠組条約", "締約国会議", "国連総会", "国連犯罪防止",
    "国連国際商取引", "国際かんがい排水", "日米合同委員会", "日米政府の戦略的投資", "日米サイバー", "日米加", "日・ベトナム", "日ロ漁業", "北太平洋漁業", "アジア・アフリカ法律",
    "アジア矯正", "海運先進国", "ウクライナ汚職", "世界保護司", "欧州委員会", "大韓民国", "フィンランド", "豪州政府", "プレCOP", "参議院", "衆議院", "自由民主党", "一般社団法人",
    "公益社団法人", "公益財団法人", "独立行政法人", "株式会社",
)
PORTALS = (
    "政策・審議会", "省議・審議会", "審議会・委員会", "審議会等", "政策・審議会等", "省議・審議会等", "政策・審議会等トップへ", "各種本部・会議等の活動情報", "本審議会 トップページ",
    "公害等調整委員会", "中央環境審議会", "法制審議会会議", "審議会情報", "度",
)
PAGE_ENDS = "(?:トップページ|トップへ|活動情報|主査ヒアリング|公聴会|意見募集)$"
PAGE_STARTS = "^(?:政策・審議会|省議・審議会|審議会・委員会|審議会等)"
FILES = r"(?i)\.(?:pdf|docx?|xlsx?|pptx?|jpe?g|png|gif|zip)$"
# Paths of press releases and press conferences.
PRESS_PATHS = ("/report/press/", "/j/press/", "/menu_news/s-news/", "/press/press_", r"/press/20\d{2}/", r"/news/20\d{2}/", "/b_menu/houdou/", r"/houdou/20\d{2}/", "/hisho/kouhou/", "/kaiken/", "/pressrelease/")
# News that never stands for a council: officers and their appearances, staff and purchases, consultations and their stages, publications at a title's end, measures, visits; files that hold none.
NEWS_OFFICES = ("大臣", "副大臣", "政務官", "長官", "総理")
APPEARANCES = ("記者会見", "会見", "動静", "出張", "談話", "挨拶", "コメント")
STAFF_AND_PURCHASES = ("人事異動", "幹部名簿", "採用情報", "職員採用", "公募結果", "入札公告", "一般競争入札", "調達情報", "落札者")
CONSULTATIONS, STAGES = ("パブリックコメント", "意見公募手続"), ("開始", "結果", "募集")
PUBLICATIONS, PUBLISHED = ("統計", "調査結果", "月例経済報告", "白書", "年次報告"), ("", "の公表", "について")
MEASURES = ("行政処分", "業務改善命令", "課徴金納付命令", "指名停止")
VISITS = ("表敬訪問", "表敬", "会談", "電話会談", "首脳会談", "外相会談")
FILES_OF_NO_COUNCIL = (".zip", ".xls", ".xlsx", ".csv", ".doc", ".docx", ".ppt", ".pptx")
# Words by which a name is that of a body, link words and paths of a council's own page.
BODY_WORDS = ("部会", "分科会", "小委員会", "委員会", "ワーキンググループ", "検討会", "研究会", "審査会", "専門家会合", "タスクフォース")
PAGE_WORDS = ("開催状況", "議事要旨", "配付資料", "議事録")
PAGE_PATHS = ("/council/", "/shingi/", "/kaigi/", "/seisaku/")


def _any(*conditions: Column) -> Column:
    return reduce(or_, [F.coalesce(c, F.lit(False)) for c in conditions])


def joined(text: Column, firsts, seconds) -> Column:
    """Whether one of the first words is followed at once by one of the second."""
    return contains_any(text, [a + b for a in firsts for b in seconds])


def followed(text: Column, firsts, seconds) -> Column:
    """Whether one of the second words stands anywhere behind one of the first."""
    return _any(*[contains_any(F.substring(text, F.locate(a, text) + len(a), F.length(text)), seconds) & F.contains(text, F.lit(a)) for a in firsts])


def is_noise(name: Column, raw: Column | None = None, url: Column | None = None, clean: Column | None = None) -> Column:
    """Whether a name is no council's. Null and short names (under 4 characters when cleaned) are noise. clean: the cleaned name, where it is a column already."""
    clean, said = names.clean_name(name) if clean is None else clean, F.trim(F.concat_ws(" ", name, *([] if raw is None else [raw])))
    tests = [F.length(clean) < 4, clean.isin(*PORTALS), F.trim(name).isin(*PORTALS), clean.rlike(PAGE_ENDS), clean.rlike(PAGE_STARTS), joined(said, OFFICES, ("が",)), followed(said, [f"{o}と" for o in OFFICES], ENCOUNTERS), joined(said, PRESENTED, DONE), contains_any(said, DOINGS), said.rlike(r"COP[0-9]"), contains_any(said, OTHER_BODIES)]
    return _any(*tests, *([] if url is None else [url.rlike(FILES)]))


def is_press_url(url: Column) -> Column:
    return _any(url.rlike("(?i)" + "|".join(PRESS_PATHS)))


def is_no_council_news(title: Column, url: Column) -> Column:
    """News that is plainly not about a council; a null or short title is such."""
    ends = [p + q for p in PUBLICATIONS for q in PUBLISHED]
    tests = [followed(title, NEWS_OFFICES, APPEARANCES), contains_any(title, STAFF_AND_PURCHASES), followed(title, CONSULTATIONS, STAGES), ends_any(title, ends), contains_any(title, MEASURES), joined(title, VISITS, DONE)]
    return _any(title.isNull(), F.length(F.trim(title)) < 4, ends_any(F.lower(url), FILES_OF_NO_COUNCIL), *tests)


def twins(found: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of found (ministry, name) that have a known name of the ministry as a proper ending, or are one of it; both name a body.

    Both names have four characters at least, so pairs meet on ministry and last four characters.
    """
    def keyed(rows, c):
        plain = F.regexp_replace("name", r"(?U)\s+", "")
        return rows.select("ministry", "name", plain.alias(c)).filter((F.length(c) >= 4) & contains_any(F.col(c), BODY_WORDS)).withColumn("tail", F.right(F.col(c), F.lit(4)))

    a, b = F.col("a"), F.col("b")
    ends = lambda x, y: F.endswith(x, y) & ~F.startswith(x, y)
    met = keyed(found, "a").join(keyed(known, "b").drop("name").distinct(), ["ministry", "tail"]).filter((a == b) | ends(a, b) | ends(b, a))
    return met.select("ministry", "name").distinct()


def _name_keys(rows: DataFrame, ministry: str, names_: list[str]) -> tuple[DataFrame, DataFrame]:
    """(probes, shows) of place and key: a name meets an earlier one that equals it, ends with it or is its end (then both name a body, have four characters and don't begin alike).

    names_: the columns of names that a row asks with; the first is the one that it shows. An end of a name is a key of its own, so a
    name has as many keys as characters and no two rows are ever paired.
    """
    plain = [F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "") for c in names_]
    said = rows.select("place", F.coalesce(F.upper(ministry), F.lit("")).alias("m"), *[p.alias(f"n{i}") for i, p in enumerate(plain)])
    key = lambda kind, s: F.concat_ws("\u0001", F.lit(kind), "m", s)
    # Proper ends of four characters at least that the name doesn't begin with.
    def ends(c):
        every = F.transform(F.when(F.length(c) > 4, F.sequence(F.lit(2), F.length(c) - 3)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(c, i, F.length(c)))
        return F.filter(every, lambda s: ~F.startswith(c, s) & contains_any(s, BODY_WORDS))

    def asked(c):
        long = (F.length(c) >= 4) & contains_any(F.col(c), BODY_WORDS)
        return F.concat(F.array(key("=", F.col(c))), F.when(long, F.array(key("<", F.col(c)))).otherwise(F.array().cast("array<string>")), F.transform(ends(F.col(c)), lambda s: key(">", s)))

    shown = F.col("n0")
    long = (F.length(shown) >= 4) & contains_any(shown, BODY_WORDS)
    shows = said.select("place", F.explode(F.concat(F.array(key("=", shown)), F.when(long, F.array(key(">", shown))).otherwise(F.array().cast("array<string>")), F.transform(ends(shown), lambda s: key("<", s)))).alias("key"))
    probes = said.select("place", F.explode(F.array_distinct(F.concat(*[asked(f"n{i}") for i in range(len(names_))]))).alias("key"))
    return probes, shows


def keep_new(found: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """Found councils that a walk in order admits: none that an address, or in its ministry a name or an end of a name, of a known or an earlier admitted one tells to be there already.

    found and known: ministry, name, official_url, and in found whatever else, `order` included, which tells rows apart. Addresses count in
    their clean form; rows without one differ in it from all. A name is asked for as it stands and cleaned. Null names are empty, and
    equal to each other. Rows of one ministry, name and address are one to the walk, so copies cost no more than one.
    """
    same = ["ministry", "name", "official_url"]
    first = found.groupBy(*same).agg(F.min_by(F.struct(*found.columns), F.struct(*order)).alias("row")).select("row.*")
    by = [F.col(c).asc() for c in order]
    placed = cut(first.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id()))
    asked = cut(placed.select("place", "ministry", F.coalesce("name", F.lit("")).alias("name"), names.clean_name(F.col("name")).alias("clean"), urls.clean_key(F.col("official_url")).alias("address")))
    stored = known.select(F.lit(-1).cast("long").alias("place"), "ministry", F.coalesce("name", F.lit("")).alias("name"), urls.clean_key(F.col("official_url")).alias("address"))
    probes, shows = _name_keys(asked, "ministry", ["name", "clean"])
    at = lambda rows: rows.filter("address <> ''").select("place", F.concat(F.lit("@\u0001"), "address").alias("key"))
    every = shows.unionByName(at(asked)).unionByName(_name_keys(stored, "ministry", ["name"])[1]).unionByName(at(stored))
    kept = first_wins(probes.unionByName(at(asked)), every, found.sparkSession.createDataFrame([(-1,)], "place long"))
    return placed.join(kept, "place", "left_semi").select(*found.columns)


def admit_links(links: DataFrame, known: DataFrame, keywords: list[str], excluded: list[str] = ()) -> DataFrame:
    """(ministry, position, name, url, category) of links that may be new councils; the first link of a core name in a ministry wins.

    links: ministry, position, text, url (absolute). known: ministry, name, official_url of registered and rejected councils.
    A link's text has 3 to 100 characters, a keyword and no excluded word; it is no noise, no press release, and no
    known council by URL, name, cleaned name, core name or ending. Null texts and urls are not admitted.
    """
    body = F.trim("text")
    fits = F.length(body).between(3, 100) & contains_any(body, keywords) & ~contains_any(body, excluded)
    rows = settled(spread(links.filter(fits & F.col("url").isNotNull() & ~is_press_url(F.col("url"))), "ministry", "position", "url"), said=names.clean_name(F.col("text")))
    rows = rows.filter(~is_noise(F.col("text"), None, F.col("url"), F.col("said")))
    rows = settled(rows, name=F.when(F.col("text").rlike(ROUND), F.col("said")).otherwise(body))
    rows = settled(rows, key=urls.clean_key(F.col("url")), clean=names.clean_name(F.col("name")), core=names.core_name(F.col("name")))
    rows = rows.filter((F.length("name") >= 4) & ~is_noise(F.col("name"), F.col("text"), F.col("url"), F.col("clean")))
    rows = rows.join(known.select(urls.clean_key(F.col("official_url")).alias("key")).distinct(), "key", "left_anti")
    stored = known.select("name").distinct()
    for c in ("name", "clean"):
        rows = rows.join(stored.withColumnRenamed("name", c), c, "left_anti")
    rows = rows.join(stored.select(names.core_name(F.col("name")).alias("core")).filter("core <> ''").distinct(), "core", "left_anti")
    near = twins(rows.select("ministry", F.explode(F.array("name", "clean")).alias("name")).distinct(), known)
    for c in ("name", "clean"):
        rows = rows.join(near.withColumnRenamed("name", c), ["ministry", c], "left_anti")
    first = first_per_key(rows, ["ministry", "core"], [F.asc("position"), F.asc("url")])
    return first.select("ministry", "position", "name", "url", names.category(F.concat_ws(" ", "name", "text")).alias("category"))


def recency(url: Column, text: Column, now: str) -> Column:
    """How new a portal's page is, as year and month in one number: from a menu of era years, YYYYMM, a year's index, a dated
    page in a year, a year in the path, a month in the link's text (of the last twelve), an era year; else 0."""
    today = F.lit(now).cast("date")
    part = lambda s, p, i=1: F.nullif(F.regexp_extract(s, p, i), F.lit("")).try_cast("int")
    plain, index, dated = F.regexp_replace(url, "[?#].*$", ""), r"/(20\d{2})(?:/(?:index\.html?)?)?$", r"/(20\d{2})/\d{2}(0[1-9]|1[0-2])\d{2}"
    month = part(text, r"(\d{1,2})月")
    year = F.year(today) - F.when(month > F.month(today), 1).otherwise(0)
    return F.coalesce(
        300_000 + part(url, r"(?i)\br(\d+)_news_menu"),
        part(url, r"(?<!\d)(20\d{2}(?:0[1-9]|1[0-2]))(?!\d)"),
        part(plain, index) * 100 + 99,
        part(url, dated) * 100 + part(url, dated, 2),
        part(url, r"/(20\d{2})(?:/|$)") * 100,
        F.when(month.between(1, 12), year * 100 + month),
        (2018 + part(url, r"(?i)\br(\d+)(?:[/_.]|$)")) * 100,
        F.lit(0),
    )


def resolve_portals(links: DataFrame, now: str) -> DataFrame:
    """(portal, rank, url): the pages to read of each portal. links: portal, pattern, position, url, text.

    Links that match the portal's pattern count, or, where none does, those that show this or the last month or year. The two newest
    are kept; a portal of era menus gives one (two in July), and portals of monthly or yearly pages stand
    before their newest page themselves. A portal without such a link is its own page.
    """
    today = F.lit(now).cast("date")
    era, month = F.year(today) - 2018, F.month(today)
    tokens = [F.date_format(today, "yyyyMM"), F.date_format(F.add_months(today, -1), "yyyyMM"), F.concat(F.lit("令和"), era), F.concat(F.lit("r"), era, F.lit("_")), F.concat(F.lit("/"), F.year(today)), F.concat(month, F.lit("月"))]
    shown = F.concat_ws(" ", F.translate("text", "０１２３４５６７８９", "0123456789"), "url")
    fit = F.coalesce(F.expr("regexp_like(url, pattern)"), F.lit(False)) & (F.coalesce("pattern", F.lit("")) != "")
    rows = links.withColumn("grade", F.when(fit, 2).when(_any(*[F.contains(shown, t) for t in tokens]), 1).otherwise(0))
    best = rows.groupBy("portal", "pattern", "url").agg(F.max("grade").alias("grade"), F.max(recency(F.col("url"), F.col("text"), now)).alias("score"), F.min("position").alias("position"))
    best = best.withColumn("top", F.max("grade").over(Window.partitionBy("portal"))).filter((F.col("grade") == F.col("top")) & (F.col("grade") > 0))
    ranked = first_per_key(best, ["portal"], [F.desc("score"), F.asc("position"), F.asc("url")], 2)
    two = ranked.groupBy("portal").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "position", "url"))).alias("found"))  # two at most
    each = links.groupBy("portal").agg(F.max("pattern").alias("pattern")).join(two, "portal", "left")
    pages, newest = F.transform("found", lambda x: x["url"]), -F.col("found")[0]["s"]
    has = lambda s: F.coalesce(F.contains("pattern", F.lit(s)), F.lit(False))
    with_portal = F.array_distinct(F.concat(F.array("portal"), F.slice(pages, 1, 1)))
    chosen = (
        F.when(F.col("found").isNull(), F.array("portal"))
        .when(has("news_menu"), F.slice(pages, F.lit(1), F.when(month == 7, 2).otherwise(1)))
        .when(has(r"\d{6}") & (newest < F.year(today) * 100 + month), with_portal)
        .when(has(r"\d{4}") & (pages[0] != F.col("portal")), with_portal)
        .otherwise(pages)
    )
    return each.select("portal", F.posexplode(chosen).alias("rank", "url"))


def parent_pages(links: DataFrame) -> DataFrame:
    """(press_url, parent_url): the page of the council that a press release names, else the release itself.

    links: press_url, name, position, url (absolute), text. A page of the same host, no release and no noise, scores 10 for the name in its
    text, 5 for a word and 3 for a path of council pages; the first of the highest from 5 on wins.
    """
    clean, text, url = F.col("__clean"), F.col("text"), F.col("url")
    # Pages say the same few things in many links: names and texts are judged once each. A null text is noise.
    named = settled(links.select("name").distinct(), __clean=names.clean_name(F.col("name")))
    said = settled(links.select("text").distinct(), __said=names.clean_name(text))
    said = settled(said.filter(~is_noise(text, clean=F.col("__said"))).select("text"), __word=contains_any(text, PAGE_WORDS))
    points = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    own = links.filter((urls.host(url) == urls.host(F.col("press_url"))) & ~is_press_url(url)).join(said, "text").join(named, "name", "left")
    score = points((clean != "") & F.contains(text, clean), 10) + points(F.col("__word"), 5) + points(contains_any(url, PAGE_PATHS), 3)
    best = first_per_key(own.withColumn("score", score).filter("score >= 5"), ["press_url"], [F.desc("score"), F.asc("position")])
    return links.select("press_url").distinct().join(best.select("press_url", F.col("url").alias("parent_url")), "press_url", "left").withColumn("parent_url", F.coalesce("parent_url", "press_url"))
