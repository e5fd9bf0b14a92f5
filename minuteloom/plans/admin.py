"""What administrators and the portal show besides: lists, verdicts, exports, folders, progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from minuteloom.batches import in_shares, tasks_for
from minuteloom.functions import text
from minuteloom.functions import vocabulary as v
from minuteloom.operators import admin, analytics, folders, portal, quality
from minuteloom.plans.base import query
from minuteloom.plans.crawl import _key, _pick, sql_has, sql_list
from minuteloom.rounds import kept
from minuteloom.schema import attempts, councils, materials, meetings, ministries, read
from minuteloom.sources import documents

def _list(spark, d):
    """Meetings as an administrator's list has them."""
    n = materials(spark, d).groupBy("meeting_id").agg(F.count("*").alias("n_materials"), F.collect_set("download_status").alias("url_statuses"))
    m = meetings(spark, d).join(councils(spark, d), "council_id").join(ministries(spark, d), "ministry").join(n, "meeting_id", "left")
    return m.select(
        "meeting_id", F.concat(F.lit("第"), _key() % 7, F.lit("回 "), F.col("label")).alias("name"), "council_name", F.date_format("date", "yyyy/MM/dd").alias("date"), "ministry", "ministry_name", "category",
        F.when(_key() % 3 > 0, (_key() % 7).cast("int")).alias("round"), (_key() % 11 == 0).alias("unconfirmed"), (F.col("flag") == "O").alias("is_new"), F.when(_key() % 5 == 0, F.date_format("date", "yyyy-MM-dd HH:mm")).alias("discovered_at"),
        F.lit(None).cast("string").alias("updated_at"), (F.col("flag") == "P").alias("locked"), "n_materials", F.lit("").alias("material_names"), "url_statuses",
    )


_LIST = """l AS (SELECT o_orderkey AS meeting_id, o_orderdate, o_orderstatus, o_orderpriority, c_name, n_name, c_nationkey, c_mktsegment, coalesce(n, 0) AS n, coalesce(f, false) AS f FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
 LEFT JOIN (SELECT l_orderkey, count(*) AS n, bool_or(l_linestatus = 'F') AS f FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) """


@query("WITH " + _LIST + "SELECT meeting_id FROM l WHERE contains(lower(o_orderpriority || ' ' || c_name || ' ' || strftime(o_orderdate, '%Y/%m/%d') || ' ' || n_name), 'high') AND c_mktsegment = 'BUILDING' AND n > 0 AND f")
def admin_meetings(spark, d):
    """By words, category, materials and the state of their links."""
    chosen = admin.MeetingFilter(search="HIGH", category="BUILDING", docs="has_docs", url_status="F")
    return admin.filter_meetings(_list(spark, d), chosen, "1999-09-16").select("meeting_id")


_AUTO = "(o_orderstatus = 'O' OR meeting_id % 5 = 0)"
_STATES = {
    "auto_unverified": f"{_AUTO} AND o_orderstatus <> 'P'",
    "auto_recent7": f"{_AUTO} AND (o_orderstatus = 'O' OR strftime(o_orderdate, '%Y/%m/%d') >= '1999/09/09')",
    "locked": "o_orderstatus = 'P'",
    "auto_anomaly": f"{_AUTO} AND o_orderstatus <> 'P' AND (n = 0 AND CAST(o_orderdate AS DATE) <= DATE '1999-09-16' OR meeting_id % 11 = 0)",
}


def _state(kind, condition):
    @query(f"WITH {_LIST} SELECT meeting_id FROM l WHERE {condition}", name=f"admin_{kind}")
    def run(spark, d):
        return admin.filter_meetings(_list(spark, d), admin.MeetingFilter(crawl=kind), "1999-09-16").select("meeting_id")


for _kind, _condition in _STATES.items():
    _state(_kind, _condition)


@query("SELECT c_custkey AS council_id FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal >= 0 AND c_custkey % 4 IN (0, 1) AND c_custkey % 3 IN (0, 1) AND contains(c_name || ' ' || n_name || ' ' || c_nationkey, '7')")
def admin_councils(spark, d):
    """Councils that aren't rejected, wait for a verdict, have no checked URL, and have a 7 in some name or number."""
    k = F.col("council_id")
    c = councils(spark, d).join(ministries(spark, d), "ministry").withColumns({"verdict": _pick(None, "pending", "approved", "rejected", by=k), "url_status": _pick(None, "", "ok", by=k)})
    return admin.filter_councils(c, c.filter("stored < 0"), "pending", "unverified", "7").select("council_id")


@query("""SELECT c_custkey AS council_id, CASE WHEN c_custkey % 9 IN (5, 8) THEN 'approved' ELSE 'rejected' END AS verdict, CASE c_custkey % 9 WHEN 0 THEN 'archive' WHEN 1 THEN 'ministry_top_page' WHEN 2 THEN 'index_page' WHEN 3 THEN 'no_public_host' WHEN 4 THEN 'single_file'
 WHEN 5 THEN 'approved_by_page' WHEN 6 THEN 'bad_status' WHEN 7 THEN 'missing_page' ELSE 'approved_by_name' END AS reason FROM customer WHERE c_acctbal >= 0 UNION ALL
 SELECT c_custkey, 'rejected', CASE c_custkey % 9 WHEN 0 THEN 'archive' WHEN 1 THEN 'ministry_top_page' WHEN 2 THEN 'index_page' ELSE 'registered' END FROM customer WHERE c_acctbal < 0""")
def verification(spark, d):
    """Verdicts by address, name and answer; poor councils are registered already."""
    k = F.col("council_id")
    path = lambda s: F.concat(F.lit("https://www.env.go.jp/"), k, F.lit(s))
    c = councils(spark, d).select(
        "council_id", _pick(F.concat(F.lit("検討会"), k), "環境省", "審議会一覧", F.concat(F.lit("部会"), k), F.concat(F.lit("部会"), k), F.concat(F.lit("懇親の場"), k), F.concat(F.lit("部会"), k), F.concat(F.lit("部会"), k), F.concat(F.lit("研究会"), k), by=k).alias("name"),
        _pick(F.concat(F.lit("https://warp.ndl.go.jp/"), k), "https://www.env.go.jp/", path("/list"), F.concat(F.lit("https://e.example.com/"), k), path("/a.pdf"), path("/"), path("/b"), path("/c"), path("/d"), by=k).alias("official_url"),
        F.when(k % 9 == 6, 500).when(k % 9 != 8, 200).alias("status"), F.when(k % 9 == 7, "ページが見つかりません").otherwise("政策の会議").alias("body"), "stored",
    )
    registered = c.filter("stored < 0 and council_id % 9 not in (1, 2)").select("name", "official_url")
    return admin.verify(c.drop("stored"), registered, ["一覧$"]).select("council_id", "verdict", "reason")


@query("SELECT c_custkey AS council_id, CASE WHEN c_custkey % 2 = 0 THEN 'approved' ELSE c_mktsegment END AS status FROM customer")
def applied_verdicts(spark, d):
    c = councils(spark, d).select("council_id", F.col("category").alias("status"))
    return admin.apply_verdicts(c, c.filter("council_id % 2 = 0").select("council_id", F.lit("approved").alias("verdict")), "council_id")


_PART = "SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'A人 ' ELSE '' END || p_name AS name, p_partkey % 3 <> 2 AS changed FROM part"


def _texts(spark, d):
    k = F.col("p_partkey")
    return read(spark, d, "part").select(k.alias("k"), F.concat(_pick("Ａ⼈　", " ", "", by=k), F.col("p_name")).alias("name"))


@query(_PART)
def normalised_batch(spark, d):
    """Names with wide letters, radicals and blanks, normalised, and which of them changed."""
    return admin.normalise(_texts(spark, d), ["name"])


@query("SELECT CAST(count_if(p_partkey % 3 <> 2) AS BIGINT) AS changed, CAST(count_if(p_partkey % 3 = 0) AS BIGINT) AS radicals_before, 0::BIGINT AS radicals_after FROM part")
def normalised_stats(spark, d):
    rows = _texts(spark, d)
    return admin.normalise_stats(rows, admin.normalise(rows, ["name"]), ["name"])


@query("""SELECT 'n' || lower(replace(n_name, ' ', '')) || '-' || c_custkey % 50 AS id, upper('n' || replace(n_name, ' ', '')) AS ministry, max(c_custkey) AS seq, arg_max(c_mktsegment, c_custkey) AS reason FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal < 5000 GROUP BY 1, 2""")
def rejected_table(spark, d):
    """The table of rejected councils anew: the last row of each id, with the ministry of its id."""
    c = councils(spark, d).join(ministries(spark, d), "ministry").filter("stored < 5000")
    k = F.col("council_id")
    rows = c.select(F.concat(F.lit("n"), F.lower(F.replace("ministry_name", F.lit(" "), F.lit(""))), F.lit("-"), k % 50).alias("id"), F.lit("?").alias("ministry"), k.alias("seq"), F.col("category").alias("reason"))
    return admin.replace_rejected(rows, "seq")


@query("SELECT c_custkey AS council_id, CASE c_custkey % 3 WHEN 0 THEN '1999/12/31' WHEN 1 THEN '2000/02/28' ELSE '2000/03/07' END AS since FROM customer")
def crawl_marks(spark, d):
    """From when on each source is read anew: the day before its last crawl, else three days ago."""
    k = F.col("council_id")
    return admin.since(councils(spark, d).select(k, _pick("2000-01-01 05:00:00", "2000/02/29", "never", by=k).alias("last_crawl")), "2000-03-10").select("council_id", "since")


@query("SELECT event_id AS log_id, event_type AS kind FROM events WHERE event_id > (SELECT max(event_id) - 25 FROM events)")
def log_poll(spark, d):
    """The lines behind the last one that was read."""
    log = read(spark, d, "events").select(F.col("event_id").alias("log_id"), F.col("event_type").alias("kind"))
    return admin.new_lines(log, log.agg(F.max("log_id")).first()[0] - 25)


@query("SELECT o_orderkey AS meeting_id, o_orderkey AS row FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def incremental_page(spark, d):
    """Two steps of a list that grows by a hundred rows, newest first."""
    return meetings(spark, d).orderBy(F.desc("date"), "meeting_id").limit(200).select("meeting_id", _key().alias("row"))


@query("SELECT o_orderkey AS meeting_id FROM orders WHERE o_orderdate >= TIMESTAMP '2000-06-01' ORDER BY o_orderkey LIMIT 30")
def report_head(spark, d):
    """The first thirty new ids of a report."""
    return meetings(spark, d).filter("date >= timestamp '2000-06-01'").orderBy("meeting_id").limit(30).select("meeting_id")


@query("SELECT o_orderkey AS meeting_id FROM orders WHERE o_orderdate >= DATE '2001-08-01' - INTERVAL 730 DAY AND o_orderstatus = 'F'")
def segment_overlaps(spark, d):
    """Meetings that the active part of an export has and an older archive, of closed ones, as well."""
    rows = meetings(spark, d).select("meeting_id", F.date_format("date", "yyyy/MM/dd").alias("date"), "flag")
    return documents.overlaps(documents.public_view(rows, "2001-08-01").filter("segment = 'active'"), rows.filter("flag = 'F'"), "meeting_id")


@query("SELECT l_orderkey AS meeting_id, count(*) AS n FROM lineitem WHERE l_linenumber % 4 NOT IN (0, 1) GROUP BY 1")
def shown_materials(spark, d):
    """Materials without those that lead back to the meeting's page or the source."""
    n = F.col("line")
    own = F.concat(F.lit("https://e.go.jp/"), _key())
    one = F.struct(_pick("資料", "公式ページへ", "資料2", None, by=n).alias("name"), F.when(n % 4 == 0, own).otherwise(F.concat(own, F.lit("/"), n)).alias("url"))
    lists = materials(spark, d).groupBy("meeting_id").agg(F.collect_list(one).alias("materials"))
    return lists.select("meeting_id", F.size(portal.shown_materials(F.col("materials"), own)).cast("long").alias("n")).filter("n > 0")


@query("SELECT n_nationkey AS ministry, CASE n_nationkey % 5 WHEN 0 THEN '府・省' WHEN 1 THEN '庁' WHEN 2 THEN '委員会' WHEN 3 THEN '府・省' ELSE 'その他' END AS ministry_group FROM nation")
def ministry_groups(spark, d):
    k = F.col("ministry")
    return ministries(spark, d).select(k, portal.ministry_group(F.concat("ministry_name", _pick("省", "庁", "委員会", "府", "本部", by=k))).alias("ministry_group"))


@query("SELECT c_custkey AS council_id FROM customer WHERE c_custkey % 3 <> 1")
def visible_councils(spark, d):
    return portal.visible(councils(spark, d).withColumn("status", _pick(None, "pending", "approved", by=F.col("council_id")))).select("council_id")


@query("""SELECT o_orderkey AS meeting_id, x AS shown, n_name || ' 「' || c_name || '」 ' || o_orderpriority || ' (' || x || ') u' AS citation FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN '開催日不明' ELSE strftime(o_orderdate, '%Y/%m/%d') END AS x FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)""")
def citations(spark, d):
    m = meetings(spark, d).join(councils(spark, d), "council_id").join(ministries(spark, d), "ministry")
    day = F.when(_key() % 3 == 0, "2099/01/01").otherwise(F.date_format("date", "yyyy-MM-dd"))
    return m.select("meeting_id", portal.shown_date(day).alias("shown"), portal.citation(F.col("ministry_name"), F.col("council_name"), F.col("label"), day, F.lit("u")).alias("citation"))


@query("""SELECT o_orderkey AS meeting_id, '"' || strftime(o_orderdate, '%Y/%m/%d') || '","' || n_name || '","' || c_name || '","' || CASE WHEN o_orderkey % 2 = 0 THEN '''=""x""' ELSE o_orderpriority END || '","' || coalesce(n, 0) || '","https://e.go.jp/' || o_orderkey || '",""' AS line
 FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def csv_lines(spark, d):
    """The seven columns of the meeting export as CSV lines."""
    n = materials(spark, d).groupBy("meeting_id").agg(F.count("*").alias("n"))
    m = meetings(spark, d).join(councils(spark, d), "council_id").join(ministries(spark, d), "ministry").join(n, "meeting_id", "left")
    rows = m.select("meeting_id", F.date_format("date", "yyyy/MM/dd").alias("day"), "ministry_name", "council_name", F.when(_key() % 2 == 0, '="x"').otherwise(F.col("label")).alias("name"), F.coalesce("n", F.lit(0)).alias("n"), F.concat(F.lit("https://e.go.jp/"), _key()).alias("url"), F.lit(None).cast("string").alias("summary"))
    return documents.csv_lines(rows, ["day", "ministry_name", "council_name", "name", "n", "url", "summary"]).select("meeting_id", "line")


@query("""SELECT o_orderkey AS meeting_id, '{"id":' || o_orderkey || ',"date":"' || strftime(o_orderdate, '%Y/%m/%d') || '","materials":' || coalesce(n, 0) || CASE WHEN o_orderkey % 2 = 0 THEN ',"label":"' || o_orderpriority || '"' ELSE '' END || '}' AS json
 FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def json_lines(spark, d):
    """The meeting export as JSON objects; what is null is left out."""
    n = materials(spark, d).groupBy("meeting_id").agg(F.count("*").alias("n"))
    m = meetings(spark, d).join(n, "meeting_id", "left")
    one = F.struct(_key().alias("id"), F.date_format("date", "yyyy/MM/dd").alias("date"), F.coalesce("n", F.lit(0)).alias("materials"), F.when(_key() % 2 == 0, F.col("label")).alias("label"))
    return m.select("meeting_id", F.to_json(one).alias("json"))


@query("""SELECT o_orderkey AS meeting_id, o_orderstatus = 'P' OR o_orderkey % 7 = 0 AS manual_lock, CASE WHEN o_orderkey % 2 = 0 THEN '2026/01/01' END AS discovered_at, coalesce(n, 0) AS n_materials, coalesce(l, 0) AS n_locked, coalesce(w, 0) AS n_downloaded
 FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, CAST(count_if(l_linenumber = 1) AS BIGINT) AS l, CAST(count_if(l_linestatus = 'F') AS BIGINT) AS w FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def full_scan(spark, d):
    """All meetings with locks, crawl marks and download states laid over them."""
    m = meetings(spark, d).select("meeting_id", (F.col("flag") == "P").alias("manual_lock"))
    p = materials(spark, d).select("meeting_id", F.col("line").cast("string").alias("url"), F.when(F.col("download_status") == "F", "downloaded").alias("download_status"))
    locked = p.filter("url = '1'").select(F.concat_ws(":", "meeting_id", "url").alias("id"))
    marks = m.filter(_key() % 2 == 0).select("meeting_id", F.lit("2026/01/01").alias("discovered_at"))
    return documents.full_scan(m, p, m.filter(_key() % 7 == 0).select(_key().alias("id")), locked, marks)


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT event_id AS seq, row_number() OVER (ORDER BY turn, n DESC, user_id) AS place FROM a""")
def interleave_order(spark, d):
    """Places in a round-robin over councils, in each turn the larger ones first."""
    return analytics.interleave(attempts(spark, d), "council_id", ["ts", "seq"]).select("seq", "place")


def _folders(spark, d):
    """Canonical folders of all meetings, and the folders that are there."""
    m = meetings(spark, d).join(councils(spark, d).select("council_id", "council_name"), "council_id")
    title = F.concat(F.lit("第"), _key() % 9 + 1, F.lit("回 "), F.col("council_name"))
    own = m.select("meeting_id", "council_id", title.alias("name"), F.date_format("date", "yyyy/MM/dd").alias("date"))
    canonical = folders.canonical_folders(own, councils(spark, d), ministries(spark, d))
    return canonical, _there(canonical)


def _there(canonical):
    """The folders that are there: of five kinds by the meeting's number."""
    stray = F.concat("day", F.lit("_x"), _key(), F.when(_key() % 2 == 0, F.concat(F.lit("第"), _key() % 9 + 1, F.lit("回"))).otherwise(""))
    return canonical.select(*folders.PLACE, _pick(F.col("folder"), F.col("folder"), stray, stray, folders.PERMANENT).alias("folder"), (_key() % 5).isin(0, 2).cast("int").alias("files"), "meeting_id")


def _made_folders(spark, d):
    """The same, made once and in tasks of a bounded share of meetings: for what reads them several times."""
    canonical = kept(in_shares(_folders(spark, d)[0], tasks_for(meetings(spark, d))))
    return canonical, _there(canonical)


_CANON = "c AS (SELECT o_orderkey AS k, n_name AS ministry_dir, c_name AS council_dir, strftime(o_orderdate, '%Y%m%d') AS day, '第' || (o_orderkey % 9 + 1) || '回' AS t FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey) "


@query("WITH " + _CANON + "SELECT k AS meeting_id, ministry_dir, council_dir, day || '_' || t AS folder, day FROM c")
def canonical_folders(spark, d):
    """The folder that each meeting should have."""
    return _folders(spark, d)[0]


@query("WITH " + _CANON + "SELECT DISTINCT ministry_dir, council_dir, CASE WHEN k % 5 = 1 THEN day || '_' || t ELSE day || '_x' || k || CASE WHEN k % 2 = 0 THEN t ELSE '' END END AS folder, CASE k % 5 WHEN 1 THEN 'empty' WHEN 2 THEN 'undefined' ELSE 'undefined_and_empty' END AS reason FROM c WHERE k % 5 IN (1, 2, 3)")
def folder_targets(spark, d):
    """Folders that no meeting has, that are empty, or both."""
    canonical, there = _folders(spark, d)
    return folders.cleanup_targets(there.select(*folders.PLACE, "folder", "files").distinct(), canonical)


@query("WITH " + _CANON + """, s AS (SELECT ministry_dir, council_dir, day, k, day || '_x' || k || CASE WHEN k % 2 = 0 THEN t ELSE '' END AS folder FROM c WHERE k % 5 = 2), f AS (SELECT ministry_dir, council_dir, day, t, min(k) AS k FROM c GROUP BY ALL),
 r AS (SELECT s.ministry_dir, s.council_dir, s.folder, s.day || '_' || f.t AS target, row_number() OVER (PARTITION BY s.k ORDER BY contains(s.folder, f.t) DESC, CASE WHEN NOT contains(s.folder, f.t) AND s.k % 3 = 0 AND f.k % 5 = 0 THEN 0 ELSE 1 END, f.k) AS n FROM s JOIN f USING (ministry_dir, council_dir, day))
 SELECT ministry_dir, council_dir, folder, target FROM r WHERE n = 1""")
def folder_choices(spark, d):
    """Where the files of an undefined folder belong: by its name, by a file that is there, else to the day's first meeting."""
    canonical, there = _made_folders(spark, d)
    stray = there.filter(_key() % 5 == 2)
    files = stray.select(*folders.PLACE, "folder", F.when(_key() % 3 == 0, "shared.pdf").otherwise(F.concat(F.lit("own"), _key(), F.lit(".pdf"))).alias("file"))
    # Canonical folders whose first meeting is the fifth of five hold a file of the same name.
    first = canonical.groupBy(*folders.PLACE, "folder").agg(F.min("meeting_id").alias("meeting_id")).filter(_key() % 5 == 0)
    files = files.unionByName(first.select(*folders.PLACE, "folder", F.lit("shared.pdf").alias("file")))
    files = kept(in_shares(files, tasks_for(canonical)))
    expected = spark.createDataFrame([], "meeting_id long, material string")
    return folders.choose_canonical(stray.select(*folders.PLACE, "folder"), files, canonical, expected)


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linenumber % 2 AS same FROM lineitem), y AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, same ORDER BY l_linenumber) AS r FROM x)
 SELECT l_orderkey AS meeting_id, l_linenumber AS line, CASE WHEN same = 1 OR r > 1 THEN 'delete' ELSE 'move' END AS action, CASE WHEN same = 1 OR r > 1 THEN NULL ELSE 'f_alt' || row_number() OVER (PARTITION BY l_orderkey, same = 1 OR r > 1 ORDER BY l_linenumber) || '.pdf' END AS new_name FROM y""")
def folder_merge(spark, d):
    """Materials of a meeting, each from a folder of its own, into one where a file of their name is: equal contents go, others move under new names."""
    k, n, flag = F.col("meeting_id"), F.col("line"), F.col("type")
    content = F.when(n % 2 == 1, F.lit("there")).otherwise(F.concat(F.lit("c"), flag))
    lines = materials(spark, d)
    own = lines.select(k.cast("string").alias("ministry_dir"), F.lit("c").alias("council_dir"), F.lpad(n.cast("string"), 2, "0").alias("folder"), F.lit("f.pdf").alias("file"), F.lit(1).alias("size"), content.alias("digest"))
    there = own.select("ministry_dir", "council_dir").distinct().select("*", F.lit("t").alias("folder"), F.lit("f.pdf").alias("file"), F.lit(1).alias("size"), F.lit("there").alias("digest"))
    chosen = own.select(*folders.PLACE, "folder").distinct().withColumn("target", F.lit("t"))
    plan = folders.merge_plan(own.unionByName(there), chosen, lines)
    return plan.select(F.col("ministry_dir").cast("long").alias("meeting_id"), F.col("folder").cast("int").alias("line"), "action", "new_name")


@query("""SELECT o_orderkey AS meeting_id, CASE WHEN o_orderkey % 7 = 0 THEN 'drop' WHEN o_orderkey % 5 = 0 THEN 'crawl' WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'O' THEN 'direct' WHEN o_orderpriority = '5-LOW' THEN 'crawl' WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'direct' ELSE 'crawl' END AS route FROM orders""")
def news_route(spark, d):
    """Where each news item goes."""
    n = materials(spark, d).groupBy("meeting_id").agg(F.count("*").alias("n"))
    m = meetings(spark, d).join(n, "meeting_id", "left")
    route = quality.news_route(_key() % 7 != 0, _key() % 5 == 0, _key() % 3 == 0, F.col("flag") == "O", F.col("label") == "5-LOW", F.coalesce("n", F.lit(0)), _key() % 2 == 1)
    return m.select("meeting_id", route.alias("route"))


_SAID = ("第3回 成長検討会", "成長検討会", "資料一覧", "議事録", "Index", "開催結果", "議事次第詳細", "資料について", "第 12 回", "会議資料", " 配布資料詳細 ", "目次")


@query(rf"""WITH m AS (SELECT o_orderkey AS k, c_custkey AS c, coalesce(n, 0) AS n, trim({sql_list(_SAID)}[CAST(o_orderkey % {len(_SAID)} AS INT) + 1]) AS name, CASE WHEN o_orderkey % 7 = 0 THEN '2099/01/01' WHEN o_orderkey % 7 = 1 THEN '' WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day
  FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1) ON l_orderkey = o_orderkey),
 x AS (SELECT *, day NOT IN ('', '2099/01/01') AND replace(day, '-', '/') > '1999/09/16' AS ahead FROM m)
 SELECT k AS meeting_id, concat_ws(',', CASE WHEN day IN ('', '2099/01/01') OR k % 11 = 0 THEN 'unconfirmed_date' END, CASE WHEN (k % 5 = 0 OR k % 4 = 1) AND NOT regexp_matches(name, '第\s*[0-9]+\s*回') THEN 'missing_round' END, CASE WHEN n = 0 AND NOT ahead THEN 'no_materials' END,
  CASE WHEN name = '成長検討会' AND k % 13 <> 0 THEN 'identical_to_council' END, CASE WHEN name IN ('資料一覧', '議事録', 'Index', '開催結果', '議事次第詳細', '会議資料', '配布資料詳細', '目次') THEN 'generic_title' END, CASE WHEN k % 17 IN (0, 1) AND n = 0 AND NOT ahead THEN 'same_as_council_url' END) AS codes FROM x""")
def anomalies(spark, d):
    """What looks wrong in each meeting: rounds told by names and by ids, stock titles, days to come, none and unknown, addresses with and without a slash."""
    n = materials(spark, d).filter(_key() % 3 != 0).groupBy("meeting_id").agg(F.count("*").alias("n"))
    m = meetings(spark, d).join(councils(spark, d), "council_id").join(n, "meeting_id", "left")
    k = _key()
    day = F.when(k % 7 == 0, "2099/01/01").when(k % 7 == 1, "").when(k % 2 == 0, F.date_format("date", "yyyy/MM/dd")).otherwise(F.date_format("date", "yyyy-MM-dd"))
    row = {
        "id": F.concat(F.lit("c-x-20240101-"), F.when(k % 4 == 1, "s01").otherwise("001")), "unconfirmed": k % 11 == 0, "round": F.when(k % 5 != 0, 1), "materials": F.col("n"), "date": day, "name": F.element_at(F.array(*map(F.lit, _SAID)), (k % len(_SAID)).cast("int") + 1),
        "council_name": F.when(k % 13 == 0, F.lit(None)).otherwise(" 成長検討会"), "url": _pick("https://e.go.jp/c/", "https://e.go.jp/c", *["https://e.go.jp/c/x"] * 15, by=k), "council_url": F.lit("https://e.go.jp/c"),
    }
    return m.select("meeting_id", F.array_join(quality.meeting_anomalies(row, "1999-09-16"), ",").alias("codes"))


@query("""SELECT l_orderkey AS meeting_id, l_linenumber AS line, CAST(CASE WHEN l_linenumber % 3 = 1 THEN 100 + l_linenumber ELSE 0 END AS BIGINT) AS file_size, CASE WHEN l_linenumber % 3 = 1 THEN 'downloaded' ELSE 'pending' END AS download_status FROM lineitem""")
def local_files(spark, d):
    """Download states anew from the files that are there: present, empty, or missing."""
    place = F.concat_ws("/", "meeting_id", "line")
    rows = materials(spark, d).select("meeting_id", "line", place.alias("local_path"), F.lit(9).cast("long").alias("file_size"), F.lit("downloaded").alias("download_status"))
    files = rows.filter("line % 3 <> 0").select(F.col("local_path").alias("path"), F.when(F.col("line") % 3 == 1, 100 + F.col("line")).otherwise(0).cast("long").alias("length"))
    return documents.sync_local_files(rows, files).select("meeting_id", "line", "file_size", "download_status")


@query("SELECT 5 AS newly_failed, count(*) AS before, CAST(count_if(o_orderstatus <> 'F') AS BIGINT) AS after, 'ministries_failed' || CASE WHEN CAST(count_if(o_orderstatus <> 'F') AS BIGINT) < 0.95 * count(*) THEN ',shrunk' ELSE '' END AS codes FROM orders")
def breaker(spark, d):
    """The verdict on a run from its counts."""
    from minuteloom.operators.merge import breaker as verdict

    n = meetings(spark, d).agg(F.count("*").alias("before"), F.count_if(F.col("flag") != "F").alias("after")).first()
    return spark.createDataFrame([(5, n.before, n.after, ",".join(verdict(5, n.before, n.after, 100, 0)))], "newly_failed int, before long, after long, codes string")


@query("""SELECT doc_id, length(text) - length(regexp_replace(text, '[⺀-⻳⼀-⿕]', '', 'g')) + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS n FROM documents WHERE text IS NOT NULL""")
def radical_counts(spark, d):
    """Radicals in each document's text; every third one has one more."""
    said = F.concat("text", F.when(F.col("doc_id") % 3 == 0, "⼈").otherwise(""))
    return read(spark, d, "documents").filter("text is not null").select("doc_id", text.radical_count(said).cast("long").alias("n"))


@query("""WITH x AS (SELECT o_orderkey AS meeting_id, o_orderkey % 3 AS materials, (o_orderkey // 3) % 2 AS dates, (o_orderkey // 6) % 2 AS subpages, (o_orderkey // 12) % 2 AS withm, (o_orderkey // 24) % 2 AS generic FROM orders)
 SELECT meeting_id, CASE WHEN subpages > 0 AND withm > 0 THEN 'success' WHEN subpages > 0 THEN 'partial' WHEN materials > 0 AND dates > 0 THEN CASE WHEN generic = 1 THEN 'partial' ELSE 'success' END WHEN materials > 0 OR dates > 0 THEN 'partial' ELSE 'failed' END AS verdict FROM x""")
def crawl_verdicts(spark, d):
    """The verdict on each meeting's page, by what it gave."""
    part = lambda step, n: F.floor(_key() / step) % n
    return meetings(spark, d).select("meeting_id", quality.crawl_verdict(part(1, 3), part(3, 2), part(6, 2), part(12, 2), part(24, 2) == 1).alias("verdict"))


@query("SELECT c_custkey AS council_id, regexp_matches(x, '^[a-z0-9]+-[a-z0-9_]+$') AS is_council, regexp_matches(y, '^[a-z0-9]+-[a-z0-9_]+-\\d{8}-(\\d{3,4}|[a-z]\\d{2,3})$') AS is_meeting, CASE WHEN c_custkey % 3 = 0 THEN 'MOE' ELSE 'CAS' END AS ministry FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'env-' ELSE 'cas-' END || CASE WHEN c_custkey % 2 = 0 THEN 'a_' ELSE 'A' END || c_custkey AS x, x || '-20260401-' || CASE c_custkey % 5 WHEN 0 THEN '001' WHEN 1 THEN 's01' WHEN 2 THEN '1' ELSE '0001' END AS y FROM customer)")
def identifier_rules(spark, d):
    k = F.col("council_id")
    x = F.concat(F.when(k % 3 == 0, "env-").otherwise("cas-"), F.when(k % 2 == 0, "a_").otherwise("A"), k)
    y = F.concat(x, F.lit("-20260401-"), _pick("001", "s01", "1", "0001", "0001", by=k))
    return councils(spark, d).select(k, text.is_council_id(x).alias("is_council"), text.is_meeting_id(y).alias("is_meeting"), text.ministry_of(x).alias("ministry"))


_JUNK = (*v.STANDING_PAPERS, *v.NAVIGATION, *v.LINK_TEXTS, *v.TITLES_ALONE, *v.TITLES_ANYWHERE, *v.TITLES_SHORT, "報告書", "活動状況", "視察概要", "メニュー開閉", "監査機関フォーラム", "成長", "")


@query(rf"""WITH k AS (SELECT o_orderkey AS meeting_id, {sql_list(_JUNK)}[CAST(o_orderkey % {len(_JUNK)} AS INT) + 1] AS w, CAST(o_orderkey // {len(_JUNK)} AS BIGINT) AS j FROM orders),
 n AS (SELECT *, j % 4 = 3 AS undated, CASE j % 3 WHEN 0 THEN '' WHEN 1 THEN '2．' ELSE '第3回 ' END || w || CASE j % 5 WHEN 0 THEN '' WHEN 1 THEN ' (開催日不明)' WHEN 2 THEN 'の記録' WHEN 3 THEN '検討会 (開催日不明)' ELSE '' END AS said FROM k),
 c AS (SELECT *, trim(said) AS name, trim(regexp_replace(trim(regexp_replace(trim(said), '\s*\([^)]*開催日不明[^)]*\)$', '')), '^[0-9０-９一二三四五六七八九十]+[．.、\s]+', '')) AS core, regexp_matches(said, '第\s*[0-9]+\s*回') AS numbered FROM n),
 g AS (SELECT *, {sql_has("core", (*v.TITLES_ALONE, *v.TITLES_ANYWHERE, *v.TITLES_SHORT))} OR core = '' OR regexp_matches(core, '^[0-9０-９]+\s*[.．]\s*({"|".join(v.NUMBERED_SUBJECTS)})') OR contains(core, '機関フォーラム') AS stock FROM c)
 SELECT meeting_id, CASE WHEN NOT numbered AND ({sql_has("core", v.STANDING_PAPERS)} OR regexp_matches(name, '報告書|活動状況|視察概要|名簿')) THEN 'standing_document' WHEN NOT numbered AND ({sql_has("core", v.NAVIGATION)} OR regexp_matches(name, 'メニュー開閉|政策情報（会議・統計等）|会議・委員会等') OR contains(core, '機関フォーラム')) THEN 'navigation'
  WHEN NOT numbered AND (list_contains({sql_list(v.LINK_TEXTS)}, core) OR list_contains({sql_list(v.LINK_TEXTS)}, name)) THEN 'link_text' WHEN undated AND stock THEN 'generic_undated' WHEN undated AND NOT numbered AND contains(name, '開催日不明') THEN 'undated_placeholder' END AS reason FROM g""")
def junk_reasons(spark, d):
    """Why a row is no meeting: every word of every rule, behind list numbers and rounds, with and without a day."""
    w = F.element_at(F.array(*map(F.lit, _JUNK)), (_key() % len(_JUNK)).cast("int") + 1)
    j = F.floor(_key() / len(_JUNK))
    name = F.concat(_pick("", "2．", "第3回 ", by=j), w, _pick("", " (開催日不明)", "の記録", "検討会 (開催日不明)", "", by=j))
    return meetings(spark, d).select("meeting_id", quality.junk_reason(name, F.lit("2026/01/01"), j % 4 == 3, F.array(F.lit("機関フォーラム"))).alias("reason"))


_QUEUE = """a AS (SELECT event_id AS seq, CASE WHEN user_id % 3 = 0 THEN -1 ELSE user_id END AS host, ts FROM events),
 t AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts, seq) AS turn, count(*) OVER (PARTITION BY host) AS n FROM a), q AS (SELECT seq, host, row_number() OVER (ORDER BY turn, n DESC, host) AS place FROM t)"""


@query(f"""WITH {_QUEUE}, l AS (SELECT *, host <> (SELECT arg_max(host, place) FROM q) AS other FROM q), s AS (SELECT coalesce(max(place) FILTER (WHERE other), 0) AS start, count(*) AS n FROM l),
 g AS (SELECT *, CASE WHEN other AND coalesce(lag(other) OVER (ORDER BY place), false) THEN 1 ELSE 0 END AS gap FROM l), c AS (SELECT *, sum(gap) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS gaps, sum(gap) OVER () AS total FROM g),
 f AS (SELECT c.*, greatest(0, gaps - greatest(0, total - greatest(0, n - start - 1))) AS filled, place - start - 1 AS move FROM c, s)
 SELECT f.seq, CAST(CASE WHEN f.move >= 1 THEN coalesce(h.place + h.filled - 1, f.place) ELSE f.place + f.filled END AS BIGINT) AS place FROM f LEFT JOIN f AS h ON h.gap = 1 AND f.move >= 1 AND h.total - h.gaps + 1 = f.move""")
def repaired_queue(spark, d):
    """A round-robin queue in which one host has a third of all: its last ones fill the gaps before them."""
    from minuteloom.operators.analytics import interleave, part_neighbours

    rows = attempts(spark, d).select("seq", "ts", F.when(F.col("council_id") % 3 == 0, -1).otherwise(F.col("council_id")).alias("host"))
    return part_neighbours(interleave(rows, "host", ["ts", "seq"]).select("seq", "host", "place"), "host").select("seq", F.col("repaired").alias("place"))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey % 40, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderkey % 3 <> 0),
 u AS (SELECT o_custkey % 40 AS c, o_orderstatus AS s, list(DISTINCT o_orderkey % 90 // 3 + 1) AS used FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2)
 SELECT o_orderkey AS meeting_id, [x for x in range(1, 100000) if NOT list_contains(coalesce(used, []), x)][r] AS number FROM o LEFT JOIN u ON c = o_custkey % 40 AND s = o_orderstatus""")
def free_numbers(spark, d):
    """New meetings get the least running numbers that the stored ones of their council and kind leave."""
    from minuteloom.rounds import free_numbers as allot

    m = meetings(spark, d).select("meeting_id", (F.col("council_id") % 40).alias("council"), "flag", "date")
    taken = m.filter(_key() % 3 == 0).select("council", "flag", F.floor(_key() % 90 / 3 + 1).alias("number"))
    return allot(m.filter(_key() % 3 != 0), taken, ["council", "flag"], [F.asc("date"), F.asc("meeting_id")]).select("meeting_id", "number")
