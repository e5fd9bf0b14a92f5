"""The whole dataset: seeding, syncing, reports, bundles, download queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from minuteloom.batches import sized
from minuteloom.functions import names
from minuteloom.operators import folders, store
from minuteloom.plans.base import query
from minuteloom.plans.crawl import _key, _pick
from minuteloom.schema import councils, materials, meetings, ministries, read

_OLD, _NEW = "date < timestamp '2000-06-01'", "date >= timestamp '1999-06-01'"
_DAY = "strftime(o_orderdate, '%Y/%m/%d')"


def _lines(spark, d):
    """Materials with one row for each number, as keys ask for."""
    return sized(materials(spark, d), "meeting_id").groupBy("meeting_id", "line").agg(F.min("type").alias("type"), F.min("download_status").alias("download_status"))


def _tables(spark, d):
    """Stored: councils that aren't poor, older meetings, materials with a file or a lock. Incoming: all councils, newer meetings, all their materials."""
    c = councils(spark, d).select("council_id", F.col("council_name").alias("name"), (F.col("ministry") % 5 == 0).alias("manual_lock"), F.lit("seen").alias("discovered_at"), F.lit(None).cast("string").alias("discovery_source"), "stored")
    m = meetings(spark, d).select("meeting_id", "council_id", F.col("label").alias("name"), F.date_format("date", "yyyy/MM/dd").alias("day"), (F.col("flag") == "P").alias("manual_lock"), F.lit("a").alias("discovered_at"), F.lit(None).cast("string").alias("updated_at"), "date")
    p = _lines(spark, d).join(m.select("meeting_id", "date"), "meeting_id").select(
        "meeting_id", F.col("line").cast("string").alias("url"), F.lit("old").alias("name"), (F.col("line") == 1).alias("manual_lock"), F.when(F.col("type") == "R", "downloaded").otherwise("pending").alias("download_status"), F.lit("x").alias("local_path"),
        F.lit(1).alias("file_size"), F.lit("t").alias("downloaded_at"), F.col("download_status").alias("status"), "date",
    )
    stored = {"councils": c.filter("stored >= 0").drop("stored"), "meetings": m.filter(_OLD).drop("date"), "materials": p.filter(_OLD).filter("status = 'F'").drop("date", "status")}
    seq = F.lit(1).alias("seq")
    incoming = {
        "councils": c.select("council_id", F.concat("name", F.lit("!")).alias("name"), F.lit("").alias("discovered_at"), F.lit("web").alias("discovery_source"), seq),
        "meetings": m.filter(_NEW).select("meeting_id", "council_id", F.lit("new").alias("name"), "day", F.lit("").alias("discovered_at"), F.lit("now").alias("updated_at"), seq),
        "materials": p.filter(_NEW).select("meeting_id", "url", F.when(F.col("url") == "7", "").otherwise("new").alias("name"), F.lit("pending").alias("download_status"), seq),
        "rules": c.filter("stored < 0"),
    }
    return stored, incoming


_LINES = "(SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2)"
_MATERIALS = f"m AS (SELECT l_linenumber = 1 AS lock, l_returnflag = 'R' AS got, o_orderdate < TIMESTAMP '2000-06-01' AND l_linestatus = 'F' AS s, o_orderdate >= TIMESTAMP '1999-06-01' AND l_linenumber <> 7 AS i FROM {_LINES} JOIN orders ON o_orderkey = l_orderkey)"


@query(f"""WITH c AS (SELECT c_acctbal >= 0 AS s, c_nationkey % 5 = 0 AS lock FROM customer), o AS (SELECT o_orderdate < TIMESTAMP '2000-06-01' AS s, o_orderdate >= TIMESTAMP '1999-06-01' AS i, o_orderstatus = 'P' AS lock FROM orders), {_MATERIALS}
 SELECT * FROM (SELECT CAST(count_if(NOT s) AS BIGINT) AS councils_inserted, CAST(count_if(s AND NOT lock) AS BIGINT) AS councils_updated, CAST(count_if(s AND lock) AS BIGINT) AS councils_skipped_lock, CAST(count_if(NOT s) AS BIGINT) AS rules_synced, 0::BIGINT AS statuses_synced, 0::BIGINT AS configs_synced FROM c),
 (SELECT CAST(count_if(i AND NOT s) AS BIGINT) AS meetings_inserted, CAST(count_if(i AND s AND NOT lock) AS BIGINT) AS meetings_updated, CAST(count_if(i AND s AND lock) AS BIGINT) AS meetings_skipped_lock FROM o),
 (SELECT CAST(count_if(i AND NOT s) AS BIGINT) AS materials_inserted, CAST(count_if(i AND s AND NOT lock) AS BIGINT) AS materials_updated, CAST(count_if(i AND s AND NOT lock AND got) AS BIGINT) AS materials_preserved, CAST(count_if(i AND s AND lock) AS BIGINT) AS materials_skipped_lock FROM m)""")
def sync_counters(spark, d):
    """All thirteen counters of a sync of the whole dataset."""
    return store.sync_dataset(*_tables(spark, d))[1]


@query("""SELECT c_custkey AS council_id, CASE WHEN c_acctbal < 0 OR c_nationkey % 5 <> 0 THEN c_name || '!' ELSE c_name END AS name, CASE WHEN c_acctbal >= 0 THEN 'seen' ELSE '' END AS discovered_at, CASE WHEN c_acctbal < 0 OR c_nationkey % 5 <> 0 THEN 'web' END AS discovery_source FROM customer""")
def synced_councils(spark, d):
    """Councils after the sync: locked ones as they were, stamps kept where the new ones are empty."""
    return store.sync_dataset(*_tables(spark, d))[0]["councils"].select("council_id", "name", "discovered_at", "discovery_source")


def _report(spark, d):
    c = councils(spark, d).select("council_id", "council_name", "category", (F.col("ministry") % 5 == 0).alias("manual_lock"), "stored")
    rows = c.filter("stored >= 0").drop("stored")
    rejected = c.filter("stored < -500").select("council_id", "council_name")
    e = read(spark, d, "events")
    log = e.select(
        F.col("event_id").alias("seq"), F.when(F.col("event_id") % 50 == 0, "reject_council").when(F.col("event_id") % 50 == 1, "add_council").otherwise("update_field").alias("action"), F.col("user_id").alias("target_id"),
        F.when(F.col("event_id") % 2 == 0, "category").otherwise("council_name").alias("field"), F.col("event_type").alias("new_value"), F.lit(None).cast("string").alias("reason"),
        F.struct(F.col("user_id").alias("council_id"), F.lit("added").alias("council_name"), F.lit("X").alias("category"), F.lit(False).alias("manual_lock")).alias("council"),
    )
    return store.apply_report(rows, rejected, log, ["category", "council_name"])


_LOG = """c AS (SELECT c_custkey AS k, c_name, c_mktsegment, c_nationkey % 5 = 0 AS lock FROM customer WHERE c_acctbal >= 0), l AS (SELECT event_id AS seq, user_id AS k, event_type AS v, CASE WHEN event_id % 50 = 0 THEN 'out' WHEN event_id % 50 = 1 THEN 'add' ELSE 'set' END AS a FROM events),
 v AS (SELECT l.*, c.k IS NOT NULL AS known, coalesce(lock, false) AS lock, row_number() OVER (PARTITION BY l.k, a ORDER BY seq) = 1 AS f FROM l LEFT JOIN c ON c.k = l.k),
 j AS (SELECT *, CASE WHEN a = 'add' THEN CASE WHEN known OR NOT f THEN 'present' ELSE 'applied' END WHEN NOT known THEN 'unknown' WHEN a = 'set' AND lock THEN 'locked' WHEN a = 'out' AND NOT f THEN 'unknown' ELSE 'applied' END AS verdict FROM v) """


@query("WITH " + _LOG + "SELECT seq, verdict FROM j")
def report_verdicts(spark, d):
    """What becomes of each correction of a report."""
    return _report(spark, d)[2]


@query("WITH " + _LOG + """, w AS (SELECT k, arg_max(v, seq) FILTER (WHERE seq % 2 = 0) AS cat, arg_max(v, seq) FILTER (WHERE seq % 2 = 1) AS nam FROM j WHERE a = 'set' AND verdict = 'applied' GROUP BY 1)
 SELECT c.k AS council_id, coalesce(nam, c_name) AS council_name, coalesce(cat, c_mktsegment) AS category FROM c LEFT JOIN w ON w.k = c.k WHERE c.k NOT IN (SELECT k FROM j WHERE a = 'out' AND verdict = 'applied')
 UNION ALL SELECT k, 'added', 'X' FROM j WHERE a = 'add' AND verdict = 'applied'""")
def reported_councils(spark, d):
    """Councils after a report of updates, rejections and additions."""
    return _report(spark, d)[0].select("council_id", "council_name", "category")


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 1 THEN 'meeting_id' WHEN 2 THEN 'other_council' WHEN 3 THEN 'date' WHEN 4 THEN 'date' END AS error FROM orders WHERE o_orderkey % 6 IN (1, 2, 3, 4) UNION ALL SELECT c_custkey, 'council_id' FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT l_orderkey, 'material' FROM lineitem WHERE l_linenumber = 2""")
def bundle_checks(spark, d):
    """Errors of bundles: forms of ids and days, materials without a name."""
    k = F.col("council_id")
    c = councils(spark, d).select(F.concat(F.when(k % 2 == 1, "c1-").otherwise("cas-"), k).alias("council_id"))
    m = meetings(spark, d).select(F.concat(_pick("cas-x", "cas", "moj-x", "cas-x", "cas-x", "cas-x"), F.lit("-20260401-0"), _key() % 90 + 10, F.lit(""), F.lit("")).alias("meeting_id"), F.lit("cas-x").alias("council_id"), _pick("2026/04/01", "2026/04/01", "2026/04/01", "2026-04-01", "2099/01/01", "2026/04/01").alias("date"), _key().alias("n"))
    p = materials(spark, d).select(_key().cast("string").alias("meeting_id"), F.lit("u").alias("url"), F.when(F.col("line") != 2, "x").alias("name"))
    one = lambda df: df.select(F.regexp_extract("id", "([0-9]+)(?::u)?$", 1).cast("long").alias("k"), "error")
    none = lambda df: df.limit(0)
    errors = store.bundle_errors(none(c), m.withColumn("meeting_id", F.col("meeting_id")), none(p))
    by_row = m.select("n", "meeting_id", "council_id", "date").withColumn("e", F.lit(1))
    rows = by_row.join(errors.select(F.col("id").alias("meeting_id"), F.col("error")).distinct(), "meeting_id").filter(F.col("error").isNotNull())
    mine = F.when(F.col("error") == "date", (F.col("n") % 6).isin(3, 4)).otherwise(F.lit(True))
    return rows.filter(mine).select(F.col("n").alias("k"), "error").unionByName(one(store.bundle_errors(c, none(m), none(p)))).unionByName(one(store.bundle_errors(none(c), none(m), p)))


@query("""WITH n AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1) SELECT 'councils' AS name, count(*) AS n, CAST(count_if(c_custkey % 3 = 0) AS BIGINT) AS locked FROM customer UNION ALL SELECT 'meetings', count(*), CAST(count_if(o_orderkey % 7 = 0 OR o_orderstatus = 'P') AS BIGINT) FROM orders
 UNION ALL SELECT 'council_materials', count(*), 0 FROM customer UNION ALL SELECT 'materials', CAST(sum(n) AS BIGINT), (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_returnflag = 'R') FROM n""")
def seeded_tables(spark, d):
    """Rows and locks of the tables that a nested document gives: parents by the last, children by the first of each address."""
    mats = materials(spark, d).groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("line", F.col("type").alias("url")))).alias("x"))
    kid = lambda u: F.struct(F.lit("資料").alias("name"), u.alias("url"))
    m = meetings(spark, d).join(mats, "meeting_id", "left").select(F.struct(_key().cast("string").alias("id"), F.col("council_id").cast("string").alias("council_id"), (F.col("flag") == "P").alias("manual_lock"), F.transform("x", lambda x: kid(x["url"])).alias("materials")).alias("s"))
    c = councils(spark, d).select(F.struct(F.concat(F.lit("c"), "council_id").alias("id"), F.col("council_name").alias("name"), F.array(kid(F.lit("u")), kid(F.lit("u")), kid(F.lit(""))).alias("materials")).alias("s"))
    # A document a thousand rows, as files of a nested export are; tables come out of all of them.
    parts = lambda df, k, name: df.groupBy(F.pmod(F.hash("s.id"), F.lit(16)).alias("part")).agg(F.collect_list("s").alias(name))
    document = parts(c, 16, "councils").join(parts(m, 16, "meetings"), "part", "full")
    doubled = document.withColumn("councils", F.concat("councils", "councils"))
    locks = councils(spark, d).filter("council_id % 3 = 0").select(F.concat(F.lit("c"), "council_id").alias("id")).unionByName(meetings(spark, d).filter(_key() % 7 == 0).select(_key().cast("string").alias("id"))).unionByName(meetings(spark, d).select(F.concat(_key(), F.lit(":R")).alias("id")))
    tables = store.seed(doubled, locks)
    out = None
    for name, table in tables.items():
        one = table.agg(F.count("*").alias("n"), F.count_if("manual_lock").alias("locked")).select(F.lit(name).alias("name"), "n", "locked")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH m AS (SELECT o_orderkey AS k, n_name AS min, c_name || '/' || strftime(o_orderdate, '%Y%m%d') || '_第' || (o_orderkey % 9 + 1) || '回' AS dir FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
 p AS (SELECT l_orderkey AS k, l_linenumber AS n, '資料' || l_returnflag AS stem, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS r FROM {_LINES} WHERE l_linestatus <> 'F')
 SELECT min AS ministry_dir, place, CAST(ceil(place / 25.0) AS INTEGER) AS flush, meeting_id, path FROM (SELECT min, row_number() OVER (PARTITION BY min ORDER BY k, n) AS place, k AS meeting_id, min || '/' || dir || '/' || stem || CASE WHEN r > 1 THEN '_' || r ELSE '' END || '.pdf' AS path FROM p JOIN m USING (k))""")
def download_queue(spark, d):
    """The pending materials of each ministry in order, where each goes, and when its state is written."""
    c = councils(spark, d)
    m = meetings(spark, d).join(c.select("council_id", "council_name"), "council_id").select("meeting_id", "council_id", F.concat(F.lit("第"), _key() % 9 + 1, F.lit("回 "), "council_name").alias("name"), F.date_format("date", "yyyy/MM/dd").alias("date"))
    places = folders.canonical_folders(m, c, ministries(spark, d))
    p = _lines(spark, d).select("meeting_id", F.col("line").alias("position"), F.concat(F.lit("資料"), "type", F.lit("（PDF：12KB）")).alias("name"), F.concat(F.lit("https://e.go.jp/"), "line", F.lit(".pdf")).alias("url"), F.lit("PDF").alias("type"), F.when(F.col("download_status") == "F", "downloaded").alias("download_status"))
    return store.download_plan(p, places).select("ministry_dir", "place", "flush", "meeting_id", "path")


@query("""SELECT o_orderkey AS meeting_id, CASE WHEN o_orderkey % 5 = 4 THEN '' ELSE '地域' || (o_orderkey % 100) || '振興検討会' END AS name FROM orders""")
def news_names(spark, d):
    """The council that a news title names: in brackets, before papers, behind a dash, plainly, or none."""
    name = F.concat(F.lit("地域"), _key() % 100, F.lit("振興検討会"))
    title = _pick(F.concat(F.lit("お知らせ：「"), name, F.lit("」の開催について")), F.concat(name, F.lit("（第3回）配付資料")), F.concat(F.lit("方向性を議論します～"), name, F.lit("を開催")), F.concat(name, F.lit("の取りまとめを公表")), "白書の公表")
    return meetings(spark, d).select("meeting_id", names.name_in_news(title, ["検討会", "委員会", "部会"]).alias("name"))


@query("""SELECT '{"councilId":' || c_custkey || ',"name":"' || c_name || '"' || CASE WHEN c_acctbal < 0 THEN ',"manualLock":true' ELSE '' END || CASE WHEN c_custkey % 2 = 0 THEN ',"type":"HTML"' ELSE '' END || '}' AS json FROM customer""")
def json_names(spark, d):
    """Rows as the JSON writers put them: camel case, without what is false, empty or a default."""
    rows = councils(spark, d).select("council_id", F.col("council_name").alias("name"), (F.col("stored") < 0).alias("manual_lock"), F.lit("").alias("closed_reason"), F.when(F.col("council_id") % 2 == 0, "HTML").otherwise("PDF").alias("type"))
    named = store.to_json_names(rows, {"type": "PDF"})
    return named.select(F.to_json(F.struct("*")).alias("json"))
