"""Registration, closing, locks, rejection, discovery and clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from minuteloom.batches import sized
from minuteloom.operators import discovery, governance
from minuteloom.plans.base import query
from minuteloom.schema import councils, materials, meetings, read

_RECENT = "TIMESTAMP '2001-01-01'"


def _poor(spark, d):
    return councils(spark, d).filter("stored < 0")


@query("SELECT c_custkey AS council_id, CASE WHEN c_acctbal < 0 THEN c_name || ' (registered)' ELSE c_name END AS council_name, c_acctbal < 0 AS manual_lock FROM customer")
def register_bundle(spark, d):
    """A bundle's councils get its names and are locked; the table has the rest only, so some of them are new."""
    every = councils(spark, d).withColumn("manual_lock", F.lit(False)).select("council_id", "council_name", "manual_lock")
    incoming = _poor(spark, d).select("council_id", F.concat("council_name", F.lit(" (registered)")).alias("council_name"))
    return governance.register(every.join(_poor(spark, d).filter("category = 'BUILDING'"), "council_id", "left_anti"), incoming, "council_id", ["council_name"])


@query(f"""SELECT o_orderkey AS meeting_id, CAST(part AS BIGINT) AS part FROM (SELECT l_orderkey, l_partkey AS part FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate < {_RECENT} UNION ALL
 SELECT l_orderkey, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate >= {_RECENT} GROUP BY 1, 2) AS t(o_orderkey, part)""")
def replace_materials(spark, d):
    """Recent meetings get a new list of materials, each part once."""
    stored = materials(spark, d).select("meeting_id", F.col("part").cast("long").alias("part"), "line")
    recent = sized(meetings(spark, d).filter(f"date >= {_RECENT}").select("meeting_id"), "meeting_id", like=stored)
    incoming = sized(stored, "meeting_id").join(recent, "meeting_id", "left_semi")
    return governance.replace_children(stored, incoming, "meeting_id", "part", "line").select("meeting_id", "part")


_DORMANT = f"SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= {_RECENT})"


def _closed(spark, d):
    recent = meetings(spark, d).filter(f"date >= {_RECENT}").select("council_id")
    every = councils(spark, d).select("council_id", F.lit(False).alias("is_closed"), F.lit(None).cast("string").alias("closed_reason"))
    return governance.set_closed(every, every.join(recent, "council_id", "left_anti"), "council_id", F.lit("dormant"))


@query(f"SELECT c_custkey AS council_id, c_custkey IN ({_DORMANT}) AS is_closed, CASE WHEN c_custkey IN ({_DORMANT}) THEN 'dormant' END AS closed_reason FROM customer")
def close_councils(spark, d):
    """Councils without a recent meeting are closed."""
    return _closed(spark, d)


@query(f"SELECT c_custkey AS council_id, c_acctbal >= 0 AND c_custkey IN ({_DORMANT}) AS is_closed, CASE WHEN c_acctbal >= 0 AND c_custkey IN ({_DORMANT}) THEN 'dormant' END AS closed_reason FROM customer")
def reopen_councils(spark, d):
    return governance.set_open(_closed(spark, d), _poor(spark, d), "council_id")


@query("SELECT o_orderstatus = 'P' AS manual_lock, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def lock_meetings(spark, d):
    """Materials by lock once all pending meetings are locked."""
    m, free = meetings(spark, d), F.lit(False).alias("manual_lock")
    _, locked = governance.set_lock(m.select("meeting_id", free), materials(spark, d).select("meeting_id", free), m.filter("flag = 'P'"), "meeting_id")
    return locked.groupBy("manual_lock").agg(F.count("*").alias("n"))


def _rejected(spark, d):
    """Some are rejected already when the poor ones are."""
    every = councils(spark, d).select("council_id", "council_name")
    before = councils(spark, d).filter("stored < -500").select("council_id", "council_name", F.lit("earlier").alias("reason"))
    return governance.reject(every, before, _poor(spark, d), "council_id", F.lit("poor"))


@query("SELECT c_custkey AS council_id, CASE WHEN c_acctbal < -500 THEN 'earlier' WHEN c_acctbal < 0 THEN 'poor' ELSE 'stays' END AS state FROM customer")
def reject_councils(spark, d):
    left, gone = _rejected(spark, d)
    return left.select("council_id", F.lit("stays").alias("state")).unionByName(gone.select("council_id", F.col("reason").alias("state")))


@query("SELECT c_custkey AS council_id, CASE WHEN c_acctbal < -500 THEN 'pending' WHEN c_acctbal < 0 THEN 'rejected' ELSE 'stays' END AS status FROM customer")
def restore_councils(spark, d):
    left, gone = _rejected(spark, d)
    back, still = governance.restore(left.withColumn("status", F.lit("stays")), gone, gone.filter("reason = 'earlier'"), "council_id")
    return back.select("council_id", "status").unionByName(still.select("council_id", F.lit("rejected").alias("status")))


@query("SELECT c_custkey AS council_id, c_acctbal >= 5000 AS is_new, CASE WHEN c_acctbal < 5000 THEN 'stored' ELSE 'found' END AS source FROM customer WHERE c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY'")
def persist_discoveries(spark, d):
    """All councils are found, half are stored; poor ones (by key) and a segment (by name) are rejected."""
    every = councils(spark, d).select("council_id", "council_name", F.lit(False).alias("is_new"), F.lit("found").alias("source"), "stored", "category")
    columns = ["council_id", "council_name", "is_new", "source"]
    stored = every.filter("stored < 5000").withColumn("source", F.lit("stored")).select(*columns)
    by_key = every.filter("stored < 0").select("council_id", F.lit(None).cast("string").alias("council_name"))
    by_name = every.filter("category = 'MACHINERY'").select(F.lit(None).cast("long").alias("council_id"), "council_name")
    out = governance.keep_discoveries(stored, every.select(*columns), by_key.unionByName(by_name), "council_id", ["council_name"], ["is_new", "source"], "is_new")
    return out.select("council_id", "is_new", "source")


@query("SELECT min(o_orderkey) AS meeting_id, o_custkey AS council_id, o_orderpriority AS label FROM orders WHERE o_orderstatus <> 'P' GROUP BY 2, 3")
def cleanup(spark, d):
    """Pending meetings are junk; of a council's meetings with one label the first stays."""
    junk = F.when(F.col("flag") == "P", "pending")
    return governance.clean_up(meetings(spark, d), junk, ["council_id", "label"], "meeting_id").select("meeting_id", "council_id", "label")


_NAMED = """n AS (SELECT c_custkey AS k, c_nationkey AS m, CASE c_custkey % 4 WHEN 0 THEN '特別' WHEN 1 THEN '地域特別' WHEN 2 THEN '地域 特別' ELSE '' END || lower(c_mktsegment) || CASE c_custkey % 3 WHEN 0 THEN '検討会' WHEN 1 THEN '政策部会' ELSE '会議' END AS name, 'https://e.go.jp/' || c_custkey % 400 || CASE WHEN c_custkey % 2 = 0 THEN '/' ELSE '' END AS url, c_acctbal < -800 AS known FROM customer)"""


@query(f"""WITH RECURSIVE {_NAMED}, x AS (SELECT k, known, struct_pack(m := m, n := replace(name, ' ', ''), u := rtrim(url, '/')) AS s FROM n), f AS (SELECT *, row_number() OVER (ORDER BY k) AS i FROM x WHERE NOT known),
 walk AS (SELECT CAST(0 AS BIGINT) AS i, coalesce((SELECT list(s) FROM x WHERE known), []) AS had, CAST(NULL AS BIGINT) AS k UNION ALL
  SELECT f.i, CASE WHEN len(t.met) = 0 THEN list_append(t.had, f.s) ELSE t.had END, CASE WHEN len(t.met) = 0 THEN f.k END FROM (SELECT w.i, w.had, [o for o in w.had if o.u = f.s.u OR (o.m = f.s.m AND (o.n = f.s.n OR (length(o.n) >= 4 AND length(f.s.n) >= 4 AND regexp_matches(o.n, '検討会|部会') AND regexp_matches(f.s.n, '検討会|部会')
   AND ((ends_with(o.n, f.s.n) AND NOT starts_with(o.n, f.s.n)) OR (ends_with(f.s.n, o.n) AND NOT starts_with(f.s.n, o.n))))))] AS met FROM walk AS w JOIN f ON f.i = w.i + 1) AS t JOIN f ON f.i = t.i + 1)
 SELECT k AS council_id FROM walk WHERE k IS NOT NULL""")
def new_councils(spark, d):
    """Found councils in order, less those that a known one or one that was admitted before tells to be there: by address, by name, by an end of a name."""
    k = F.col("council_id")
    prefix = F.when(k % 4 == 0, "特別").when(k % 4 == 1, "地域特別").when(k % 4 == 2, "地域 特別").otherwise("")
    name = F.concat(prefix, F.lower("category"), F.when(k % 3 == 0, "検討会").when(k % 3 == 1, "政策部会").otherwise("会議"))
    rows = councils(spark, d).select(k, F.col("ministry").cast("string").alias("ministry"), name.alias("name"), F.concat(F.lit("https://e.go.jp/"), k % 400, F.when(k % 2 == 0, "/").otherwise("")).alias("official_url"), "stored")
    return discovery.keep_new(rows.filter("stored >= -800"), rows.filter("stored < -800"), ["council_id"]).select("council_id")


@query("""WITH s AS (SELECT s_suppkey AS k, 'https://a' || s_suppkey || '.go.jp/news/' AS portal, 1 + s_suppkey % 9 AS m FROM supplier)
 SELECT portal, 0 AS rank, CASE WHEN k % 4 = 0 AND m < 9 THEN portal WHEN k % 4 = 0 THEN portal || '20260' || m || '.html' WHEN k % 4 = 1 THEN portal || 'r' || (8 + k % 3) || '_news_menu.html' WHEN k % 4 = 2 THEN portal ELSE portal || '2026/' END AS url FROM s
 UNION ALL SELECT portal, 1, CASE WHEN k % 4 = 0 AND m < 9 THEN portal || '20260' || m || '.html' WHEN k % 4 = 0 THEN portal || '2026' || lpad(CAST(m - 1 AS VARCHAR), 2, '0') || '.html' ELSE portal || 'x' || k || '.html' END FROM s WHERE k % 4 IN (0, 3)""")
def portal_pages(spark, d):
    """The pages to read of each supplier's portal: of months, of an era's menus, of none that is new, and by what the links' texts and addresses tell."""
    k, m = F.col("s_suppkey"), 1 + F.col("s_suppkey") % 9
    s = read(spark, d, "supplier").select(k, F.concat(F.lit("https://a"), k, F.lit(".go.jp/news/")).alias("portal"))
    pattern = F.when(k % 4 == 0, r"news/\d{6}\.html").when(k % 4 == 1, "news_menu")
    month = lambda back: F.concat(F.lit("2026"), F.lpad((m - back).cast("string"), 2, "0"), F.lit(".html"))
    menu = lambda back: F.concat(F.lit("r"), 8 + k % 3 - back, F.lit("_news_menu.html"))
    places = F.when(k % 4 == 0, F.array(F.lit("202512.html"), month(0), month(1))).when(k % 4 == 1, F.array(menu(1), menu(0), menu(2))).when(k % 4 == 2, F.array(F.lit("about.html"))).otherwise(F.array(F.concat(F.lit("x"), k, F.lit(".html")), F.lit("2026/"), F.lit("z.html")))
    links = s.select("portal", pattern.alias("pattern"), k, F.posexplode(places).alias("position", "place"))
    said = F.when((k % 4 == 3) & (F.col("position") == 0), "９月の会議").otherwise("一覧")
    return discovery.resolve_portals(links.select("portal", "pattern", "position", F.concat("portal", "place").alias("url"), said.alias("text")), "2026-09-16")


_SCORES = ((0, 5, 0), (10, 5, 0), (10, 0, 3), (0, 5, 3), (0, 0, 3))


@query(f"""WITH l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, (l_linenumber + l_orderkey) % 7 AS kind FROM lineitem), s AS (SELECT *, CASE kind {" ".join(f"WHEN {i} THEN {sum(x)}" for i, x in enumerate(_SCORES))} ELSE 0 END AS score FROM l),
 b AS (SELECT k, arg_min(n, (-score, n)) AS n FROM s WHERE score >= 5 GROUP BY 1) SELECT l_orderkey AS meeting_id, coalesce('https://a.go.jp/' || CASE WHEN (n + l_orderkey) % 7 >= 2 THEN 'kaigi/' ELSE 'x/' END || n, 'https://a.go.jp/report/press/' || l_orderkey || '.html') AS parent_url FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN b ON k = l_orderkey""")
def parent_page(spark, d):
    """The council's page of each press release, by its links' names, words and paths; another host's, a release and noise are none."""
    n, k = F.col("line"), F.col("meeting_id")
    kind = (n + k) % 7
    host = F.when(kind == 5, "https://b.go.jp/").otherwise("https://a.go.jp/")
    folder = F.when(kind == 6, "report/press/").when(kind >= 2, "kaigi/").otherwise("x/")
    said = F.when(kind == 0, "議事要旨一覧").when(kind == 1, "水循環検討会の開催状況").when(kind == 2, "水循環検討会について").when(kind == 3, "配付資料の置き場所").when(kind == 4, "会場への案内図").otherwise("水循環検討会の開催状況")
    press = F.concat(F.lit("https://a.go.jp/report/press/"), k, F.lit(".html"))
    links = materials(spark, d).select(k, n).distinct().select(press.alias("press_url"), F.lit("第3回 水循環検討会").alias("name"), n.alias("position"), F.concat(host, folder, n).alias("url"), said.alias("text"))
    found = discovery.parent_pages(links)
    return found.select(F.regexp_extract("press_url", "([0-9]+)", 1).cast("long").alias("meeting_id"), "parent_url")
