"""Filters, searches, facets and sorts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minuteloom.functions import dates, text
from minuteloom.operators import merge, portal
from minuteloom.operators.portal import PortalQuery
from minuteloom.plans.base import query
from minuteloom.rounds import ranks
from minuteloom.schema import attempts, councils, materials, meetings, ministries, read

REF = "1999-09-16 12:00:00"
CHOICE = PortalQuery(ministry=3, category="BUILDING", date_range="PAST_YEAR", doc_type="MATERIALS", search="customer 1", ref=REF)


def _rows(spark, d):
    """Meetings with their council's attributes and the number of materials."""
    n = materials(spark, d).groupBy("meeting_id").agg(F.count("*").alias("materials_count"))
    return meetings(spark, d).join(councils(spark, d), "council_id").join(n, "meeting_id", "left").withColumns({"is_new": F.col("flag") == "O", "search_text": F.lower(F.concat_ws(" ", F.replace("council_name", F.lit("#"), F.lit(" ")), "label"))})


_ROWS = """rows AS (SELECT o_orderkey AS meeting_id, o_custkey AS council_id, o_orderdate AS date, o_orderstatus = 'O' AS is_new, c_nationkey AS ministry, c_mktsegment AS category,
 lower(replace(c_name, '#', ' ') || ' ' || o_orderpriority) AS search_text, coalesce(n, 0) AS materials_count
 FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""
_PAST = "date <= TIMESTAMP '1999-09-16 12:00:00' AND date >= TIMESTAMP '1999-09-16 12:00:00' - INTERVAL 365 DAY"


@query(f"""WITH {_ROWS} SELECT meeting_id, council_id, materials_count FROM rows WHERE ministry = 3 AND category = 'BUILDING' AND {_PAST}
 AND materials_count > 0 AND contains(search_text, 'customer') AND contains(search_text, '1')""")
def meeting_filter(spark, d):
    """Conditions on meetings come first, so that only what is left has its materials counted."""
    rows = meetings(spark, d).join(councils(spark, d), "council_id").withColumn("search_text", F.lower(F.concat_ws(" ", F.replace("council_name", F.lit("#"), F.lit(" ")), "label")))
    fit = portal.filter_meetings(rows, replace(CHOICE, doc_type="ALL"))
    counted = portal.with_child_counts(fit, materials(spark, d), "meeting_id", "materials_count")
    return portal.filter_meetings(counted, PortalQuery(doc_type=CHOICE.doc_type)).select("meeting_id", "council_id", "materials_count")


@query("""SELECT c_custkey AS council_id FROM customer WHERE c_mktsegment = 'BUILDING' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')
 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate <= TIMESTAMP '1999-09-16 12:00:00' AND o_orderdate >= TIMESTAMP '1999-09-16 12:00:00' - INTERVAL 90 DAY)""")
def council_filter(spark, d):
    chosen = councils(spark, d).filter(F.col("category") == "BUILDING")
    return portal.with_any(chosen, meetings(spark, d), "council_id", F.col("flag") == "O", dates.in_range(F.col("date"), "90D", REF)).select("council_id")


def _range(code, sql_condition):
    @query(f"SELECT o_orderkey AS meeting_id FROM orders WHERE {sql_condition}", name=f"date_range_{code.lower()}")
    def run(spark, d):
        return meetings(spark, d).filter(dates.in_range(F.col("date"), code, REF)).select("meeting_id")


for _code, _days in (("7D", 7), ("30D", 30), ("90D", 90), ("PAST_YEAR", 365)):
    _range(_code, f"o_orderdate <= TIMESTAMP '{REF}' AND o_orderdate >= TIMESTAMP '{REF}' - INTERVAL {_days} DAY")
for _code, _year in (("YEAR", 1999), ("PREV_YEAR", 1998)):
    _range(_code, f"year(o_orderdate) - CAST(month(o_orderdate) < 4 AS INTEGER) = {_year}")


@query("SELECT DISTINCT o_orderkey AS meeting_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def has_children(spark, d):
    return meetings(spark, d).join(materials(spark, d), "meeting_id", "left_semi").select("meeting_id")


@query(f"""WITH {_ROWS} SELECT DISTINCT 'ministry' AS facet, CAST(ministry AS VARCHAR) AS value FROM rows WHERE category = 'BUILDING' AND {_PAST} OR ministry = 3
 UNION ALL SELECT DISTINCT 'category', category FROM rows WHERE ministry = 3 AND {_PAST} OR category = 'BUILDING'""")
def facets(spark, d):
    return portal.facets(_rows(spark, d), PortalQuery(ministry=3, category="BUILDING", date_range="PAST_YEAR", ref=REF))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'ing') AND contains(lower(text), 'er')")
def search_docs_and(spark, d):
    return read(spark, d, "documents").filter(portal.contains_all(F.lower("text"), text.terms("The ing　er"))).select("doc_id")


@query("""SELECT c_custkey AS council_id FROM customer WHERE (contains(lower(c_name), 'urgent') OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND contains(lower(o_orderpriority), 'urgent')))
 AND (contains(lower(c_name), '7') OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND contains(lower(o_orderpriority), '7')))""")
def search_parents_and(spark, d):
    return portal.search_parents(councils(spark, d), meetings(spark, d), "council_id", ["urgent", "7"], F.lower("council_name"), F.lower("label")).select("council_id")


@query("""SELECT o_orderkey AS meeting_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(lower(c_name), '12') AND contains(lower(c_name), '5') OR contains(lower(o_orderpriority), '12') AND contains(lower(o_orderpriority), '5')""")
def search_children_refine(spark, d):
    joined = meetings(spark, d).join(councils(spark, d), "council_id")
    return portal.refine_children(joined, ["12", "5"], F.lower("council_name"), F.lower("label")).select("meeting_id")


def _sorted(by, sql_key):
    @query(f"""WITH {_ROWS}, c AS (SELECT o_custkey AS council_id, count(*) AS meetings_count FROM orders GROUP BY 1)
 SELECT meeting_id, row_number() OVER (PARTITION BY ministry ORDER BY {sql_key} date DESC, meeting_id) AS place FROM rows JOIN c USING (council_id)""", name=f"sort_{by.lower()}")
    def run(spark, d):
        n = meetings(spark, d).groupBy("council_id").agg(F.count("*").alias("meetings_count"))
        return ranks(_rows(spark, d).join(n, "council_id"), ["ministry"], portal.meeting_order(by), "place").select("meeting_id", "place")


for _by, _key in (("NEWEST", ""), ("OLDEST", "date,"), ("DOCS_DESC", "materials_count DESC,"), ("DOCS_ASC", "materials_count,"), ("MEETINGS_DESC", "meetings_count DESC,"), ("MEETINGS_ASC", "meetings_count,")):
    _sorted(_by, _key)


@query("""WITH m AS (SELECT o_custkey, max(o_orderdate) AS latest_date FROM orders GROUP BY 1)
 SELECT c_custkey AS council_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY latest_date IS NULL, latest_date DESC, c_name, c_custkey) AS place FROM customer LEFT JOIN m ON o_custkey = c_custkey""")
def sort_parents(spark, d):
    latest = meetings(spark, d).groupBy("council_id").agg(F.max("date").alias("latest_date"))
    order = portal.council_order("NEWEST", F.col("council_name"))
    return ranks(councils(spark, d).join(latest, "council_id", "left"), ["ministry"], order, "place").select("council_id", "place")


@query("""SELECT c_custkey AS council_id, max(o_orderdate) AS latest_date FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') GROUP BY 1 HAVING max(o_orderdate) IS NULL OR max(o_orderdate) >= TIMESTAMP '2000-01-01'""")
def active_targets(spark, d):
    """Chosen ministries, not rejected, not dormant; councils without history stay."""
    rejected = meetings(spark, d).filter("label = '1-URGENT' and flag = 'P'").select("council_id")
    latest = meetings(spark, d).groupBy("council_id").agg(F.max("date").alias("latest_date"))
    chosen = councils(spark, d).filter(F.col("category").isin("BUILDING", "MACHINERY")).join(rejected, "council_id", "left_anti").join(latest, "council_id", "left")
    return chosen.filter("latest_date is null or latest_date >= timestamp '2000-01-01'").select("council_id", "latest_date")


@query("""SELECT o_orderkey AS meeting_id, o_custkey AS council_id, count(*) OVER () AS total FROM orders JOIN customer ON c_custkey = o_custkey WHERE (o_orderstatus = 'O' OR o_orderpriority = '2-HIGH' OR coalesce(o_totalprice, 0) > 400000)
 AND replace(substr(coalesce(CAST(o_orderdate AS VARCHAR), ''), 1, 10), '-', '/') >= '2001/06/01' AND c_nationkey IN (1, 2, 3) ORDER BY o_orderdate DESC, coalesce(nullif(o_orderpriority, ''), '~'), o_orderkey LIMIT 50""")
def inspect_recent(spark, d):
    """OR-ed stamps, text date bound, IN list; three sort keys; the total is counted before the limit."""
    found = meetings(spark, d).join(councils(spark, d).filter(F.col("ministry").isin(1, 2, 3)), "council_id")
    found = found.filter((F.col("flag") == "O") | (F.col("label") == "2-HIGH") | (F.coalesce("weight", F.lit(0)) > 400000)).filter(F.col("date") >= F.lit("2001-06-01").cast("timestamp"))
    total = found.agg(F.count("*").alias("total"))
    top = found.orderBy(F.desc("date"), F.coalesce(F.nullif(F.col("label"), F.lit("")), F.lit("~")), "meeting_id").limit(50)
    return top.crossJoin(F.broadcast(total)).select("meeting_id", "council_id", "total")  # one row


@query("""SELECT o_orderkey AS meeting_id FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-01' AND o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderpriority DESC, o_orderkey DESC LIMIT 100""")
def new_rows_window(spark, d):
    return meetings(spark, d).filter("date >= timestamp '2001-07-01' and flag = 'O'").orderBy(F.desc("date"), F.desc("label"), F.desc("meeting_id")).limit(100).select("meeting_id")


@query("""SELECT o_orderkey AS meeting_id, CASE WHEN o_orderdate >= DATE '2001-08-01' - INTERVAL 730 DAY THEN 'active' ELSE 'archive' END AS segment FROM orders""")
def active_archive_split(spark, d):
    return meetings(spark, d).select("meeting_id", merge.active_split(F.col("date"), "2001-08-01").alias("segment"))


@query("SELECT o_orderkey AS meeting_id FROM orders WHERE strftime(o_orderdate, '%Y/%m/%d') LIKE '2001%' OR o_orderstatus = 'P'")
def unconfirmed(spark, d):
    """A sentinel year or a flag; the year is a range on the raw column, which Parquet can prune."""
    return meetings(spark, d).filter("date >= timestamp '2001-01-01' and date < timestamp '2002-01-01' or flag = 'P'").select("meeting_id")


@query("""SELECT c_custkey AS council_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-06-01') AND c_name NOT IN (SELECT s_name FROM supplier)
 AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def anti_multi_key(spark, d):
    c = councils(spark, d)
    recent = meetings(spark, d).filter("date >= timestamp '2000-06-01'").select(F.col("council_id").alias("k"))
    other = read(spark, d, "supplier")
    return portal.anti_any(c, (recent, F.col("council_id") == F.col("k")), (other.select("s_name"), F.col("council_name") == F.col("s_name")), (other.select("s_suppkey"), F.col("council_id") == F.col("s_suppkey"))).select("council_id")


@query("""SELECT doc_id, CASE WHEN quality IS NULL THEN 'pending' WHEN quality = 1 THEN 'approved' ELSE 'rejected' END AS verdict FROM documents LEFT JOIN labels USING (doc_id)""")
def overlay_labels(spark, d):
    found = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left")
    return found.select("doc_id", F.when(F.col("quality").isNull(), "pending").when(F.col("quality") == 1, "approved").otherwise("rejected").alias("verdict"))


@query("SELECT o_orderkey AS meeting_id FROM orders WHERE o_custkey IN (3, 5, 8, 13, 21, 34)")
def watchlist(spark, d):
    return portal.filter_meetings(meetings(spark, d), PortalQuery(watched=(3, 5, 8, 13, 21, 34))).select("meeting_id")


@query("""SELECT o_orderkey AS meeting_id, n_name AS ministry_name, coalesce(nullif(o_orderpriority, ''), c_mktsegment, 'COUNCIL') AS label FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def effective_attributes(spark, d):
    found = meetings(spark, d).join(councils(spark, d), "council_id", "left").join(ministries(spark, d), "ministry", "left")
    return found.select("meeting_id", "ministry_name", F.coalesce(F.nullif(F.col("label"), F.lit("")), "category", F.lit("COUNCIL")).alias("label"))


@query("""SELECT '"' || replace(c_name, '"', '""') || '"' AS name, CASE WHEN regexp_matches(o_orderpriority, '^[=+\\-@]') THEN '''' || o_orderpriority ELSE o_orderpriority END AS label, strftime(o_orderdate, '%Y/%m/%d') AS date, o_orderkey AS meeting_id
 FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3""")
def csv_export_rows(spark, d):
    found = meetings(spark, d).join(councils(spark, d).filter("ministry = 3"), "council_id")
    name = F.concat(F.lit('"'), F.replace("council_name", F.lit('"'), F.lit('""')), F.lit('"'))
    return found.select(name.alias("name"), text.csv_field(F.col("label")).alias("label"), F.date_format("date", "yyyy/MM/dd").alias("date"), "meeting_id")


@query("""WITH a AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM a""")
def host_interleave(spark, d):
    from minuteloom.operators.analytics import interleave

    return interleave(attempts(spark, d), "council_id", ["ts", "seq"]).select("seq", F.col("turn").cast("long").alias("turn"))


@query("""SELECT seq, known FROM (SELECT event_id AS seq, event_type = 'view' AS known, user_id, row_number() OVER (PARTITION BY user_id, event_type = 'view' ORDER BY ts DESC, event_id) AS r FROM events) WHERE NOT known AND r <= 50 OR known AND r <= 1""")
def incremental_quota(spark, d):
    """Of each council: 50 unknown and one known row, newest first."""
    order = Window.partitionBy("council_id", "known").orderBy(F.desc("ts"), "seq")
    ranked = attempts(spark, d).withColumn("known", F.col("kind") == "view").withColumn("r", F.row_number().over(order)).filter("r <= 50")
    return ranked.filter("not known or r <= 1").select("seq", "known")
