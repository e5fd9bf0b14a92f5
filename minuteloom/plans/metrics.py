"""Counts, series and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from minuteloom.functions import dates
from minuteloom.operators import analytics
from minuteloom.plans.base import query
from minuteloom.schema import attempts, councils, materials, meetings, ministries, read

_FY = "year(o_orderdate) - CAST(month(o_orderdate) < 4 AS INTEGER)"


@query(f"""SELECT n_name AS ministry_name, {_FY} AS fiscal_year, count(DISTINCT o_orderkey) AS meetings, count(l_orderkey) AS materials FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
 LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def ministry_fy_activity(spark, d):
    return analytics.fiscal_activity(councils(spark, d), meetings(spark, d), materials(spark, d), ministries(spark, d))


@query("""WITH m AS (SELECT c_nationkey AS ministry, count(DISTINCT c_custkey) AS councils, count(DISTINCT o_orderkey) AS meetings, count(l_orderkey) AS docs FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
 s AS (SELECT s_nationkey AS ministry, count(*) AS own FROM supplier GROUP BY 1)
 SELECT ministry, coalesce(councils, 0) AS councils, coalesce(meetings, 0) AS meetings, coalesce(docs, 0) + coalesce(own, 0) AS materials FROM m FULL JOIN s USING (ministry)""")
def ministry_metrics(spark, d):
    own = read(spark, d, "supplier").select(F.col("s_nationkey").alias("ministry"))
    return analytics.ministry_metrics(councils(spark, d), meetings(spark, d), materials(spark, d), own)


@query(f"""SELECT CAST(i AS INTEGER) AS month_index, count(o_orderkey) AS n FROM range(12) AS t(i) LEFT JOIN orders ON (month(o_orderdate) + 8) % 12 = i AND {_FY} = 1999 GROUP BY 1""")
def fy_monthly(spark, d):
    return analytics.monthly_series(meetings(spark, d), 1999)


@query("""SELECT c_custkey AS council_id, coalesce(n, CAST(round(c_acctbal) AS BIGINT)) AS past_year_count FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-09-16' AND o_orderdate <= TIMESTAMP '1999-09-16') AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1) ON o_custkey = c_custkey""")
def past_year_count(spark, d):
    return analytics.past_year_count(councils(spark, d).withColumn("stored", F.round("stored")), meetings(spark, d), "1999-09-16 00:00:00")


@query("SELECT o_custkey AS council_id, count(DISTINCT CAST(o_orderdate AS DATE)) AS past_year_days FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1999-09-16' - 365 AND DATE '1999-09-16' GROUP BY 1")
def past_year_days(spark, d):
    return analytics.past_year_days(meetings(spark, d), "1999-09-16")


@query("SELECT o_custkey AS council_id, count(*) AS total_count FROM orders GROUP BY 1")
def total_count(spark, d):
    return meetings(spark, d).groupBy("council_id").agg(F.count("*").alias("total_count"))


@query("SELECT c_custkey AS council_id, count(o_orderkey) AS meetings_count, CAST(max(o_orderdate) AS DATE) AS latest_date FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def child_counts(spark, d):
    return analytics.child_counts(councils(spark, d), meetings(spark, d)).withColumn("latest_date", F.to_date("latest_date"))


@query("SELECT o_custkey AS council_id, CAST(max(o_orderdate) AS DATE) AS latest_date, CAST(max(o_orderdate) FILTER (WHERE o_orderdate < TIMESTAMP '2001-01-01') AS DATE) AS latest_confirmed FROM orders GROUP BY 1")
def latest_child(spark, d):
    """The portal's latest date, sentinels and all, and the crawler's, without them."""
    return meetings(spark, d).groupBy("council_id").agg(F.to_date(F.max("date")).alias("latest_date"), F.to_date(F.max(F.when(F.col("date") < "2001-01-01", F.col("date")))).alias("latest_confirmed"))


@query(f"SELECT DISTINCT {_FY} AS fiscal_year FROM orders WHERE {_FY} >= 1990")
def fiscal_years(spark, d):
    return meetings(spark, d).select(dates.fiscal_year(F.col("date")).alias("fiscal_year")).filter("fiscal_year >= 1990").distinct()


@query("SELECT (SELECT count(*) FROM customer) AS councils, (SELECT count(*) FROM orders) AS meetings, (SELECT count(*) FROM lineitem) AS materials")
def totals(spark, d):
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(councils(spark, d), "councils").crossJoin(one(meetings(spark, d), "meetings")).crossJoin(one(materials(spark, d), "materials"))  # one row each


@query("SELECT coalesce(l_linestatus, 'total') AS status, count(*) AS n, sum(l_quantity) AS bytes FROM lineitem GROUP BY ROLLUP (l_linestatus)")
def download_summary(spark, d):
    return analytics.download_summary(materials(spark, d))


@query("SELECT " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS n_{k}" for k in ("click", "view", "error", "signup")) + " FROM events")
def status_pivot(spark, d):
    return analytics.status_pivot(attempts(spark, d), ["click", "view", "error", "signup"])


@query("SELECT CASE WHEN ts < TIMESTAMP '2024-01-05' THEN 'date' WHEN event_type = 'error' THEN 'rejected' WHEN value < 1 THEN 'noise' ELSE 'candidate' END AS stage, count(*) AS n FROM events GROUP BY 1")
def funnel_counts(spark, d):
    stages = [("date", F.col("ts") < "2024-01-05"), ("rejected", F.col("kind") == "error"), ("noise", F.col("value") < 1)]
    return analytics.funnel(attempts(spark, d), stages)


@query("""WITH r AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events)
 SELECT event_id AS seq, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS BIGINT) AS consecutive_failures FROM r""")
def consecutive_failures(spark, d):
    return analytics.failure_streak(attempts(spark, d), F.col("kind") == "error").select("seq", "consecutive_failures")


@query("SELECT l_orderkey AS meeting_id, l_linenumber AS line, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_quantity) AS occurrence FROM lineitem")
def occurrence_suffix(spark, d):
    out = analytics.occurrence_suffix(materials(spark, d), ["meeting_id", "type"], ["line", "part", "file_size"])
    return out.select("meeting_id", "line", "part", F.col("occurrence").cast("long").alias("occurrence"))


@query("SELECT user_id AS council_id, event_id AS seq, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 3")
def top3_per_parent(spark, d):
    return analytics.first_per_key(attempts(spark, d), ["council_id"], [F.desc("ts"), F.asc("seq")], 3).select("council_id", "seq", F.col("rank").cast("long").alias("rank"))


@query("SELECT code, count(*) FILTER (WHERE regexp_matches(props, '(^|[^0-9])' || code || '([^0-9]|$)')) AS lines FROM events, (VALUES ('40'), ('42')) AS c(code) GROUP BY 1")
def line_code_counts(spark, d):
    return analytics.line_code_counts(read(spark, d, "events"), "props", ["40", "42"])


@query("SELECT doc_id, CAST(length(text) - length(regexp_replace(text, '[À-ÿ]', '', 'g')) AS BIGINT) AS n_marked, CAST(length(text) AS BIGINT) AS n_chars FROM documents")
def char_class_counts(spark, d):
    return read(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit("[À-ÿ]")).cast("long").alias("n_marked"), F.length("text").cast("long").alias("n_chars"))


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS user_turns FROM conversations GROUP BY 1 HAVING count(*) FILTER (WHERE role = 'user') * 10 BETWEEN 3 * count(*) AND 9 * count(*)")
def active_ratio(spark, d):
    found = read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"))
    return found.filter("user_turns * 10 between 3 * turns and 9 * turns")


@query("SELECT CASE WHEN quality IS NULL THEN 'pending' WHEN quality = 1 THEN 'approved' ELSE 'rejected' END AS verdict, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def review_stats(spark, d):
    from minuteloom.plans.portal import overlay_labels

    return overlay_labels(spark, d).groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment AS category, count(*) AS n FROM customer GROUP BY 1")
def category_counts(spark, d):
    return councils(spark, d).groupBy("category").agg(F.count("*").alias("n"))
