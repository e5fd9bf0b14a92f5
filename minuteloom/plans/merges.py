"""Merges, diffs, set operations, nesting."""

from __future__ import annotations

from pyspark.sql import functions as F

from minuteloom.operators import merge
from minuteloom.plans.base import query
from minuteloom.schema import attempts, councils, materials, meetings, read
from minuteloom.sources import documents

_OLD, _NEW = "date < timestamp '2000-06-01'", "date >= timestamp '1999-06-01'"


def _halves(spark, d):
    m = meetings(spark, d)
    return m.filter(_OLD), m.filter(_NEW)


@query("""WITH a AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '2000-06-01'), b AS (SELECT o_orderkey, o_orderpriority || '+' AS p, o_orderstatus AS s FROM orders WHERE o_orderdate >= TIMESTAMP '1999-06-01')
 SELECT coalesce(a.o_orderkey, b.o_orderkey) AS meeting_id, CASE WHEN b.o_orderkey IS NULL THEN a.o_orderpriority ELSE b.p END AS label, coalesce(a.o_orderstatus, b.s) AS flag FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""")
def merge_upsert(spark, d):
    """New labels win, stored flags stay."""
    old, new = (x.select("meeting_id", "label", "flag") for x in _halves(spark, d))
    return merge.upsert(old, new.withColumn("label", F.concat("label", F.lit("+"))), ["meeting_id"], keep_old=("flag",))


_SYNC = """WITH s AS (SELECT o_orderkey AS k, o_orderstatus = 'P' AS l, o_orderpriority AS v FROM orders WHERE o_orderdate < TIMESTAMP '2000-06-01'),
 i AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE 'changed' END AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1999-06-01'),
 j AS (SELECT coalesce(s.k, i.k) AS meeting_id, s.k IS NULL AS fresh, i.k IS NULL AS gone, l, s.v AS old, coalesce(nullif(i.v, ''), s.v) AS new FROM s FULL JOIN i ON s.k = i.k),
 a AS (SELECT *, CASE WHEN fresh THEN 'insert' WHEN gone THEN 'untouched' WHEN l THEN 'skip_locked' WHEN new IS NOT DISTINCT FROM old THEN 'preserved' ELSE 'update' END AS action FROM j) """


def _sync(spark, d):
    old, new = _halves(spark, d)
    k = F.col("meeting_id") % 3
    return merge.sync_actions(old.withColumn("locked", F.col("flag") == "P"), new.withColumn("label", F.when(k == 0, "").when(k == 1, F.col("label")).otherwise("changed")), "meeting_id", "locked", "label")


@query(_SYNC + "SELECT meeting_id, action, CASE WHEN action IN ('insert', 'update') THEN new ELSE old END AS label FROM a")
def sync_actions(spark, d):
    return _sync(spark, d)


@query(_SYNC + "SELECT action, count(*) AS n FROM a GROUP BY 1")
def sync_stats(spark, d):
    return _sync(spark, d).groupBy("action").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT user_id AS k, arg_max(event_type, event_id) AS v FROM events GROUP BY 1)
 SELECT c_custkey AS council_id, CASE WHEN c_acctbal >= 0 AND v IS NOT NULL THEN v ELSE c_mktsegment END AS category FROM customer LEFT JOIN l ON k = c_custkey""")
def apply_corrections(spark, d):
    log = attempts(spark, d).select("council_id", "seq", F.col("kind").alias("new_value"))
    return merge.apply_corrections(councils(spark, d), log, "council_id", "category", F.col("stored") < 0).select("council_id", "category")


@query("""SELECT 'meetings' AS level, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey <> 3
 UNION ALL SELECT 'materials', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3)
 UNION ALL SELECT 'councils', count(*) FROM customer WHERE c_nationkey <> 3""")
def cascade_delete(spark, d):
    c = councils(spark, d)
    parts = merge.cascade_delete(c, meetings(spark, d), materials(spark, d), c.filter("ministry = 3").select("council_id"), "council_id", "meeting_id")
    named = [p.agg(F.count("*").alias("n")).select(F.lit(x).alias("level"), "n") for x, p in zip(("councils", "meetings", "materials"), parts)]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("""WITH b AS (SELECT user_id AS k, arg_max(event_type, event_id) AS v FROM events GROUP BY 1) SELECT c_custkey AS council_id, coalesce(v, c_mktsegment) AS category FROM customer LEFT JOIN b ON k = c_custkey""")
def status_update(spark, d):
    batch = attempts(spark, d).select("council_id", "seq", F.col("kind").alias("category"))
    return merge.status_update(councils(spark, d).select("council_id", "category"), batch, ["council_id"], "category")


@query("SELECT user_id AS council_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def last_wins(spark, d):
    return merge.last_wins(attempts(spark, d), ["council_id"], [F.desc("ts"), F.desc("seq")]).select("council_id", "value")


@query("""SELECT o_orderkey AS meeting_id, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderpriority <> '1-URGENT' THEN false ELSE o_orderstatus = 'O' END AS is_new FROM orders""")
def reset_flags(spark, d):
    rows = meetings(spark, d).withColumn("is_new", F.col("flag") == "O")
    return merge.reset_flags(rows, councils(spark, d).filter("category = 'BUILDING'"), "council_id", "is_new", F.col("label") == "1-URGENT").select("meeting_id", "is_new")


_B, _A = "o_orderdate < TIMESTAMP '2000-06-01'", "o_orderdate >= TIMESTAMP '1999-06-01'"


@query(f"SELECT DISTINCT o_custkey AS council_id FROM orders WHERE {_B} EXCEPT SELECT o_custkey FROM orders WHERE {_A}")
def set_diff(spark, d):
    a, b = (x.select("council_id") for x in _halves(spark, d))
    return a.join(b, "council_id", "left_anti").distinct()


@query(f"SELECT o_custkey AS council_id FROM orders WHERE {_B} INTERSECT SELECT o_custkey FROM orders WHERE {_A}")
def set_intersect(spark, d):
    a, b = (x.select("council_id") for x in _halves(spark, d))
    return a.intersect(b)


@query("SELECT o_orderkey AS meeting_id, 'active' AS segment FROM orders WHERE o_orderdate >= TIMESTAMP '2000-06-01' UNION ALL SELECT o_orderkey, 'archive' FROM orders WHERE o_orderdate < TIMESTAMP '2000-06-01'")
def union_all(spark, d):
    m = meetings(spark, d)
    active = m.filter("date >= timestamp '2000-06-01'").select("meeting_id", F.lit("active").alias("segment"))
    return active.unionByName(m.filter(_OLD).select("meeting_id", F.lit("archive").alias("segment")))


@query(f"SELECT council_id FROM (SELECT o_custkey AS council_id, bool_or({_B}) AS b, bool_or({_A}) AS a FROM orders GROUP BY 1) WHERE a <> b")
def sym_diff(spark, d):
    """One aggregate in place of two differences and a union."""
    seen = meetings(spark, d).groupBy("council_id").agg(F.bool_or(F.expr(_OLD)).alias("b"), F.bool_or(F.expr(_NEW)).alias("a"))
    return seen.filter("a <> b").select("council_id")


_DIFF = f"""WITH n AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'F') AS f FROM lineitem GROUP BY 1),
 b AS (SELECT o_orderkey, coalesce(f, 0) AS n FROM orders LEFT JOIN n ON k = o_orderkey WHERE {_B}), a AS (SELECT o_orderkey, coalesce(n, 0) AS n FROM orders LEFT JOIN n ON k = o_orderkey WHERE {_A}),
 x AS (SELECT coalesce(b.o_orderkey, a.o_orderkey) AS meeting_id, CASE WHEN b.o_orderkey IS NULL THEN 'new' WHEN a.o_orderkey IS NULL THEN 'removed' ELSE 'kept' END AS change, greatest(0, coalesce(a.n, 0) - coalesce(b.n, 0)) AS added FROM b FULL JOIN a ON b.o_orderkey = a.o_orderkey) """


def _snapshots(spark, d):
    n = materials(spark, d).groupBy("meeting_id").agg(F.count("*").alias("all"), F.count_if(F.col("download_status") == "F").alias("f"))
    old, new = (x.select("meeting_id").join(n, "meeting_id", "left") for x in _halves(spark, d))
    return merge.snapshot_diff(old.select("meeting_id", F.coalesce("f", F.lit(0)).alias("n")), new.select("meeting_id", F.coalesce("all", F.lit(0)).alias("n")), "meeting_id", "n")


@query(_DIFF + "SELECT * FROM x")
def snapshot_diff(spark, d):
    return _snapshots(spark, d)


@query(_DIFF + "SELECT change AS metric, count(*) AS value FROM x GROUP BY 1 UNION ALL SELECT 'added', CAST(sum(added) AS BIGINT) FROM x")
def diff_report(spark, d):
    x = _snapshots(spark, d)
    return x.groupBy(F.col("change").alias("metric")).agg(F.count("*").alias("value")).unionByName(x.agg(F.sum("added").alias("value")).select(F.lit("added").alias("metric"), "value"))


@query("SELECT o_orderkey AS meeting_id, count(l_orderkey) AS materials FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def snapshot(spark, d):
    n = materials(spark, d).groupBy("meeting_id").agg(F.count("*").alias("materials"))
    return meetings(spark, d).select("meeting_id").join(n, "meeting_id", "left").fillna(0, ["materials"])


@query("SELECT o_orderkey AS meeting_id, count(l_orderkey) AS n, coalesce(string_agg(l_linenumber || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag), '') AS children FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def nest_children(spark, d):
    nested = documents.nest_children(meetings(spark, d).select("meeting_id"), materials(spark, d), "meeting_id", "children", ["line", "type"], ["line", "type"])
    label = F.array_join(F.transform("children", lambda x: F.concat(x["line"].cast("string"), x["type"])), ",")
    return nested.select("meeting_id", F.size("children").cast("long").alias("n"), label.alias("children"))


@query("SELECT l_orderkey AS meeting_id, l_returnflag AS type, min(l_linenumber) AS line FROM lineitem GROUP BY 1, 2")
def flatten_children(spark, d):
    """The nested form flattened again, the first of each type winning."""
    nested = documents.nest_children(meetings(spark, d).select("meeting_id"), materials(spark, d), "meeting_id", "children", ["line", "type"], ["line", "type"])
    return documents.flatten_children(nested, "meeting_id", "children", ["meeting_id", "type"]).select("meeting_id", "type", "line")


@query("""SELECT DISTINCT s_suppkey AS k, 'orphan' AS state FROM supplier WHERE s_suppkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = s_suppkey)
 UNION ALL SELECT DISTINCT o_custkey, 'missing' FROM orders WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = o_custkey)""")
def missing_and_orphans(spark, d):
    """All meetings' councils against all suppliers."""
    parents = meetings(spark, d).select(F.col("council_id").alias("k"))
    return merge.missing_and_orphans(parents, read(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), "k")


@query("SELECT 'orders' AS name, count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM orders UNION ALL SELECT 'lineitem', count(*), count(DISTINCT l_orderkey) FROM lineitem UNION ALL SELECT 'customer', count(*), count(DISTINCT c_custkey) FROM customer")
def reconcile_counts(spark, d):
    one = lambda df, name, key: df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys")).select(F.lit(name).alias("name"), "n", "keys")
    return one(meetings(spark, d), "orders", "meeting_id").unionByName(one(materials(spark, d), "lineitem", "meeting_id")).unionByName(one(councils(spark, d), "customer", "council_id"))


@query("SELECT o_orderkey AS meeting_id, CASE WHEN o_orderdate >= DATE '2001-08-01' - INTERVAL 730 DAY THEN 'active' ELSE 'archive' END AS segment, strftime(o_orderdate, '%Y/%m/%d') AS date FROM orders", name="export_public")
def export_public(spark, d):
    rows = meetings(spark, d).select("meeting_id", F.date_format("date", "yyyy/MM/dd").alias("date"), F.lit(True).alias("manual_lock"))
    return documents.public_view(rows, "2001-08-01").select("meeting_id", "segment", "date")


@query("SELECT o_custkey || ':' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")
def lock_list(spark, d):
    rows = meetings(spark, d).withColumn("manual_lock", F.expr("flag = 'P' and label = '1-URGENT'"))
    return documents.locks(rows, F.concat_ws(":", "council_id", "meeting_id"))
