"""Entities, duplicates, pages and URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from minuteloom.batches import in_batches, spread
from minuteloom.functions import text, urls
from minuteloom.operators import entity
from minuteloom.plans.base import query
from minuteloom.schema import councils, materials, meetings, read
from minuteloom.sources import html


@query("SELECT o_custkey AS council_id, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def dup_sameday(spark, d):
    return entity.duplicate_keys(meetings(spark, d), [F.col("council_id"), F.to_date("date").alias("day")])


@query("""WITH m AS (SELECT o_orderkey AS k, o_custkey % 20 AS c, strftime(o_orderdate, '%Y/%m') AS date, o_orderkey % 3 AS r, o_orderkey % 4 AS b FROM orders), p AS (SELECT *, CASE WHEN k % 5 <> 0 THEN 'https://e.go.jp/c' || c || '/' || CASE b WHEN 0 THEN 'Dai' || r WHEN 1 THEN 'r05_dai' || r ELSE 'x' || r END || '/p' || k % 9 || '.html' END AS page FROM m)
 SELECT c AS council_id, 'url' AS kind, date, page AS key, count(*) AS n, min(k) AS first FROM p WHERE page IS NOT NULL GROUP BY 1, 3, 4 HAVING count(*) > 1 UNION ALL SELECT c, 'round', date, r || CASE b WHEN 1 THEN '部会' WHEN 2 THEN 'WG' ELSE '' END, count(*), min(k) FROM p WHERE b <> 3 GROUP BY 1, 3, 4 HAVING count(*) > 1
 UNION ALL SELECT c, 'directory', date, lower('/c' || c || '/' || CASE b WHEN 0 THEN 'dai' ELSE 'r05_dai' END || r), count(*), min(k) FROM p WHERE page IS NOT NULL AND b < 2 GROUP BY 1, 3, 4 HAVING count(*) > 1""")
def split_meetings(spark, d):
    """Pages, rounds of one body and directories that a council has twice in a month, but for its own page."""
    k, c = F.col("meeting_id"), F.col("council_id") % 20
    site = F.concat(F.lit("https://e.go.jp/c"), c)
    folder = F.when(k % 4 == 0, F.concat(F.lit("Dai"), k % 3)).when(k % 4 == 1, F.concat(F.lit("r05_dai"), k % 3)).otherwise(F.concat(F.lit("x"), k % 3))
    body = F.when(k % 4 == 1, "保険部会").when(k % 4 == 2, "医療WG").otherwise("検討会")
    name = F.when(k % 4 == 3, "検討会").otherwise(F.concat(F.lit("第 "), k % 3, F.lit("回 "), body))
    rows = meetings(spark, d).select("meeting_id", c.alias("council_id"), name.alias("name"), F.date_format("date", "yyyy/MM").alias("date"), F.when(k % 5 == 0, F.concat(site, F.lit("/"))).otherwise(F.concat(site, F.lit("/"), folder, F.lit("/p"), k % 9, F.lit(".html"))).alias("url"))
    return entity.split_meetings(rows, rows.select("council_id").distinct().withColumn("official_url", F.concat(F.lit("https://e.go.jp/c"), "council_id")))


@query("SELECT o_custkey AS council_id, o_orderpriority AS label, o_orderstatus AS flag, count(*) AS n FROM orders GROUP BY 1, 2, 3 HAVING count(*) > 1")
def dup_keys(spark, d):
    return entity.duplicate_keys(meetings(spark, d), [F.col("council_id"), F.col("label"), F.col("flag")])


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first, CAST(max(strlen(text)) AS BIGINT) AS size, CAST((count(*) - 1) * max(strlen(text)) AS BIGINT) AS wasted FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dups(spark, d):
    return entity.exact_duplicates(read(spark, d, "documents").select("doc_id", "text"), "doc_id", F.col("text"))


@query("SELECT p_partkey AS part, count(DISTINCT l_orderkey) AS meetings FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 25")
def shared_children(spark, d):
    """Materials that several meetings share."""
    return materials(spark, d).groupBy("part").agg(F.count_distinct("meeting_id").alias("meetings")).filter("meetings > 25")


@query("""SELECT council_id, part, meeting_id FROM (SELECT o_custkey AS council_id, l_partkey AS part, o_orderkey AS meeting_id, row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY l_quantity DESC, o_orderkey, l_linenumber) AS r,
 count(*) OVER (PARTITION BY o_custkey, l_partkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE r = 1 AND n > 1""")
def best_duplicate(spark, d):
    """Of materials repeated in a council, the one with the best score (ties: the first meeting) stays."""
    from pyspark.sql.window import Window

    key = Window.partitionBy("council_id", "part")
    rows = meetings(spark, d).select("meeting_id", "council_id").join(materials(spark, d), "meeting_id")
    ranked = rows.withColumn("r", F.row_number().over(key.orderBy(F.desc("file_size"), "meeting_id", "line"))).withColumn("n", F.count("*").over(key))
    return ranked.filter("r = 1 and n > 1").select("council_id", "part", "meeting_id")


@query("SELECT page_id, CAST(i - 1 AS BIGINT) AS position, hrefs[i] AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS hrefs FROM pages), unnest(range(1, len(hrefs) + 1)) AS t(i)")
def page_links(spark, d):
    return html.page_links(read(spark, d, "pages")).withColumn("position", F.col("position").cast("long"))


@query("""WITH u AS (SELECT page_id, list_transform(regexp_extract_all(url, '([0-9]+)', 1), lambda x: CAST(x AS BIGINT)) AS n FROM pages)
 SELECT page_id, coalesce(n[-1], -1) AS last_number, coalesce(list_max(n), -1) AS max_number FROM u""")
def url_recency_sort(spark, d):
    n = urls.numbers(F.col("url"))
    return read(spark, d, "pages").select("page_id", F.coalesce(F.element_at(F.when(F.size(n) > 0, n), -1), F.lit(-1)).alias("last_number"), F.coalesce(F.array_max(n), F.lit(-1)).alias("max_number"))


@query("""SELECT host, page_id FROM (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, page_id, row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/?#]+)', 1) ORDER BY coalesce(CAST(nullif(regexp_extract(url, '([0-9]+)[^0-9]*$', 1), '') AS BIGINT), -1) DESC, page_id) AS r FROM pages) WHERE r <= 2""")
def url_recency_topk(spark, d):
    from minuteloom.operators.analytics import first_per_key

    n = urls.numbers(F.col("url"))
    rows = read(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.coalesce(F.element_at(F.when(F.size(n) > 0, n), -1), F.lit(-1)).alias("last"))
    return first_per_key(rows, ["host"], [F.desc("last"), F.asc("page_id")], 2).select("host", "page_id")


@query("""SELECT page_id, regexp_matches(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '(twitter|facebook|youtube|instagram|line)\\.(com|me)|x\\.com') AS is_news_host, ends_with(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '.go.jp') AS is_government, contains(url, '?') AS has_query,
 regexp_matches(url, '/(index|press|news)') AS is_index FROM pages""")
def url_flags(spark, d):
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", urls.is_news_host(u).alias("is_news_host"), urls.is_government(u).alias("is_government"), F.contains(u, F.lit("?")).alias("has_query"), u.rlike("/(index|press|news)").alias("is_index"))


@query("""SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) || regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') AS clean_key FROM pages""")
def url_clean_key(spark, d):
    return read(spark, d, "pages").select("page_id", urls.clean_key(F.col("url")).alias("clean_key"))


@query("""SELECT clean_key, min(page_id) AS page_id, count(*) AS n FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) || regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') AS clean_key FROM pages) GROUP BY 1""")
def url_rule_index(spark, d):
    """The first page of each normalised URL."""
    return read(spark, d, "pages").select("page_id", urls.clean_key(F.col("url")).alias("clean_key")).groupBy("clean_key").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


_GRAMS = "(SELECT DISTINCT k, b, substr(s, CAST(i AS INTEGER), 2) AS g FROM (SELECT {k} AS k, {b} AS b, regexp_replace({t}, '[\\s0-9]+', '', 'g') AS s FROM {f}), unnest(range(1, length(s))) AS t(i))"


@query(f"""WITH i AS {_GRAMS.format(k="p_partkey", b="p_brand", t="p_name", f="part WHERE p_size <= 10")}, n AS {_GRAMS.format(k="p_partkey", b="p_brand", t="p_name", f="part WHERE p_size > 10")},
 z AS (SELECT k, count(*) AS size FROM n GROUP BY 1), p AS (SELECT i.k AS item, n.k AS name, count(*) AS overlap FROM i JOIN n ON i.b = n.b AND i.g = n.g GROUP BY 1, 2),
 r AS (SELECT item, name, overlap, row_number() OVER (PARTITION BY item ORDER BY overlap / size DESC, overlap DESC, name) AS rank FROM p JOIN z ON z.k = name) SELECT * FROM r WHERE rank <= 3""")
def similar_bigrams(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_brand", "p_name", "p_size")
    items = p.filter("p_size <= 10").select(F.col("p_partkey").alias("item"), "p_brand", "p_name")
    names = p.filter("p_size > 10").select(F.col("p_partkey").alias("name"), "p_brand", "p_name")
    return entity.similar_names(items, names, "item", "name", ["p_brand"], F.col("p_name"), F.col("p_name")).select("item", "name", "overlap", F.col("rank").cast("long").alias("rank"))


@query("""WITH t AS (SELECT page_id, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, page_id % 25 AS m FROM pages), w AS (SELECT DISTINCT n_nationkey AS m, lower(w) AS w FROM nation, (VALUES ('the'), ('that'), ('with'), ('eation'), ('est'), ('les'), ('que')) AS v(w))
 SELECT page_id, w AS name FROM (SELECT page_id, w, row_number() OVER (PARTITION BY page_id ORDER BY length(w) DESC, w) AS r FROM t JOIN w USING (m) WHERE contains(title, w)) WHERE r = 1""")
def entity_match(spark, d):
    """Names contained in a page's title, within its block; the longest wins."""
    from minuteloom.operators.analytics import first_per_key

    titles = read(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), (F.col("page_id") % 25).cast("int").alias("m"))
    words = F.array(*[F.lit(w) for w in ("the", "that", "with", "eation", "est", "les", "que")])
    names = read(spark, d, "nation").select(F.col("n_nationkey").alias("m"), F.explode(words).alias("name"))
    met = titles.join(names, "m").filter(F.contains("title", F.col("name")))
    return first_per_key(met, ["page_id"], [F.length("name").desc(), F.asc("name")]).select("page_id", "name")


@query("""WITH n AS (SELECT p_partkey AS k, p_brand AS b, regexp_extract(p_name, '([a-z]+) ([a-z]+)', 2) AS s, p_name AS name FROM part WHERE length(p_name) >= 4)
 SELECT DISTINCT l.name AS long_name, s.s AS short_name FROM n AS l JOIN n AS s ON l.b = s.b AND ends_with(l.name, s.s) AND NOT starts_with(l.name, s.s) AND length(l.name) > length(s.s) AND length(s.s) >= 4""")
def suffix_twins(spark, d):
    p = read(spark, d, "part").select("p_brand", "p_name").distinct()
    names = p.unionByName(p.select("p_brand", F.regexp_extract("p_name", "([a-z]+) ([a-z]+)", 2).alias("p_name")).distinct()).distinct().filter(F.length("p_name") >= 4)
    keyed = names.withColumn("key", F.col("p_name"))
    twins = entity.suffix_twins(keyed, "p_brand", "key", "p_name", [""])
    return twins.filter(F.contains("long_key", F.lit(" ")) & ~F.contains("short_key", F.lit(" "))).select(F.col("long_key").alias("long_name"), F.col("short_key").alias("short_name")).distinct()


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the')")
def nfkc_search(spark, d):
    """Documents that hold a word whatever its width and case; the SQL knows no wide letters, and the texts have none of that word."""
    return in_batches(read(spark, d, "documents").select("doc_id", "text")).filter(F.contains(text.search_text(F.col("text")), F.lit("the"))).select("doc_id")


@query()
def title_consistency(spark, d):
    rows = meetings(spark, d).join(councils(spark, d), "council_id")
    return entity.inconsistent_titles(rows, F.col("label"), F.col("category")).select("meeting_id", "ratio", "inconsistent")


@query("SELECT DISTINCT doc_id, lower(substr(text, CAST(i AS INTEGER), 3)) AS trigram FROM documents, unnest(range(1, greatest(length(text) - 1, 1))) AS t(i) WHERE length(text) >= 3")
def trigram_index(spark, d):
    """Every trigram of every document, once each."""
    docs = spread(read(spark, d, "documents").filter(F.length("text") >= 3).select("doc_id", "text"), "doc_id")
    # A text is cut into characters once: to find its i-th place anew for each gram costs the square of its length.
    grams = text.let(F.split("text", ""), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.lower(F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2)))))
    return docs.select("doc_id", F.explode(F.array_distinct(grams)).alias("trigram"))
