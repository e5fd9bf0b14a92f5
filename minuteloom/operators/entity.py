"""Entity matching and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minuteloom.functions import text, urls
from minuteloom.functions.udf import matching_ratio
from minuteloom.rounds import cut


#: Rarest grams of a name by which its first candidates are found.
RARE = 2


def similar_names(items: DataFrame, names: DataFrame, item_key: str, name_key: str, block: list[str], item_text: Column, name_text: Column, k: int = 3, grams=text.bigrams) -> DataFrame:
    """(item, name, overlap, score, rank): the k names of the same block with the largest share of their bigrams in the item; ties by overlap, then by the smaller key.

    The grams of a name are ordered from the rarest among the block's names on. An item first meets the names whose RARE rarest grams it has; the k-th best share
    among these is one that it surely reaches. A name of n grams with a share of s or more has n s of them at least in the item, so one of its
    first n - n s + 1, and only by these the item meets others. Names with the same bigrams, and items with the same, are compared once as a
    class, and a class of names stands for the k smallest keys it has.
    """
    def classes(rows, key, said, keys):
        each = rows.select(F.col(key).alias("key"), *block, F.array_sort(grams(said)).alias("grams"))
        return each.groupBy(*block, "grams").agg(keys.alias("keys")).withColumn("class", F.xxhash64(*block, "grams"))

    n = classes(names, name_key, name_text, F.slice(F.array_sort(F.collect_set("key")), 1, k)).select(F.col("class").alias("b"), *block, "grams", "keys").filter("size(grams) > 0")
    i = classes(items, item_key, item_text, F.count("*")).select(F.col("class").alias("a"), *block, F.col("grams").alias("own"))
    n, i = cut(n), cut(i)
    each = n.select("b", *block, F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    common = each.groupBy(*block, "gram").agg(F.count("*").alias("n"))
    at = F.row_number().over(Window.partitionBy("b").orderBy("n", "gram"))  # a name's own grams
    placed = cut(each.join(common, [*block, "gram"]).withColumn("at", at).select("b", *block, "size", "gram", "at"))
    left = i.select("a", *block, F.explode("own").alias("gram"))

    def scored(pairs: DataFrame) -> DataFrame:
        both = pairs.join(i.select("a", "own"), "a").join(n.select("b", "grams", "keys"), "b")
        overlap = F.size(F.array_intersect("own", "grams"))
        return both.select("a", "b", overlap.cast("long").alias("overlap"), (overlap / F.size("grams")).alias("score"), "keys")

    first = cut(scored(left.join(placed.filter(F.col("at") <= RARE), [*block, "gram"]).select("a", "b").distinct()))
    # A class of several names counts as many times.
    reach = first.select("a", "score", F.explode(F.sequence(F.lit(1), F.size("keys")))).withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score")))).filter(F.col("r") == k).select("a", F.col("score").alias("reach"))
    within = F.col("at") <= F.col("size") - F.ceil(F.coalesce("reach", F.lit(0.0)) * F.col("size") - 1e-9) + 1
    more = left.join(reach, "a", "left").join(placed.filter(F.col("at") > RARE), [*block, "gram"]).filter(within).select("a", "b").distinct().join(first.select("a", "b"), ["a", "b"], "left_anti")
    every = first.unionByName(scored(more)).select("a", "overlap", "score", F.explode("keys").alias(name_key))
    order = Window.partitionBy("a").orderBy(F.desc("score"), F.desc("overlap"), name_key)
    best = every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    own = items.select(item_key, F.xxhash64(*block, F.array_sort(grams(item_text))).alias("a"))
    return own.join(best, "a").select(item_key, name_key, "overlap", "score", "rank")


def _class(said: Column) -> Column:
    """The largest power of two that a text's length reaches: the length of the windows that it is found by."""
    return F.call_function("shiftleft", F.lit(1), F.length(F.bin(F.length(said))) - 1)


def _windows(block: Column, said: Column, sizes: Column) -> Column:
    """Hashes of the distinct windows of a text, of the lengths in an array; those of different blocks are apart."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(said) - n + 1), lambda k: F.xxhash64(block, F.substring(said, k, n)))
    return F.array_distinct(F.flatten(F.transform(F.filter(sizes, lambda n: n <= F.length(said)), of)))


def _rarest(texts: DataFrame, by: list[str], counted: DataFrame) -> DataFrame:
    """(*by, w) of texts (*by, w): the window that fewest of the counted rows (w) have; a text with a window that none has is left out."""
    counts = counted.groupBy("w").agg(F.count("*").alias("n"))
    each = texts.join(counts, "w", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return each.groupBy(*by).agg(F.min_by("w", F.struct("n", "w")).alias("w"), F.min("n").alias("n")).filter("n > 0").drop("n")


def _above(path: Column) -> Column:
    """The directories that a directory lies in: /a/b of /a/b/c, and so on up."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def _runs(path: Column) -> Column:
    """All runs of whole parts of a path, each with its slash in front: of /a/b /a, /b and /a/b."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    n = F.size(parts)
    of = lambda i: F.transform(F.sequence(F.lit(1), n - i), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, i + 1, k), "/")))
    return F.when(n > 0, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), of)))).otherwise(F.array().cast("array<string>"))


def match_councils(items: DataFrame, councils: DataFrame) -> DataFrame:
    """(item_id, council_id, reason) by priority: equal URL, own directory, bracketed name, name in the title, part of a bracketed name, directory of a parent.

    items: item_id, ministry, title, url; councils: council_id, ministry, name, official_url, is_closed. Within a rule open councils,
    longer directories and longer names go first, then the smaller id. Items and councils of a ministry meet on equal keys alone: on a directory
    of the item's address, or on a window of characters: of the windows of a name, half as long as it at least, the one that is rarest among the ministry's
    names, and likewise of a bracket. Texts, names and brackets that are equal meet as one, and of councils that only an id tells apart the first does.
    """
    squeeze = lambda c: F.replace(text.normal_text(c), F.lit(" "), F.lit(""))
    c = councils.select("council_id", F.col("ministry").alias("c_ministry"), F.regexp_replace("official_url", "/+$", "").alias("c_url"), squeeze(F.col("name")).alias("c_name"), (~F.coalesce("is_closed", F.lit(False))).alias("is_open"), urls.host(F.col("official_url")).alias("c_host"), F.regexp_replace(F.try_parse_url("official_url", F.lit("PATH")), "/[^/]*$", "").alias("c_dir"))
    dirs = c.filter(F.length("c_dir") > 10).select("c_ministry", "c_host", F.col("c_dir").alias("child")).distinct()
    parents = dirs.withColumn("c_dir", F.explode(_above(F.col("child")))).select("c_ministry", "c_host", "c_dir").distinct().withColumn("has_child", F.lit(True))
    c = c.join(parents, ["c_ministry", "c_host", "c_dir"], "left")
    title = squeeze(F.col("title"))
    i = items.select("item_id", "ministry", F.regexp_replace("url", "/+$", "").alias("url"), title.alias("title"), urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"))
    i = i.withColumns({"bare": F.regexp_replace("title", r"第\d+回", ""), "brackets": F.regexp_extract_all("title", F.lit("[「『【]([^」』】]+)[」』】]"), F.lit(1))})
    i, c = cut(i), cut(c)
    # Of the councils of one address or directory the first is enough, as names are asked for apart.
    open_first = F.struct(~F.col("is_open"), -F.coalesce(F.length("c_name"), F.lit(0)), "council_id")
    first_of = lambda *by: c.groupBy(*by).agg(F.min_by(F.struct(*[x for x in c.columns if x not in by]), open_first).alias("__c")).select(*by, "__c.*")
    exact = i.join(first_of("c_url"), F.col("url") == F.col("c_url")).withColumn("rule", F.lit(1)).withColumn("reason", F.lit("URL_EXACT"))
    # Candidates by directory: every run of whole parts of the path, as a council's directory may stand anywhere in it.
    by_dir = first_of("c_ministry", "c_host", "c_dir")
    placed = i.withColumn("part", F.explode(_runs(F.col("path")))).join(by_dir, (F.col("ministry") == F.col("c_ministry")) & (F.col("host") == F.col("c_host")) & (F.col("part") == F.col("c_dir"))).drop("part")
    # Candidates by name: a name is found by its rarest window in a text that holds it, and a bracket by its own in a name that holds it.
    ministry, name = F.col("ministry"), F.col("name")
    named = c.filter(F.length("c_name") >= 1).groupBy(F.col("c_ministry").alias("ministry"), F.col("c_name").alias("name")).agg(F.min(F.struct(~F.col("is_open"), "council_id")).alias("first")).filter("ministry is not null")
    own = named.select("ministry", "name", F.explode(_windows(ministry, name, F.array(_class(name)))).alias("w"))
    rare = _rarest(own, ["ministry", "name"], own)
    lengths = named.groupBy("ministry").agg(F.collect_set(_class(name)).alias("sizes"))
    texts = i.select("ministry", "title", "bare").distinct().join(lengths, "ministry")
    said = texts.select("ministry", "title", "bare", F.explode(F.array_union(_windows(ministry, F.col("title"), F.col("sizes")), _windows(ministry, F.col("bare"), F.col("sizes")))).alias("w"))
    held = said.join(rare.select("w", "name"), "w").filter(F.contains("title", name) | F.contains("bare", name)).select("ministry", "title", "name").distinct()
    within = i.select("item_id", "ministry", "title").join(held.join(named, ["ministry", "name"]).select("ministry", "title", "first.council_id"), ["ministry", "title"]).select("item_id", "council_id")
    brackets = i.select("item_id", "ministry", F.explode("brackets").alias("b")).filter("b <> ''")
    b = F.col("b")
    asked = brackets.select("ministry", "b").distinct()
    sizes = asked.groupBy("ministry").agg(F.collect_set(_class(b)).alias("sizes"))
    holders = named.join(sizes, "ministry").select("ministry", "name", "first", F.explode(_windows(ministry, name, F.col("sizes"))).alias("w"))
    sought = _rarest(asked.select("ministry", "b", F.explode(_windows(ministry, b, F.array(_class(b)))).alias("w")), ["ministry", "b"], holders)
    # How close a name is to an item's brackets is told by its length, so of each length the first is enough.
    around = sought.join(holders.select("w", "name", "first"), "w").filter(F.contains(name, b)).groupBy("ministry", "b", F.length(name).alias("size")).agg(F.min("first").alias("first"))
    around = brackets.join(around, ["ministry", "b"]).select("item_id", "first.council_id")
    near = placed.unionByName(i.join(within.unionByName(around), "item_id").join(c, "council_id").select(*placed.columns))
    under = (F.col("host") == F.col("c_host")) & (F.length("c_dir") > 10) & (F.contains(F.col("path"), F.concat(F.col("c_dir"), F.lit("/"))) | (F.col("path") == F.col("c_dir")))
    has_name = F.length("c_name") >= 1
    rule = (
        F.when(under & F.col("has_child").isNull(), 2)
        .when(has_name & F.array_contains("brackets", F.col("c_name")), 3)
        .when((F.length("c_name") >= 4) & (F.contains("title", F.col("c_name")) | F.contains("bare", F.col("c_name"))), 4)
        .when(has_name & F.exists("brackets", lambda x: F.contains(x, F.col("c_name")) | F.contains(F.col("c_name"), x)), 5)
        .when(under, 6)
    )
    reasons = F.create_map(*[F.lit(x) for x in (2, "URL_PATH_MATCH", 3, "BRACKET_NAME", 4, "TEXT_CONTAINS", 5, "BRACKET_NAME", 6, "URL_PATH_MATCH")])
    found = near.withColumn("rule", rule).filter("rule is not null").withColumn("reason", reasons[F.col("rule")])
    dir_length = F.when(F.col("rule").isin(2, 6), F.length("c_dir")).otherwise(0)
    closeness = F.when(F.col("rule") == 5, F.array_max(F.transform("brackets", lambda x: -F.abs(F.length(x) - F.length("c_name"))))).otherwise(0)
    order = Window.partitionBy("item_id").orderBy("rule", F.desc("is_open"), dir_length.desc(), closeness.desc(), F.length("c_name").desc(), "council_id")
    return exact.unionByName(found, allowMissingColumns=True).withColumn("r", F.row_number().over(order)).filter("r = 1").select("item_id", "council_id", "reason")


def inconsistent_titles(pairs: DataFrame, title: Column, name: Column, least: float = 0.40) -> DataFrame:
    """Adds `ratio` and `inconsistent`: the title's likeness to the council's name is below the least, or there is no title."""
    return pairs.withColumn("ratio", matching_ratio(title, name)).withColumn("inconsistent", (F.coalesce(title, F.lit("")) == "") | (F.col("ratio") < least))


def suffix_twins(names: DataFrame, block: str, key: str, name: str, words: list[str]) -> DataFrame:
    """Pairs of a block where one name (4 characters or more) ends with the other and doesn't start with it, both with a body word.

    Joined on the last characters of the shorter name's length class, so only names with equal ends meet.
    """
    body = F.lit(False)
    for w in words:
        body = body | F.contains(F.col(name), F.lit(w))
    n = names.filter((F.length(name) >= 4) & body).select(block, key, name).withColumn("end", F.substring(F.col(name), F.length(name) - 3, F.lit(4)))
    a, b = n.alias("a"), n.alias("b")
    on = (F.col(f"a.{block}") == F.col(f"b.{block}")) & (F.col("a.end") == F.col("b.end")) & (F.col(f"a.{key}") != F.col(f"b.{key}"))
    longer = F.endswith(F.col(f"a.{name}"), F.col(f"b.{name}")) & (F.length(f"a.{name}") > F.length(f"b.{name}")) & ~F.startswith(F.col(f"a.{name}"), F.col(f"b.{name}"))
    return a.join(b, on).filter(longer).select(F.col(f"a.{key}").alias("long_key"), F.col(f"b.{key}").alias("short_key"))


def exact_duplicates(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """Groups of equal content: rows of equal length and equal SHA-256, in one aggregate; only the digest and length are moved."""
    size, digest = F.octet_length(content).cast("long"), F.sha2(content.cast("binary"), 256)
    groups = rows.filter(content.isNotNull()).groupBy(size.alias("size"), digest.alias("digest")).agg(F.count("*").alias("n"), F.min(key).alias("first")).filter("n > 1")
    return groups.select("digest", "n", "first", "size", ((F.col("n") - 1) * F.col("size")).alias("wasted"))


# Bodies of a council that meet apart, in the order in which a title is asked for them; a directory of one meeting.
OWN_BODIES = ("幹事会", "懇談会", "作業部会", "ワーキンググループ", "WG", "専門委員会", "専門調査会", "分科会", "部会", "小委員会")
OWN_DIRECTORY = r"(?i)/(?:dai|round|kai|r0[0-9]_dai)[0-9]+"


def split_meetings(meetings: DataFrame, councils: DataFrame) -> DataFrame:
    """(council_id, kind, date, key, n, first): what a council has several times on a day: a page (url), a round of one body (round), a directory of one meeting (directory).

    meetings: meeting_id, council_id, name, date, url. councils: council_id, official_url. The council's own page is no meeting's, and rows without a page or round have no such key.
    """
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "/+$", "")
    rows = meetings.join(councils.select("council_id", bare("official_url").alias("parent")), "council_id", "left").withColumn("page", bare("url"))
    own = F.when((F.col("page") != "") & (F.col("page") != F.coalesce("parent", F.lit(""))), F.col("page"))
    number = F.nullif(F.regexp_extract(F.coalesce("name", F.lit("")), r"第\s*([0-9]+)\s*回", 1), F.lit("")).try_cast("long").cast("string")
    body = F.coalesce(*[F.when(F.contains("name", F.lit(w)), F.lit(w)) for w in OWN_BODIES], F.lit(""))
    folder = F.lower(F.regexp_replace(urls.path(own), "/[^/]*$", ""))
    keys = {"url": own, "round": F.concat(number, body), "directory": F.when(folder.rlike(OWN_DIRECTORY), folder)}
    each = rows.select("council_id", F.coalesce("date", F.lit("")).alias("date"), "meeting_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in keys.items()])).alias("x")).filter("x.key is not null")
    return each.groupBy("council_id", "x.kind", "date", "x.key").agg(F.count("*").alias("n"), F.min("meeting_id").alias("first")).filter("n > 1")


def duplicate_keys(rows: DataFrame, keys: list[Column]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
