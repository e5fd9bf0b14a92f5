"""Scraping rules: templates and overrides, and which rule a target has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minuteloom.functions import urls
from minuteloom.operators.analytics import first_per_key
from minuteloom.rounds import ranks

#: Addresses of a rule or target, in the order in which they are asked.
RULE_URLS = ("official_url", "target_url", "url", "archive_url")
TARGET_URLS = ("url", "official_url", "archive_url")
FALLBACK = "rule-fallback-v1"


def beneath(own: Column, base: Column) -> Column:
    """own, and the entries of base whose keys it lacks; a null map is empty."""
    none = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(own, none), F.coalesce(base, none)
    return F.map_concat(a, F.map_filter(b, lambda k, _: ~F.map_contains_key(a, k)))


def resolve_rules(rules: DataFrame, templates: DataFrame, councils: DataFrame) -> DataFrame:
    """(council_id, rule): active rules over their template, nested entries where the rule has none, and the council's addresses where it lacks them.

    rules: council_id, template, is_active, rule and nested (maps of strings). templates: template, base. An unknown template is none.
    """
    active = rules.filter(F.coalesce("is_active", F.lit(True)))
    merged = active.join(F.broadcast(templates), "template", "left")  # templates are a configuration of a few rows
    full = merged.withColumn("rule", beneath(beneath(F.col("rule"), F.col("base")), F.col("nested")))
    own = councils.select("council_id", "official_url", "archive_url")
    known = F.map_filter(F.create_map(F.lit("official_url"), F.col("official_url"), F.lit("archive_url"), F.col("archive_url")), lambda _, v: F.coalesce(v, F.lit("")) != "")
    stated = F.map_filter("rule", lambda k, v: ~(k.isin("official_url", "archive_url") & (F.coalesce(v, F.lit("")) == "")))
    return full.join(own, "council_id", "left").select("council_id", beneath(stated, known).alias("rule"))


def url_index(rules: DataFrame) -> DataFrame:
    """(key, council_id): the first rule of each normalised address, by council and then by the order of RULE_URLS."""
    fields = F.array(*[F.struct(F.lit(i).alias("field"), F.col("rule")[c].alias("url")) for i, c in enumerate(RULE_URLS)])
    rows = rules.select("council_id", F.explode(fields).alias("f")).select("council_id", "f.field", urls.clean_key(F.col("f.url")).alias("key")).filter("key <> ''")
    return first_per_key(rows, ["key"], [F.asc("council_id"), F.asc("field")]).select("key", "council_id")


def rule_of(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """targets with rule_council and source: the rule of the same id, else of the first address that a rule has, else the fallback's name."""
    out = targets.join(rules.select("council_id", F.col("council_id").alias("__own")), "council_id", "left")
    index = url_index(rules)
    for c in TARGET_URLS:
        out = out.join(index.select(F.col("key").alias(f"__k_{c}"), F.col("council_id").alias(f"__{c}")), urls.clean_key(F.col(c)) == F.col(f"__k_{c}"), "left")
    found = ["__own", *[f"__{c}" for c in TARGET_URLS]]
    source = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c.strip("_").replace("own", "id"))) for c in found], F.lit(FALLBACK))
    return out.select(*targets.columns, F.coalesce(*found).alias("rule_council"), source.alias("source"))


def inherit_ids(found: DataFrame, known: DataFrame, portals: DataFrame) -> DataFrame:
    """(url, ministry, council_id, inherited): found councils get the id of the first known one with their address, unless a portal has it or another took it;
    the rest get ministry-N, on from the highest number in use. found: position, ministry, url. known: council_id, url."""
    key = urls.clean_key(F.col("url"))
    index = first_per_key(known.select("council_id", key.alias("key")).filter("key <> ''").join(portals.select(key.alias("key")).distinct(), "key", "left_anti"), ["key"], [F.asc("council_id")])
    rows = found.withColumn("key", key).join(index.select("key", F.col("council_id").alias("old")), "key", "left")
    first = first_per_key(rows.filter("old is not null"), ["old"], [F.asc("position")]).select("position", "old")
    rows = rows.drop("old").join(first, "position", "left")
    prefix = F.lower(F.col("ministry"))
    top = known.select(F.split_part("council_id", F.lit("-"), F.lit(1)).alias("prefix"), F.regexp_extract("council_id", "-([0-9]+)$", 1).try_cast("long").alias("n")).groupBy("prefix").agg(F.max("n").alias("top"))
    new = ranks(rows.filter("old is null").select("position", "ministry"), ["ministry"], [F.asc("position")], "n").select("position", "n")
    numbered = rows.join(new, "position", "left").withColumn("prefix", prefix).join(top, "prefix", "left")
    made = F.concat_ws("-", "prefix", (F.coalesce("top", F.lit(0)) + F.col("n")).cast("string"))
    return numbered.select("position", "ministry", "url", F.coalesce("old", made).alias("council_id"), F.col("old").isNotNull().alias("inherited"))
