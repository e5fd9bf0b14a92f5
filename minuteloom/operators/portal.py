"""Filters, searches, facets and sorts of the portal, over (council_id, meeting_id, date, ...) frames."""

from __future__ import annotations

from functools import reduce

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minuteloom.functions import dates, text


@dataclass(frozen=True)
class PortalQuery:
    """What a reader has chosen; ALL and empty values choose nothing."""

    ministry: object = "ALL"
    category: str = "ALL"
    doc_type: str = "ALL"
    date_range: str = "ALL"
    search: str = ""
    new_only: bool = False
    watched: tuple = field(default_factory=tuple)
    ref: str = "1999-09-16 00:00:00"


def meeting_conditions(q: PortalQuery, ignore: str | None = None) -> list[Column]:
    """Conjuncts over columns is_new, council_id, search_text, ministry, category, materials_count, date; `ignore` leaves one out."""
    out = {
        "new": F.col("is_new") if q.new_only else None,
        "watched": F.col("council_id").isin(*q.watched) if q.watched else None,
        "search": contains_all(F.col("search_text"), text.terms(q.search)) if q.search else None,
        "ministry": F.col("ministry") == q.ministry if q.ministry != "ALL" else None,
        "category": F.col("category") == q.category if q.category != "ALL" else None,
        "doc_type": has_children(F.col("materials_count")) if q.doc_type == "MATERIALS" else F.lit(False) if q.doc_type == "MINUTES" else None,
        "date_range": dates.in_range(F.col("date"), q.date_range, q.ref) if q.date_range != "ALL" else None,
    }
    return [c for k, c in out.items() if c is not None and k != ignore]


def filter_meetings(rows: DataFrame, q: PortalQuery, ignore: str | None = None) -> DataFrame:
    for c in meeting_conditions(q, ignore):
        rows = rows.filter(c)
    return rows


def contains_all(column: Column, words: list[str]) -> Column:
    """Every word is a substring; no word at all is true."""
    out = F.lit(True)
    for w in words:
        out = out & F.contains(column, F.lit(w))
    return out


def has_children(count: Column) -> Column:
    return F.coalesce(count, F.lit(0)) > 0


def with_any(parents: DataFrame, children: DataFrame, key: str, *conditions: Column) -> DataFrame:
    """Parents for which each condition holds in some child, not necessarily the same one: one aggregate, one semi join."""
    flags = children.groupBy(key).agg(*[F.bool_or(c).alias(f"c{i}") for i, c in enumerate(conditions)])
    keep = flags.filter(" and ".join(f"c{i}" for i in range(len(conditions)))) if conditions else flags
    return parents.join(keep.select(key), key, "left_semi")


def search_parents(parents: DataFrame, children: DataFrame, key: str, words: list[str], own: Column, child: Column) -> DataFrame:
    """Parents for which every word is in their own text or in some child's; words may hit different children."""
    if not words:
        return parents
    hits = children.groupBy(key).agg(*[F.bool_or(F.contains(child, F.lit(w))).alias(f"w{i}") for i, w in enumerate(words)])
    joined = parents.join(hits, key, "left")
    for i, w in enumerate(words):
        joined = joined.filter(F.contains(own, F.lit(w)) | F.coalesce(F.col(f"w{i}"), F.lit(False)))
    return joined.select(*parents.columns)


def refine_children(joined: DataFrame, words: list[str], own: Column, child: Column) -> DataFrame:
    """All children of a parent that itself matches all words; else the children that match all words."""
    return joined.filter(contains_all(own, words) | contains_all(child, words))


def facets(rows: DataFrame, q: PortalQuery) -> DataFrame:
    """(facet, value): ministries under all filters but the ministry's, categories likewise; a chosen value always stays. One pass."""
    def rest(ignore):
        out = F.lit(True)
        for c in meeting_conditions(q, ignore):
            out = out & c
        return out

    tagged = rows.select(F.explode(F.array(
        F.struct(F.lit("ministry").alias("facet"), F.col("ministry").cast("string").alias("value"), (rest("ministry") | (F.col("ministry") == q.ministry)).alias("on")),
        F.struct(F.lit("category").alias("facet"), F.col("category").alias("value"), (rest("category") | (F.col("category") == q.category)).alias("on")),
    )).alias("x"))
    return tagged.filter("x.on").select("x.facet", "x.value").distinct()


SORTS = {"NEWEST": ("date", False), "OLDEST": ("date", True), "DOCS_DESC": ("materials_count", False), "DOCS_ASC": ("materials_count", True), "MEETINGS_DESC": ("meetings_count", False), "MEETINGS_ASC": ("meetings_count", True)}


def meeting_order(by: str) -> list[Column]:
    """Sort keys of meetings; ties keep the table's order (newest first, then id). A missing date is the epoch."""
    base = [F.col("date").desc_nulls_last(), F.col("meeting_id").asc()]
    if by not in SORTS:
        return base
    name, up = SORTS[by]
    key = F.coalesce(F.col(name).cast("timestamp"), F.lit("1970-01-01").cast("timestamp")) if name == "date" else F.coalesce(F.col(name), F.lit(0))
    return [key.asc() if up else key.desc(), *base]


def council_order(by: str, name: Column) -> list[Column]:
    """Sort keys of councils; undated ones come last in either direction, ties go by name."""
    col, up = SORTS.get(by, SORTS["NEWEST"])
    key = F.col("latest_date") if col == "date" else F.coalesce(F.col(col), F.lit(0))
    return [*([F.col("latest_date").isNull().asc()] if col == "date" else []), key.asc() if up else key.desc(), by_name(name), F.col("council_id").asc()]


def by_name(name: Column) -> Column:
    """Sort key of names in the order of a Japanese dictionary: kana by sound, whatever their script."""
    return F.collate(name, "ja").asc()


def anti_any(rows: DataFrame, *others: tuple[DataFrame, Column]) -> DataFrame:
    """Rows that meet none of several exclusion tables, each under its own condition: one anti join each."""
    for other, on in others:
        rows = rows.join(other, on, "left_anti")
    return rows


# Parts of names of links back to the source, endings of ministries' names by group, and how an unknown day is shown.
SOURCE_LINKS = ("一次ソース", "公式ポータル", "公式ページ")
MINISTRY_GROUPS = {"府・省": ("府", "省"), "庁": ("庁",), "委員会": ("委員会",)}
OTHER_GROUP, UNKNOWN_DAY = "その他", "開催日不明"


def shown_materials(materials: Column, official_url: Column) -> Column:
    """A meeting's materials without links to its own page and back to the source."""
    back = lambda m: reduce(lambda a, w: a | F.contains(F.coalesce(m["name"], F.lit("")), F.lit(w)), SOURCE_LINKS, F.lit(False))
    own = lambda m: F.coalesce((m["url"] == official_url) & (official_url != ""), F.lit(False))
    return F.filter(F.coalesce(materials, F.array()), lambda m: ~own(m) & ~back(m))


def ministry_group(name: Column) -> Column:
    """The group that the end of a ministry's name tells."""
    ends = lambda words: reduce(lambda a, w: a | name.endswith(w), words, F.lit(False))
    return F.coalesce(*[F.when(F.coalesce(ends(words), F.lit(False)), F.lit(group)) for group, words in MINISTRY_GROUPS.items()], F.lit(OTHER_GROUP))


def visible(councils: DataFrame, status: str = "status") -> DataFrame:
    """Councils that aren't pending; a missing status is shown."""
    return councils.filter(~F.coalesce(F.col(status) == "pending", F.lit(False)))


def shown_date(date: Column) -> Column:
    """A day as it is shown: slashes, and words in place of the sentinel and of none."""
    plain = F.replace(F.coalesce(date, F.lit("")), F.lit("-"), F.lit("/"))
    return F.when((plain == "") | plain.startswith("2099/"), UNKNOWN_DAY).otherwise(plain)


def citation(ministry: Column, council: Column, name: Column, date: Column, url: Column) -> Column:
    """One line that names a meeting: ministry, council, title, day and address."""
    said = F.concat_ws(" ", ministry, F.concat(F.lit("「"), council, F.lit("」")), name)
    return F.concat(said, F.lit(" ("), shown_date(date), F.lit(") "), F.coalesce(url, F.lit("")))


def with_child_counts(rows: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """rows with the number of their children; only children of these rows are counted, so filters on rows come first."""
    n = children.join(rows.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count("*").alias(name))
    return rows.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
