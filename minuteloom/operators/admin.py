"""What administrators list and check: filters over meetings and councils, verification verdicts, batch normalisation, marks of progress."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minuteloom.functions import text, titles, urls
from minuteloom.functions import vocabulary as v
from minuteloom.functions.titles import has_any
from minuteloom.operators.analytics import first_per_key
from minuteloom.schema import UNKNOWN_DATE

#: Endings of files that are no council's page, and headings that are none.
ASSETS = r"(?i)\.(?:pdf|docx?|xlsx?|pptx?|jpe?g|png|gif|zip)$"


@dataclass(frozen=True)
class MeetingFilter:
    """An administrator's choices; '' or None is no choice. docs: has_docs, no_docs. crawl: auto_unverified, auto_recent7, locked, auto_anomaly."""

    search: str = ""
    ministry: object = None
    category: str = ""
    docs: str = ""
    crawl: str = ""
    url_status: str = ""


def filter_meetings(rows: DataFrame, chosen: MeetingFilter, today: str) -> DataFrame:
    """Meetings that fit all choices. rows: meeting_id, name, council_name, date (yyyy/MM/dd), ministry, ministry_name, category, round, unconfirmed, is_new, discovered_at,
    updated_at, locked, n_materials, material_names (text), url_statuses (array)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    out = rows
    if chosen.search:
        said = F.concat_ws(" ", *[blank(c) for c in ("name", "council_name", "meeting_id", "date", "ministry_name", "ministry", "material_names")])
        out = out.filter(F.contains(F.lower(said), F.lit(chosen.search.lower())))
    if chosen.ministry not in (None, ""):
        out = out.filter(F.col("ministry") == F.lit(chosen.ministry))
    if chosen.category:
        out = out.filter(F.coalesce("category", F.lit("COUNCIL")) == chosen.category)
    if chosen.docs:
        out = out.filter(F.coalesce("n_materials", F.lit(0)) > 0 if chosen.docs == "has_docs" else F.coalesce("n_materials", F.lit(0)) == 0)
    if chosen.crawl:
        out = out.filter(crawl_state(chosen.crawl, today))
    if chosen.url_status:
        out = out.filter(F.coalesce(F.array_contains("url_statuses", chosen.url_status), F.lit(False)))
    return out


def crawl_state(kind: str, today: str) -> Column:
    """Whether a meeting is in one of the states of an automatic crawl; an unknown kind holds for all."""
    slashed = lambda c: F.left(F.replace(F.coalesce(c, F.lit("")), F.lit("-"), F.lit("/")), F.lit(10))
    new, locked = F.coalesce("is_new", F.lit(False)), F.coalesce("locked", F.lit(False))
    auto = new | (F.coalesce("discovered_at", F.lit("")) != "") | (F.coalesce("updated_at", F.lit("")) != "")
    day = F.date_format(F.lit(today).cast("date"), "yyyy/MM/dd")
    if kind == "auto_unverified":
        return auto & ~locked
    if kind == "auto_recent7":
        return auto & (new | (slashed(F.coalesce(F.nullif("updated_at", F.lit("")), "discovered_at")) >= F.date_format(F.date_sub(F.lit(today).cast("date"), 7), "yyyy/MM/dd")))
    if kind == "locked":
        return locked
    if kind == "auto_anomaly":
        held = slashed("date")
        unknown = F.coalesce("unconfirmed", F.lit(False)) | held.isin("", UNKNOWN_DATE)
        ahead = ~held.isin("", UNKNOWN_DATE) & (held > day)
        roundless = (F.col("round").isNull() | F.coalesce(F.col("meeting_id").cast("string").rlike(r"-s[0-9]+$"), F.lit(False))) & ~F.coalesce(F.col("name").rlike(titles.ROUND), F.lit(False))
        empty = (F.coalesce("n_materials", F.lit(0)) == 0) & ~ahead
        same = (F.coalesce("council_name", F.lit("")) != "") & (F.trim("name") == F.trim("council_name"))
        return auto & ~locked & (roundless | empty | F.coalesce(same, F.lit(False)) | unknown)
    return F.lit(True)


def filter_councils(councils: DataFrame, rejected: DataFrame, verdict: str = "", url_status: str = "", search: str = "") -> DataFrame:
    """Councils that aren't rejected, by verdict (pending, also for none; approved), URL status (unverified, also for none) and text.

    councils: council_id, council_name, ministry, ministry_name, verdict, url_status.
    """
    out = councils.join(rejected.select("council_id").distinct(), "council_id", "left_anti")
    if verdict:
        out = out.filter(F.coalesce("verdict", F.lit("pending")) == verdict)
    if url_status:
        out = out.filter(F.coalesce(F.nullif("url_status", F.lit("")), F.lit("unverified")) == url_status)
    if search:
        said = F.lower(F.concat_ws(" ", "council_name", F.col("council_id").cast("string"), "ministry_name", F.col("ministry").cast("string")))
        out = out.filter(F.contains(said, F.lit(search.lower())))
    return out


def verify(councils: DataFrame, registered: DataFrame, headings: list[str]) -> DataFrame:
    """councils with `verdict` and `reason` by the first rule that holds; without one, by the page: its status, its words, else the name.

    councils: name, official_url, status (null: not reached), body. registered: name, official_url. headings: patterns of names of index pages.
    """
    url, name = F.regexp_replace(F.trim(F.coalesce("official_url", F.lit(""))), "/+$", ""), F.trim(F.coalesce("name", F.lit("")))
    seen_names = registered.select(F.trim("name").alias("__name")).distinct().withColumn("__by_name", F.lit(True))
    seen_urls = registered.select(F.regexp_replace(F.trim("official_url"), "/+$", "").alias("__url")).distinct().withColumn("__by_url", F.lit(True))
    rows = councils.join(seen_names, name == F.col("__name"), "left").join(seen_urls, url == F.col("__url"), "left")
    bare = urls.path(url).isin("", "/index.html")
    heading = name.rlike("|".join(headings)) if headings else F.lit(False)
    public = F.lit(False)
    for h in v.PUBLIC_HOSTS:
        public = public | F.contains(urls.host(url), F.lit(h))
    rule = (
        F.when(has_any(url, v.WEB_ARCHIVES), "archive")
        .when(bare & name.isin(*v.MINISTRY_NAMES), "ministry_top_page")
        .when(heading, "index_page")
        .when(F.coalesce("__by_name", "__by_url").isNotNull(), "registered")
        .when(~public, "no_public_host")
        .when(urls.path(url).rlike(ASSETS), "single_file")
    )
    said = has_any(name, v.COUNCIL_WORDS) | has_any(F.col("body"), v.COUNCIL_WORDS)
    page = (
        F.when(F.col("status").isNull(), F.when(has_any(name, v.COUNCIL_WORDS), "approved_by_name").otherwise("unreachable"))
        .when(F.col("status") != 200, "bad_status")
        .when(has_any(F.lower("body"), v.MISSING_PAGES), "missing_page")
        .when(said, "approved_by_page")
        .otherwise("no_council")
    )
    reason = F.coalesce(rule, page)
    return rows.select(*councils.columns, F.when(reason.startswith("approved"), "approved").otherwise("rejected").alias("verdict"), reason.alias("reason"))


def apply_verdicts(councils: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """councils with the status of their verdict; those without one stay as they are."""
    return councils.join(verdicts.select(key, F.col("verdict").alias("__verdict")), key, "left").withColumn("status", F.coalesce("__verdict", "status")).drop("__verdict")


def normalise(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with the text columns normalised and `changed`: whether any of them was another text before. Nulls stay."""
    clean = {c: F.when(F.col(c).isNotNull(), text.normal_text(F.col(c))) for c in columns}
    changed = F.lit(False)
    for c, new in clean.items():
        changed = changed | ~new.eqNullSafe(F.col(c))
    return rows.withColumn("changed", changed).withColumns(clean)


def normalise_stats(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(changed, radicals_before, radicals_after) of a table and its normalised form, in one row; the last is 0."""
    total = lambda: sum((F.sum(text.radical_count(F.col(c))) for c in columns), F.lit(0))
    return after.agg(F.count_if("changed").alias("changed"), total().alias("radicals_after")).crossJoin(before.agg(total().alias("radicals_before")))


def replace_rejected(incoming: DataFrame, order: str) -> DataFrame:
    """The new table of rejected councils, whatever the old one had: of each id the last by `order` stays, and its ministry is that of the id. Rows without an id are left out."""
    rows = incoming.filter(F.coalesce("id", F.lit("")) != "")
    return first_per_key(rows, ["id"], [F.desc(order)]).drop("rank").withColumn("ministry", text.ministry_of(F.col("id")))


def since(marks: DataFrame, now: str) -> DataFrame:
    """marks with `since`: the day before the last crawl (text that begins with a day), else three days before now."""
    day = F.try_to_date(F.replace(F.split_part("last_crawl", F.lit(" "), F.lit(1)), F.lit("-"), F.lit("/")), "yyyy/M/d")
    return marks.withColumn("since", F.date_format(F.coalesce(F.date_sub(day, 1), F.date_sub(F.lit(now).cast("date"), 3)), "yyyy/MM/dd"))


def new_lines(log: DataFrame, latest: int) -> DataFrame:
    """Lines of a log behind the last one read, in order, for polling."""
    return log.filter(F.col("log_id") > latest).orderBy("log_id")


def request_times(requests: DataFrame) -> DataFrame:
    """requests (seq, url, at in seconds) with `starts`: when each may be sent, so that a host's requests keep its interval.

    A request waits for the one before it at its host: starts_k = max(at_k, starts_(k-1) + s), which is s k + the running maximum of at_j - s j.
    """
    from pyspark.sql.window import Window

    host, wait = urls.host(F.col("url")), urls.host_seconds(F.col("url"))
    order = Window.partitionBy("host").orderBy("seq")
    rows = requests.withColumns({"host": host, "wait": wait}).withColumn("k", F.row_number().over(order))
    ahead = F.max(F.col("at") - F.col("wait") * F.col("k")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("starts", F.when(F.col("host") == "", F.col("at")).otherwise(ahead + F.col("wait") * F.col("k"))).drop("k")
