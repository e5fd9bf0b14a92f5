"""Ordered verdicts: the first rule that holds names the reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from minuteloom.functions import vocabulary as v
from minuteloom.functions.titles import has_any, has_one_of, is_generic_title
from minuteloom.schema import UNKNOWN_DATE

# Words of pages that are no meeting.
ORGANISATION_WORDS = ("報告書", "活動状況", "視察概要", "名簿")
NAVIGATION_WORDS = ("メニュー開閉", "政策情報（会議・統計等）", "会議・委員会等")
ROUND = r"(?U)第\s*\d+\s*回"


def contains_any(column: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(column, F.lit(w))
    return out


def junk_reason(name: Column, date: Column, unconfirmed: Column, excluded: Column | None = None) -> Column:
    """Why a row is no meeting, or null: a standing document, navigation, the text of a link, a generic undated title, an undated placeholder.

    A round number (第N回) saves a name from all but the generic undated rule. The note that the day isn't known and a list's number in front are no
    part of a name. excluded: an array column of the ministry's own words, which count as navigation.
    """
    n = F.trim(F.coalesce(name, F.lit("")))
    core = F.trim(F.regexp_replace(F.trim(F.regexp_replace(n, r"\s*\([^)]*開催日不明[^)]*\)$", "")), "^[0-9０-９一二三四五六七八九十]+[．.、\\s]+", ""))
    numbered = n.rlike(ROUND)
    undated = F.coalesce(unconfirmed, F.lit(False)) | F.coalesce(date == UNKNOWN_DATE, F.lit(False))
    own = F.lit(False) if excluded is None else has_one_of(core, excluded)
    stock = has_any(core, (*v.TITLES_ALONE, *v.TITLES_ANYWHERE, *v.TITLES_SHORT)) | is_generic_title(core, excluded)
    return (
        F.when(~numbered & (has_any(core, v.STANDING_PAPERS) | has_any(n, ORGANISATION_WORDS)), "standing_document")
        .when(~numbered & (has_any(core, v.NAVIGATION) | has_any(n, NAVIGATION_WORDS) | own), "navigation")
        .when(~numbered & (core.isin(*v.LINK_TEXTS) | n.isin(*v.LINK_TEXTS)), "link_text")
        .when(undated & stock, "generic_undated")
        .when(undated & ~numbered & F.contains(n, F.lit("開催日不明")), "undated_placeholder")
    )


def crawl_verdict(materials: Column, dates: Column, subpages: Column, subpages_with_materials: Column, generic_title: Column) -> Column:
    """success, partial or failed, from counts of what a page gave."""
    return (
        F.when((subpages > 0) & (subpages_with_materials > 0), "success")
        .when(subpages > 0, "partial")
        .when((materials > 0) & (dates > 0) & generic_title, "partial")
        .when((materials > 0) & (dates > 0), "success")
        .when((materials > 0) | (dates > 0), "partial")
        .otherwise("failed")
    )


# Titles that say nothing of a meeting: papers and minutes, alone or listed, pages of their own, and openings.
PAPER_TITLES = tuple(kind + "資料" + end for kind in ("", "会議", "配付", "配布") for end in ("", "一覧", "詳細"))
AGENDA_TITLES = tuple("議事" + kind + end for kind in ("次第", "録", "要旨") for end in ("", "一覧", "詳細"))
PAGE_TITLES, OPENING_TITLES = ("トップ", "ホーム", "目次", "インデックス", "index", "詳細", "一覧"), tuple("開催" + end for end in ("について", "案内", "結果", "概要"))


def meeting_anomalies(row: dict[str, Column], today: str) -> Column:
    """Codes of what looks wrong, in this order: unconfirmed_date, missing_round, no_materials, identical_to_council, generic_title, same_as_council_url.

    row: id, name, date (text), unconfirmed, round, url, materials (their number), council_name, council_url. A round that the name tells is none missing, and one of a running
    number (-sNN) is. A day to come needs no materials, and without materials alone the council's own page is too little. Nulls are empty.
    """
    said = lambda c: F.trim(F.coalesce(row[c].cast("string"), F.lit("")))
    name, day, empty = said("name"), F.replace(said("date"), F.lit("-"), F.lit("/")), F.coalesce(row["materials"], F.lit(0)) == 0
    ahead = ~day.isin("", UNKNOWN_DATE) & (day > F.date_format(F.lit(today).cast("date"), "yyyy/MM/dd"))
    page = lambda c: F.regexp_replace(said(c), "/+$", "")
    checks = [
        ("unconfirmed_date", F.coalesce(row["unconfirmed"], F.lit(False)) | day.isin("", UNKNOWN_DATE)),
        ("missing_round", (row["round"].isNull() | said("id").rlike("-s[0-9]+$")) & ~name.rlike(ROUND)),
        ("no_materials", empty & ~ahead),
        ("identical_to_council", (said("council_name") != "") & (name == said("council_name"))),
        ("generic_title", F.lower(name).isin(*PAPER_TITLES, *AGENDA_TITLES, *PAGE_TITLES, *OPENING_TITLES)),
        ("same_as_council_url", (said("council_url") != "") & (said("url") != "") & (page("url") == page("council_url")) & empty & ~ahead),
    ]
    return F.array_compact(F.array(*[F.when(c, code) for code, c in checks]))


def news_route(has_council: Column, is_index: Column, is_pdf: Column, has_date: Column, inconsistent: Column, materials: Column, notice: Column) -> Column:
    """Where a news item goes: drop, crawl or direct."""
    return (
        F.when(~has_council, "drop").when(is_index, "crawl").when(is_pdf & has_date, "direct").when(inconsistent, "crawl").when((materials > 0) & has_date & ~notice, "direct").otherwise("crawl")
    )
