"""Links of pages with what stands around them, and what they are: pages of single meetings, news."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable
from functools import partial
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minuteloom.batches import in_batches, page_rows
from minuteloom.functions import dates, text, titles, urls
from minuteloom.functions import vocabulary as v
from minuteloom.functions.text import normal
from minuteloom.functions.text import plain as nfkc
from minuteloom.functions.titles import file_of, has_any, holds_any
from minuteloom.operators.analytics import first_per_key
from minuteloom.rounds import settled
from minuteloom.sources.dom import Node, parse

ROUND = re.compile(r"第\s*\d+\s*回")
HEADINGS, BLOCKS, CHAIN = ("h1", "h2", "h3", "h4"), ("tr", "li", "dd", "p", "div"), ("p", "li", "tr", "dd", "dl", "div", "article")
#: Pages of a batch.
PAGES = 64
# Files that are no page; sections, columns and column heads that tell what their links are; parts of addresses of single meetings.
NO_PAGES = (
    ".pdf", ".zip", ".doc", ".docx", ".xls", ".xlsx", ".jtd", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".ico", ".bmp", ".css", ".js", ".json", ".xml", ".rss", ".woff", ".woff2", ".ttf", ".eot", ".otf",
    ".mp4", ".mp3", ".wav", ".mov", ".avi",
)
LINK_SECTIONS = ("関連リンク", "リンク集", "おすすめリンク", "関連施策", "関連情報")
NOTICE_COLUMNS, PAPER_COLUMNS, ROUND_COLUMNS = ("開催案内", "案内", "傍聴", "開催告知"), ("資料", "議事"), ("回数", "回次", "開催回")
REPORTS = ("報告書", "活動状況", "視察概要", "論点整理", "提言")
MEETING_ADDRESS = r"(?:(?:19|20)[0-9]{6}(?![0-9])|dai[0-9]+|[0-9]+kai|kaisai|session|meeting|r0?[0-9]+-[0-9]+|h[0-9]+-[0-9]+|gijisidai|gijiroku|bunkakai|r[0-9]+kai)"
MEETING_TEXT = r"第\s*[0-9０-９]+\s*回|開催|議事|資料|(?:令和|平成)(?:[0-9]+|元)年|[0-9]{4}年[0-9]{1,2}月|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}"
LINKS = "position int, href string, url string, text string, title string, same_host boolean, heading string, column_head string, row_has_no_round boolean, around string, near array<string>, inside_frame boolean"
FRAMES = frozenset({"header", "footer", "nav"})
#: References whose address is the base's folder or host and they themselves; others are left to urljoin.
_SIMPLE = re.compile(r"/?[A-Za-z0-9_~-][A-Za-z0-9_~.-]*(?:/[A-Za-z0-9_~-][A-Za-z0-9_~.-]*)*/?", re.ASCII)
_SIMPLE_FOLDER = re.compile(r"(?:/[A-Za-z0-9_~-][A-Za-z0-9_~.-]*)*/", re.ASCII)
_DIGIT = re.compile("[0-9]")


def resolver(start: str, blank: str = "%20") -> Callable[[str], tuple[str, str | None]]:
    """(address, host) of references from this base, which is read once: urljoin, with `blank` for blanks, and the host of what is http or https, else None. A ValueError for what can't be joined."""

    def joined(href: str) -> tuple[str, str | None]:
        full = urljoin(start, href).replace(" ", blank)
        try:
            parts = urlsplit(full)
        except ValueError:
            return full, None
        return full, parts.netloc.lower() if parts.scheme in ("http", "https") else None

    try:
        base = urlsplit(start)
        folder = base.path[: base.path.rfind("/") + 1] or "/"
        known = base.scheme in ("http", "https") and base.netloc and " " not in base.netloc and _SIMPLE_FOLDER.fullmatch(folder)
    except ValueError:
        known = False
    if not known:
        return joined
    top, host = f"{base.scheme}://{base.netloc}", base.netloc.lower()
    there = top + folder
    return lambda href: ((top if href[0] == "/" else there) + href, host) if _SIMPLE.fullmatch(href) else joined(href)


def started(url: str | None, base: str | None) -> str:
    """The address that a page's references start from: its own, or its base's; a base that is none counts for nothing."""
    try:
        return urljoin(url or "", base) if base else url or ""
    except ValueError:
        return url or ""


def _table_heads(table: Node) -> tuple[list[str], int | None, bool]:
    """The heads of a table's columns, the column of rounds, and whether a row tells a round; no heads for a table of fewer than two rows."""
    rows = table.find("tr")
    if len(rows) < 2:
        return [], None, False
    heads = [c.text() for c in next((r for r in rows[:3] if r.find("th")), rows[0]).find("th", "td")]
    place = next((i for i, h in enumerate(heads) if h == "回" or any(k in h for k in ROUND_COLUMNS)), None)
    return heads, place, place is not None and any(ROUND.search(nfkc(r.text())) for r in rows[1:])


def _table_place(link: Node, above: list[Node], tables: dict[int, tuple], rows: dict[int, tuple]) -> tuple[str, bool]:
    """The head of the column of a link with these elements above it, and whether its row lacks the round that other rows of the table have. tables, rows: what is known of those, by their order."""
    at = next((i for i, n in enumerate(above) if n.tag == "tr"), None)
    if at is None:
        return "", False
    row = above[at]
    if row.order not in rows:
        table = next((n for n in above[at + 1 :] if n.tag == "table"), None)
        if table is None:
            rows[row.order] = [], [], False
        else:
            if table.order not in tables:
                tables[table.order] = _table_heads(table)
            heads, place, numbered = tables[table.order]
            cells = row.find("td", "th")
            lacks = place is not None and place < len(cells) and numbered and not re.search(r"\d", nfkc(cells[place].text()))
            rows[row.order] = heads, cells, lacks
    heads, cells, lacks = rows[row.order]
    return next((head for head, c in zip(heads, cells) if c.order < link.order < c.stop), ""), lacks


def links_of(html: str | None, url: str | None, near: bool = True, place: bool = True, frames: bool = True) -> list[tuple]:
    """The links of a page in order, as LINKS, resolved against its base, with the heading before them, their place in a table and the texts around them.

    near: in NFKC, without those that hold no digit, as days are looked for in them. What is not asked for is empty: near, the heading and the place in a table, links inside frames.
    """
    root = parse(html)
    base, found, marks = None, [], []
    for n in root.nodes():
        tag = n.tag
        if tag == "a":
            found.append(n)
        elif tag in HEADINGS or tag in ("dt", "summary") or tag in ("p", "div", "span") and "date" in n.attrs.get("class", "").lower():
            marks.append(n)
        elif tag == "base" and base is None:
            base = n.attrs.get("href", "")
    full_of, own, known = resolver(started(url, base)), None, {}
    places, headings = [n.order for n in marks], [n for n in marks if n.tag in HEADINGS]
    heading_places, loose, tables, rows, out, position = [n.order for n in headings], {}, {}, {}, [], -1

    def said(n: Node) -> tuple[str, ...]:
        if n.order not in known:
            plain = nfkc(n.text())
            known[n.order] = (plain,) if _DIGIT.search(plain) else ()
        return known[n.order]

    for a in found:
        href = a.attrs.get("href", "").strip()
        if not href or href.startswith(("#", "javascript:", "mailto:", "tel:")):
            continue
        try:
            full, host = full_of(href)
            own = urlsplit(url or "").netloc.lower() if own is None else own
        except ValueError:
            continue
        if host is None:
            continue
        position += 1
        above, frame, n = [], False, a.parent
        while n is not None:
            above.append(n)
            frame = frame or n.tag in FRAMES
            n = n.parent
        if frame and not frames:
            continue
        heading, column, lacks, around = "", "", False, []
        if place:
            before = bisect_left(heading_places, a.order)
            heading = headings[before - 1].text() if before else ""
            column, lacks = _table_place(a, above, tables, rows)
        block = next((n.text() for n in above if n.tag in BLOCKS), "")
        if near:
            for n in [n for n in above if n.tag in CHAIN][:4]:
                if n.tag in ("div", "dl", "article") and len(n.find("a")) > 3:
                    break
                stamps = [t.attrs["datetime"][:10] for t in n.find("time") if t.attrs.get("datetime")]
                around += [nfkc(t) for t in stamps[:1]]
                around += said(n)
            shown = 0
            for i in range(bisect_left(places, a.order) - 1, -1, -1):
                n = marks[i]
                if i not in loose:
                    loose[i] = not any(p.tag == "li" for p in n.above())
                if loose[i]:
                    around += said(n)
                    shown += 1
                    if shown == 10 or n.tag in ("h2", "h3"):
                        break
            around += said(a)
        out.append((position, href, full, a.text(), normal(a.text()), host == own, heading, column, lacks, block, around, frame))
    root.page.leave()
    return out


def extract_links(pages: DataFrame, *kept: str, **asked: bool) -> DataFrame:
    """LINKS of pages (page_id, url, html), with page_id and the page's columns `kept`; a null page has none. asked: what links_of is asked for."""
    return page_rows(pages, [*kept, "page_id"], LINKS, partial(links_of, **asked), PAGES)


def subpages(pages: DataFrame, pattern: Column | None = None, strict: Column | None = None) -> DataFrame:
    """(page_id, position, url, text, around): links of the page's host that lead to single meetings, by their text or address; nothing is guessed.

    pattern: a council's own regular expression of addresses, over page_id, and strict whether only that counts. Files, index pages, notices,
    navigation, standing papers, reports without a round, archives of a year and links among related ones are left out; the first of each address stays.
    """
    own = {"page": F.col("url"), "pattern": F.lit(None).cast("string") if pattern is None else pattern, "strict": F.lit(False) if strict is None else F.coalesce(strict, F.lit(False))}
    # A link takes along what its page says, so that it is judged in the task that found it.
    rows = extract_links(pages.filter("page_id is not null").withColumns(own), *own, near=False)
    rows = settled(rows.filter("same_host and not row_has_no_round"), t=F.trim(F.col("text")), low=F.regexp_replace(F.lower("href"), "[?#].*$", ""))
    t, u, low = F.col("t"), F.col("url"), F.col("low")
    meeting = F.lower(u).rlike(MEETING_ADDRESS)
    numbered = r"^[0-9０-９一二三四五六七八九十]+[．.、\s]+"
    noise = lambda x: x.isin(*v.CONTROLS) | holds_any(x, (*v.NAVIGATION, *v.STANDING_PAPERS))
    bare = t.rlike(numbered) & text.let(F.trim(F.regexp_replace(t, numbered, "")), noise)
    year_alone = t.rlike(r"^(?:令和|平成|[0-9]{4})[0-9元]*\s*(?:度|年度)(?:/(?:令和|平成|[0-9]{4})[0-9元]*\s*(?:度|年度))?$")
    report = (has_any(t, REPORTS) | has_any(F.lower(u), ("/report/", "/tosin/"))) & ~t.rlike(titles.ROUND)
    notices = has_any(F.col("column_head"), NOTICE_COLUMNS) & ~has_any(F.col("column_head"), PAPER_COLUMNS)
    by_text = t.rlike(MEETING_TEXT)
    custom = F.coalesce(F.expr("regexp_like(href, pattern) or regexp_like(url, pattern)"), F.lit(False))
    loose = ~(F.col("strict") & F.col("pattern").isNotNull())
    fits = loose & by_text | F.when(F.col("pattern").isNotNull(), custom).otherwise(meeting) | loose & meeting
    # What is told at once is asked first, and the rest only of what is left.
    stays = ~file_of(low, NO_PAGES) & fits & ~notices & ~noise(t) & ~bare & ~year_alone & ~report & ~has_any(F.col("heading"), LINK_SECTIONS)
    stays = stays & ~(t.isin(*v.TITLES_ALONE, *v.TITLES_SHORT, *v.TITLES_ANYWHERE) & ~meeting) & ~urls.is_parent_or_nav(u, F.col("page")) & ~titles.is_notice(u, t) & ~urls.is_generic_index(u, t)
    key = F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "/+$", "")
    return first_per_key(rows.filter(stays).withColumn("__key", key), ["page_id", "__key"], [F.asc("position")]).select("page_id", "position", "url", "text", "around")


def news_items(pages: DataFrame, since: Column | None = None) -> DataFrame:
    """(page_id, position, title, url, date): links outside header, footer and navigation whose text is about a council.

    The date is that of the closest text around the link that has one, then of the headings before it, then of the text itself; days without a year
    are in that of `since`, else of the page's address, else null. With since (yyyy/MM/dd, over page_id), older and undated items are left out.
    """
    own = {"page": F.col("url"), "since": F.lit(None).cast("string") if since is None else since}
    rows = extract_links(pages.filter("page_id is not null").withColumns(own), *own, place=False, frames=False)
    title = F.col("title")
    rows = rows.filter((title != "") & (holds_any(title, v.NEWS_WORDS) | title.rlike(titles.ROUND)) & ~holds_any(title, v.NEWS_NAVIGATION))
    year = F.coalesce(F.regexp_extract("since", "^([0-9]{4})", 1).try_cast("int"), F.regexp_extract("page", "/(20[0-9]{2})[/-]?", 1).try_cast("int"))
    rows = settled(rows, year=year)
    # Texts are read up to the first that tells a day.
    day = F.aggregate("near", F.lit(None).cast("string"), lambda found, x: F.coalesce(found, dates.news_date_plain(x, F.col("year"))))
    dated = settled(rows.select("page_id", "position", "title", "url", "since", day.alias("date")))
    return dated.filter(F.col("since").isNull() | F.coalesce(F.col("date") >= F.col("since"), F.lit(False))).select("page_id", "position", "title", "url", "date")


# Headings of an agenda that are no page's title, and words for minutes by which a page is material.
AGENDA_HEADINGS = ("開催日時", "日時", "開催日", "場所", "議題", "議事", "出席者", "資料", "傍聴")
MINUTES = ("議事録", "議事要旨", "議事概要", "議事次第")


def page_titles(pages: DataFrame) -> DataFrame:
    """(page_id, title): the first heading that is a title (h1 before h2 before h3, over three characters, no stock or agenda heading), else the page's
    <title>, else its address."""

    def run(batches):
        for b in batches:
            rows = []
            for p, h in zip(b.page_id, b.html):
                root = parse(h)
                found = [n.text() for tag in ("h1", "h2", "h3") for n in root.find(tag)]
                rows += [(p, i, False, t) for i, t in enumerate(found)] + [(p, len(found) + i, True, n.text()) for i, n in enumerate(root.find("title")[:1])]
            yield pd.DataFrame(rows, columns=["page_id", "place", "whole", "said"])

    said = in_batches(pages.select("page_id", "html"), PAGES).mapInPandas(run, "page_id long, place int, whole boolean, said string").withColumn("title", titles.clean_title(F.col("said")))
    agenda = F.col("title").rlike(r"^[0-9０-９一二三四五六七八九十]+[．.、\s]*(?:" + "|".join(AGENDA_HEADINGS) + ")")
    fits = ~titles.is_generic_title(F.col("title")) & (F.col("whole") | (F.length("title") > 3) & ~agenda)
    first = said.filter(fits).groupBy("page_id").agg(F.min_by("title", "place").alias("title"))
    return pages.select("page_id", "url").join(first, "page_id", "left").select("page_id", F.coalesce("title", "url").alias("title"))


_BLOCK = frozenset({"td", "th", "li", "p", "dd", "dt"})


def _before(link: Node) -> str:
    """What stands in the link's own element before it, back to the link before."""
    if link.parent.children[0] is link:
        return ""
    out = []
    for c in link.parent.children:
        if c is link:
            break
        if isinstance(c, Node):
            out = [] if c.tag == "a" else [*out, c.text()]
        else:
            out.append(c)
    return " ".join(" ".join(out).split())


def link_context(link: Node) -> tuple[str, str, str, str, int]:
    """(said, before, cells, block, links), in normal form: a link's text, the words and the cells before it, the text of the element around it and how many links that has."""
    block = row = None
    n = link.parent
    while n is not None and (block is None or row is None):
        if block is None and n.tag in _BLOCK:
            block = n
        if row is None and n.tag == "tr":
            row = n
        n = n.parent
    cells = []
    for cell in row.find("td", "th") if row is not None else ():
        if cell.order < link.order < cell.stop:
            break
        said = cell.text()
        if said and said not in ("PDF", "資料"):
            cells.append(said)
    return normal(link.text()), normal(_before(link)), normal(" ".join(cells)), normal(block.text()) if block else "", len(block.find("a")) if block else 0


def context_name(x: Column, folders: dict[str, str] | None = None) -> Column:
    """The name of a link, a struct with its address and what link_context says: one that says nothing is made from the cells and the words before the link, else from what is
    around it, else is that of minutes by the file's name, else gets the label that `folders` has for the file's folder. What a name is made from is only worked out for those."""
    note, edges = r"(?i)[（(［]PDF[／/形式:：\s0-9.,KMB]*[）)］]", r"^[\[(（［【\s・:：.\-–—―]+|[\]］【】\s・:：.\-–—―]+$"
    clean = lambda c: F.regexp_replace(F.trim(F.regexp_replace(c, note, "")), edges, "")
    says = lambda c: (F.length(c) >= 2) & ~titles.is_plain_material(c)
    alone = r"^第[0-9一-九〇百十]+回$|^(?:第[0-9一-九〇百十]+回)?\s*(?:(?:令和|平成|昭和)[0-9元]+年|[0-9]{4}年)[\s0-9年月日時分:()火水木金土日月]*$"

    def made(c: Column) -> Column:
        before, cells = c["before"], c["cells"]
        return F.coalesce(F.when((cells != "") & (before != ""), F.concat_ws(" ", cells, before)), F.when(says(before), before), F.when(says(cells), cells))

    words = F.struct(clean(x["before"]).alias("before"), text.let(clean(x["cells"]), lambda c: F.when(c.rlike(alone), "").otherwise(c)).alias("cells"))
    block = F.when(x["links"] <= 2, text.let(F.regexp_replace(F.trim(F.regexp_replace(clean(x["block"]), r"(?i)\bPDF\b", "")), edges, ""), lambda c: F.when(says(c), c)))
    path = F.regexp_replace(F.lower(x["address"]), "[?#].*$", "")
    folder, file = F.regexp_extract(path, "([^/]*)/[^/]*$", 1), F.regexp_extract(path, "([^/]*)$", 1)
    labels = [F.when(F.contains(folder, F.lit(k.lower())), F.concat(F.lit(f"{label} "), x["said"])) for k, label in (folders or {}).items()]
    return F.when(~titles.is_plain_material(x["said"]), x["said"]).otherwise(F.coalesce(text.let(words, made), block, F.when(F.contains(file, F.lit("gijiroku")), F.lit("議事録")), *labels, x["said"]))


CONTEXT = "said string, before string, cells string, block string, links int"
NO_MATERIALS = frozenset({"header", "footer", "nav", "aside"})


def material_places(html: str | None, url: str | None) -> list[tuple]:
    """(position, address, *context) of the links of a page that are outside its frames."""
    root, out = parse(html), []
    full_of = resolver(started(url, next((n.attrs.get("href", "") for n in root.find("base")), "")), " ")
    for i, a in enumerate(root.find("a")):
        href = a.attrs.get("href", "").strip()
        if not href or href.startswith(("#", "javascript:", "mailto:", "tel:")) or any(n.tag in NO_MATERIALS for n in a.above()):
            continue
        try:
            full = full_of(href)[0]
        except ValueError:
            continue
        out.append((i, full, *link_context(a)))
    root.page.leave()
    return out


def page_materials(pages: DataFrame, folders: dict[str, str] | None = None) -> DataFrame:
    """(page_id, position, name, url, type): links outside a page's frames that are material: documents (PDF) and pages of minutes (HTML), the first of each address.

    Accounts, anchors and index pages are none. Names that say nothing are made by context_name.
    """
    found = page_rows(pages, ["page_id"], f"position int, address string, {CONTEXT}", material_places, PAGES)
    u = F.col("address")
    rows = settled(found, path=F.regexp_replace(F.lower(u), "[?#].*$", "")).filter(~has_any(F.lower(u), ("twitter.com", "facebook.com", "instagram.com", "line.me")))
    rows = settled(rows, document=urls.is_document(F.col("path")), name=context_name(F.struct("address", "said", "before", "cells", "block", "links"), folders))
    document, name = F.col("document"), F.col("name")
    minutes = holds_any(name, MINUTES) | F.contains(F.regexp_extract("path", "([^/]*)$", 1), F.lit("gijiroku"))
    fits = rows.filter((document | minutes & ~urls.is_generic_index(u, name)) & ~name.isin(*v.CONTROLS))
    kept = fits.select("page_id", "position", "name", F.when(document, u).otherwise(F.regexp_replace(u, "#.*$", "")).alias("url"), F.when(document, "PDF").otherwise("HTML").alias("type"))
    return first_per_key(kept, ["page_id", "url"], [F.asc("position")]).select("page_id", "position", "name", "url", "type")
