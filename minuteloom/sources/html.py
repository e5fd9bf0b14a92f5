"""Pages to rows. Links by pattern stay in the JVM; what needs the document tree is walked in Arrow batches with html.parser."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minuteloom.batches import in_batches
from minuteloom.functions import dates

#: Pages of a batch.
PAGES = 64
SKIPPED = frozenset({"header", "footer", "nav", "aside", "script", "style"})
DOCUMENT_ENDS = (".pdf", ".docx", ".xlsx", ".doc", ".xls")


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, position, href) of every <a href="..."> by pattern."""
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("position", "href"))


def _kind(url: str) -> str:
    low = url.lower().split("?")[0]
    return "PDF" if low.endswith(DOCUMENT_ENDS) or "/pdf/" in low else "HTML"


def parse_materials(html: str | None, url: str) -> list[dict]:
    """Links of a page's content that are material: resolved against <base>, first of each URL, no anchors, scripts or the page itself."""
    from urllib.parse import urljoin, urldefrag

    from minuteloom.sources.dom import parse

    page = parse(html)
    base = next((n.attrs["href"] for n in page.find("base") if n.attrs.get("href")), "")
    root, own, seen, out = urljoin(url, base) if base else url, None, set(), []
    for a in page.find("a"):
        href, name = a.attrs.get("href", "").strip(), a.text()
        if not href or href.startswith(("#", "javascript:", "mailto:")) or any(n.tag in SKIPPED for n in a.above()):
            continue
        try:
            full = urldefrag(urljoin(root, href))[0]
            own = urldefrag(url)[0] if own is None else own
        except ValueError:
            continue
        if full and full not in seen and full != own:
            seen.add(full)
            out.append({"name": name, "url": full, "type": _kind(full)})
    return out


def materials_of(pages: DataFrame) -> DataFrame:
    """(page_id, position, name, url, type) over page_id, url, html."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, i, m["name"], m["url"], m["type"]) for p, u, h in zip(b.page_id, b.url, b.html) for i, m in enumerate(parse_materials(h, u))]
            yield pd.DataFrame(rows, columns=["page_id", "position", "name", "url", "type"])

    return in_batches(pages.select("page_id", "url", "html"), PAGES).mapInPandas(run, "page_id long, position int, name string, url string, type string")


def parse_text_minutes(text: str | None) -> dict:
    """Date text of the first 15 lines and round of the first 8 of plain minutes; two-digit years under 50 are 20YY."""
    import re
    import unicodedata

    lines = unicodedata.normalize("NFKC", text or "").splitlines()
    head = "\n".join(lines[:15])
    d = re.search(r"(?:令和|平成)(?:\d+|元)年\d{1,2}月\d{1,2}日|\d{4}[年/.-]\d{1,2}[月/.-]\d{1,2}", head)
    short = None if d else re.search(r"(?<!\d)(\d{2})[/.](\d{1,2})[/.](\d{1,2})(?!\d)", head)
    r = re.search(r"第\s*(\d+)\s*回", "\n".join(lines[:8]))
    date = d[0] if d else f"{(2000 if int(short[1]) < 50 else 1900) + int(short[1])}/{short[2]}/{short[3]}" if short else None
    return {"date_text": date, "round": int(r[1]) if r else None}


def text_minutes(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, date_text, round) of plain minutes."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [parse_text_minutes(t) for t in b[column]]
            out = pd.DataFrame({key: b[key], "date_text": [f["date_text"] for f in found], "round": [f["round"] for f in found]})
            yield out.astype({"round": "Int64"})

    return in_batches(rows.select(key, column), PAGES).mapInPandas(run, f"{key} {kind}, date_text string, round long")


# Labels of the day of a meeting, and of other days, as they stand in front of a date.
DAY_LABELS = ("実施日", "開催日時", "開催日")
OTHER_DAYS = ("更新日", "最終更新", "掲載日", "公表日", "作成日", "ページID", "copyright", "施行期日", "施行日", "施行", "適用期日", "適用日", "公布の日", "公布日", "施行予定")
#: Characters between such a label and the date that it is about, at most.
LABEL_REACH = 30
_DATE = r"(?:(?:令和|平成)\s*(?:[0-9]+|元)|[0-9]{4})\s*年\s*[0-9]{1,2}\s*月\s*[0-9]{1,2}\s*日|[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}"


def _content(html: str | None) -> str:
    """The text of a page's content: without frames, parts named for navigation and jumps; of <main> or <article> where one holds most."""
    import re

    from minuteloom.sources.dom import Node, parse

    def named(n: Node) -> str:
        return f"{n.attrs.get('id', '')} {n.attrs.get('class', '')}".lower()

    frame = re.compile("side|nav|footer|header|menu|breadcrumb|popup|modal|jump|skip")
    root = parse(html)
    for n in root.nodes():
        if n.tag in SKIPPED or n.tag not in ("body", "html", "a") and frame.search(named(n)) or n.tag == "a" and re.search("jump|skip", named(n)):
            n.cut()
    main = next((n for n in root.nodes() if n.tag in ("main", "article") and len(n.text()) > 50), None)
    return (main or next(iter(root.find("body")), root)).text()


def date_texts(html: str | None) -> list[dict]:
    """Dates written in a page's content, in order: {"text", "first": behind a label of a meeting's day}; those behind a label of another day are left out."""
    import re
    import unicodedata

    said = unicodedata.normalize("NFKC", _content(html))
    said = re.sub(r"((?:令和|平成)\s*(?:\d+|元)\s*年|\d{4}\s*年)\s*[(][^)\n]+[)]\s*(\d{1,2}\s*月)", r"\1\2", said)  # 2026年(令和8年)3月24日
    out = []
    for m in re.finditer(_DATE, said):
        before = said[max(0, m.start() - LABEL_REACH) : m.start()]
        day = re.search("(?:" + "|".join(DAY_LABELS) + r")\s*[:：]?\s*$", before)
        other = re.search("(?:" + "|".join(OTHER_DAYS) + r")[^年月日]*$", before, re.I)
        if day or not other:
            out.append({"text": re.sub(r"\s+", "", m[0]), "first": bool(day)})
    return out


def dates_of(pages: DataFrame, now: str) -> DataFrame:
    """(page_id, place, text, date): distinct days of each page's content, labelled days of a meeting first; only days from 1990 to two years ahead."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, i, d["text"], d["first"]) for p, h in zip(b.page_id, b.html) for i, d in enumerate(date_texts(h))]
            yield pd.DataFrame(rows, columns=["page_id", "position", "text", "first"])

    found = in_batches(pages.select("page_id", "html"), PAGES).mapInPandas(run, "page_id long, position int, text string, first boolean")
    valid = found.filter(dates.valid_date(F.col("text"), now).isNotNull())
    each = valid.groupBy("page_id", "text").agg(F.min(F.struct((~F.col("first")).alias("late"), "position")).alias("place"))
    order = Window.partitionBy("page_id").orderBy("place")
    return each.select("page_id", F.row_number().over(order).alias("place"), "text", dates.parse_era_date(F.col("text")).alias("date"))


#: Encodings that a page without a declaration may have, in the order in which ties go.
ENCODINGS = ("utf-8", "cp932", "euc_jp", "iso2022_jp")


def likely_japanese(text: str) -> float:
    """How likely a decoded text is Japanese as people write it, by its letters: kana and common signs count for it, kanji and plain letters little, half-width kana, unused
    and private ones against it. A text read in the wrong encoding has mostly the latter."""
    points = 0.0
    for c in text:
        o = ord(c)
        if 0x3041 <= o <= 0x30FE or o in (0x3001, 0x3002, 0x300C, 0x300D):
            points += 2
        elif 0x4E00 <= o <= 0x9FFF or 0xFF10 <= o <= 0xFF5A:
            points += 1
        elif 0xFF61 <= o <= 0xFF9F or 0xE000 <= o <= 0xF8FF or o < 32 and c not in "\t\n\r" or 0x80 <= o < 0xA0:
            points -= 3
        elif o >= 0x80:
            points -= 1
    return points / max(1, len(text))


def decode(content: bytes | None, declared: str | None = None) -> str:
    """Text of a page: by the declared charset, else the one in its first 2,048 bytes, where the page decodes by it; else by that of ENCODINGS in which it decodes and
    looks most like Japanese; at last UTF-8 with replacements. Null and empty pages are ''."""
    import re

    if not content:
        return ""
    meta = re.search(rb"charset=[\"']?([A-Za-z0-9_-]+)", content[:2048])

    def tried(name: str) -> str | None:
        try:
            out = content.decode(name)
        except (LookupError, UnicodeDecodeError):
            return None
        return None if "\ufffd" in out else out

    for name in (declared, meta and meta[1].decode("ascii")):
        if name and (text := tried(name)) is not None:
            return text
    found = [(likely_japanese(text), -i, text) for i, name in enumerate(ENCODINGS) if (text := tried(name)) is not None]
    return max(found)[2] if found else content.decode("utf-8", "replace")


def decoded(pages: DataFrame, content: str = "content", declared: str | None = None) -> DataFrame:
    """pages with `html`, the text of a binary column; declared: the column of the charset that the server told."""
    shown = pages.withColumn("__charset", F.lit(None).cast("string") if declared is None else F.col(declared))
    names = [*pages.columns, "html"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(html=[decode(c, d) for c, d in zip(b[content], b["__charset"])])[names]

    return in_batches(shown, PAGES).mapInPandas(run, f"{kinds}, html string")
