"""Scraped pages into a council's meetings: which pages may be meetings at all, and the ordered merge of those into the stored ones.

What a page is by itself (guards, cleaned materials, day, rounds, stems) is said in columns. Only the merge, in which each
page sees what the ones before it changed, is a fold over rows sorted by council, with indexes for what a page may concern.
"""

from __future__ import annotations

from datetime import date
from difflib import SequenceMatcher
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minuteloom.batches import spread
from minuteloom.functions import dates, names, text, titles, urls
from minuteloom.functions import vocabulary as v
from minuteloom.functions.titles import ends_any, has_any, has_one_of, holds_any
from minuteloom.rounds import settled
from minuteloom.schema import UNKNOWN_DATE

MATERIAL = "struct<name:string,url:string,type:string>"
SYNCED = f"council_id string, meeting_id string, name string, date string, unconfirmed boolean, url string, materials array<{MATERIAL}>, locked boolean, action string"
#: Least likeness of a page's title stem to the council's and, where there are any, to those of its meetings.
LIKENESS = 0.40
#: Meetings of a batch that is handed over.
OUT_ROWS = 2_000
#: Days within which a round's number means the same meeting, and by which a page may lie behind the newest one.
PERIOD = 365
# What no material's name holds, and addresses of accounts.
NO_MATERIAL_NAMES = ("移動します", "公式ポータル", "公式ページ", "公式情報ポータル", "審議会・検討会等一覧")
ACCOUNT_HOSTS = ("twitter.com", "x.com", "facebook.com", "instagram.com", "line.me")


def is_account(url: Column) -> Column:
    """Accounts and channels of public relations; recordings of meetings are none. A substring test, as for hosts of news."""
    u = F.lower(F.coalesce(url, F.lit("")))
    channel = lambda u: F.contains(u, F.lit("youtube.com")) & has_any(u, ("/user/", "/channel/", "/c/", "/@")) & ~has_any(u, ("/live/", "watch?v=", "/embed/"))
    return text.let(u, lambda u: holds_any(u, ACCOUNT_HOSTS) | channel(u))


def is_anchor(url: Column) -> Column:
    """A place in a page, but not in a document."""
    u = F.trim(F.coalesce(url, F.lit("")))
    return F.contains(u, F.lit("#")) & (u.startswith("#") | ~urls.is_document(F.regexp_replace(u, "#.*$", "")))


def joined_names(materials: Column) -> Column:
    """All names, normalised, with marks between them: no Python function runs inside a lambda, so this is a column of its own beforehand."""
    return text.normal_text(F.array_join(F.transform(materials, lambda m: F.coalesce(m["name"], F.lit(""))), "\u0001"))


def clean_materials(materials: Column, said: Column, page: Column, title: Column) -> Column:
    """A page's materials without controls, accounts, anchors and the page itself, the first of each address, with names that say something. said: their joined_names."""
    url = lambda m: F.trim(F.coalesce(m["url"], F.lit("")))
    stays = lambda m: ~url(m).isin("", "#") & (url(m) != page) & ~url(m).startswith("javascript:") & ~is_account(url(m)) & ~is_anchor(url(m)) & ~m["name"].isin(*v.CONTROLS) & ~has_any(m["name"], NO_MATERIAL_NAMES)

    def named(m: Column) -> Column:
        file = F.regexp_extract(F.regexp_replace(url(m), "[?#].*$", ""), "([^/]*)$", 1)
        plain, own = titles.is_plain_material(m["name"]), F.coalesce(title, F.lit(""))
        by_file = F.when(own != "", F.concat(own, F.lit(" 資料 ("), file, F.lit(")"))).otherwise(file)
        by_title = F.when(own != "", F.concat(own, F.lit(" 配付資料"))).otherwise("配付資料")
        minutes = F.contains(F.lower(file), F.lit("gijiroku"))
        said = F.when(~plain, m["name"]).when(minutes, "議事録").when(~titles.is_plain_material(file), by_file).otherwise(by_title)
        return F.struct(said.alias("name"), url(m).alias("url"), F.coalesce(m["type"], F.lit("PDF")).alias("type"))

    every = F.coalesce(materials, F.array().cast(f"array<{MATERIAL}>"))
    kept = F.filter(F.zip_with(every, F.split(said, "\u0001"), lambda m, n: F.struct(F.trim(n).alias("name"), m["url"].alias("url"), m["type"].alias("type"))), stays)
    found = F.transform(kept, url)
    return F.transform(F.filter(kept, lambda m, i: F.array_position(found, url(m)) == i + 1), named)


def is_admitted(url: Column, title: Column, page_title: Column, ministry: Column, council_url: Column, rule: dict[str, Column]) -> Column:
    """Whether a page may be a meeting's: no file, index, notice, navigation or standing paper, no stock title, none of another
    ministry, and nothing that the council's rule leaves out. rule: no_self, not_urls, not_titles, only_urls (null for none)."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(title, r"\s*\([^)]*開催日不明[^)]*\)$", ""), r"^[0-9０-９一二三四五六七八九十]+[．.、\s]+", ""))
    noise = lambda t: has_any(t, v.NAVIGATION) | has_any(t, v.STANDING_PAPERS) | titles.is_generic_title(t, rule["not_titles"])
    same = F.lower(F.regexp_replace(F.coalesce(council_url, F.lit("")), "/+$", "")) == F.lower(url)
    required = F.coalesce(F.size(rule["only_urls"]) > 0, F.lit(False)) & ~has_one_of(url, rule["only_urls"])
    tests = [
        ends_any(F.lower(url), v.FILES),
        urls.is_generic_index(url, title, rule["not_urls"], rule["not_titles"]),
        titles.is_notice(url, title),
        F.coalesce(page_title, F.lit("")).rlike(".") & titles.is_notice(url, page_title),
        noise(title),
        noise(bare),
        F.coalesce(rule["no_self"], F.lit(False)) & same,
        has_one_of(url, rule["not_urls"]),
        has_one_of(title, rule["not_titles"]) | has_one_of(page_title, rule["not_titles"]),
        required,
        urls.of_other_ministry(url, ministry),
    ]
    out = F.lit(True)
    for test in tests:
        out = out & ~F.coalesce(test, F.lit(False))
    return out


def shown_title(title: Column) -> Column:
    """A page's title as a meeting's: without the words of an invitation, a bracket with a fiscal year and the clean-ups of clean_title."""
    t = F.regexp_replace(title, "「(.*?)」を開催します.*$", "$1")
    for p in ("を開催します.*$", r"[（(]開催案内[）)]$", "の開催について$", r"[（(](?:令和|平成)(?:[0-9]+|元)年度.*?[）)]$"):
        t = F.regexp_replace(t, p, "")
    return titles.clean_title(F.trim(t))


def prepared(scraped: DataFrame, councils: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Admitted pages of known councils, with all that the merge asks of them."""
    plain = scraped.join(councils.select("council_id", "ministry", F.col("name").alias("council"), F.coalesce("official_url", F.lit("")).alias("parent")), "council_id")
    if rules is None:
        plain = plain.withColumns({"no_self": F.lit(False), **{c: F.lit(None).cast("array<string>") for c in ("not_urls", "not_titles", "only_urls")}})
    else:
        plain = plain.join(rules.select("council_id", "no_self", "not_urls", "not_titles", "only_urls"), "council_id", "left")
    slash = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "/+$", "")
    # What a page is by itself is worked out in tasks of equal size, however councils and the joins' short rows lie.
    rows = spread(plain, "council_id", "seq").withColumns({"url": slash(F.col("url")), "title": F.trim(F.coalesce("title", F.lit(""))), "parent": slash(F.col("parent"))})
    u, t = F.col("url"), F.col("title")
    rows = rows.filter(is_admitted(u, t, F.col("page_title"), F.col("ministry"), F.col("parent"), {c: F.col(c) for c in ("no_self", "not_urls", "not_titles", "only_urls")}))
    rows = settled(rows, __said=joined_names(F.col("materials")), __shown=shown_title(t))
    day = dates.resolve_date(F.get("found_dates", F.lit(0)), t, u)
    wordless = ~(t.rlike(r"第\s*[0-9０-９一二三四五六七八九十百]+\s*回") | has_any(t, v.MEETING_WORDS)) | has_any(t, v.OTHER_WORDS)
    return rows.select(
        "council_id", "seq", "council", "parent", "url", "title", F.col("__shown").alias("shown"), clean_materials(F.col("materials"), F.coalesce("__said", F.lit("")), u, t).alias("materials"), day["date"].alias("date"), day["unconfirmed"].alias("unconfirmed"),
        text.sessions(F.concat_ws(" ", t, u)).alias("rounds"), names.title_stem(t).alias("stem"), names.is_round_or_date_only(t).alias("round_only"), names.title_stem(F.col("council")).alias("council_stem"),
        titles.is_generic_title(F.col("__shown")).alias("stock"), text.normal_text(F.col("__shown")).rlike(r"(?:20|19)[0-9]{2}年度?|(?:令和|平成)[0-9元]+(?:事務)?年|第[0-9]+期").alias("has_period"),
        wordless.alias("wordless"), has_any(t, v.UNDATED_WORDS).alias("undated_word"),
    )


def _day(value) -> date | None:
    try:
        y, m, d = (int(x) for x in str(value).split("/"))
        return None if y == int(UNKNOWN_DATE[:4]) else date(y, m, d)
    except ValueError:
        return None


class Book:
    """A council's meetings while its pages are merged in, indexed by round, address and day, so that a page looks only at what it may concern.

    A meeting is a dict with rounds, stem, index (an index page's address) and action; meetings are told by their place in the list.
    """

    def __init__(self, council_id: str, keep_locked: bool):
        self.id, self.keep_locked, self.council, self.parent = council_id, keep_locked, "", ""
        self.meetings: list[dict] = []
        self.by_round: dict[int, list[int]] = {}
        self.by_url: dict[str, set[int]] = {}
        self.by_day: dict[str, list[int]] = {}
        self.names: set[str] = set()
        self.stems: list[str] = []
        self.known_stems: set[str] = set()
        self.taken: set[str] = set()
        #: The next number that may be free behind a council and day.
        self.free: dict[str, int] = {}
        self.newest: date | None = None
        self.changed = 0

    def add(self, meeting: dict) -> None:
        at = len(self.meetings)
        self.meetings.append(meeting)
        for r in meeting["rounds"]:
            self.by_round.setdefault(r, []).append(at)
        self.by_url.setdefault(meeting["url"], set()).add(at)
        self.by_day.setdefault(meeting["date"], []).append(at)
        self.names.add(meeting["name"])
        self.taken.add(meeting["meeting_id"])
        if meeting["stem"] and meeting["stem"] not in self.known_stems:
            self.known_stems.add(meeting["stem"])
            self.stems.append(meeting["stem"])
        day = None if meeting["unconfirmed"] else _day(meeting["date"])
        if day and (self.newest is None or day > self.newest):
            self.newest = day

    def mark(self, meeting: dict, action: str) -> None:
        changes = ("inserted", "upgraded")
        self.changed += (action in changes) - (meeting["action"] in changes)
        meeting["action"] = action

    def fits(self, page: dict) -> bool:
        """A title of round and day alone fits; others are like the council's name and like some meeting's."""
        if page["round_only"]:
            return True
        if not page["stem"]:
            return False
        if page["council_stem"] and not like(page["stem"], page["council_stem"]):
            return False
        if page["stem"] == page["council_stem"] or not self.stems:
            return True
        for i, stem in enumerate(self.stems):
            if like(page["stem"], stem):
                self.stems.insert(0, self.stems.pop(i))  # the stem that fitted is likely to fit the next page
                return True
        return False

    def add_materials(self, meeting: dict, page: dict) -> None:
        known = {m["url"] for m in meeting["materials"]}
        new = [m for m in page["materials"] if m["url"] not in known]
        if new:
            meeting["materials"] = [*meeting["materials"], *new]
            self.mark(meeting, meeting["action"] if meeting["action"] == "inserted" else "merged")

    def complete(self, at: int, page: dict) -> None:
        """The page of a round that is stored: its address takes the place of the council's or an index page's, its materials that of none."""
        meeting = self.meetings[at]
        own_page = page["url"] not in ("", self.parent)
        weak = meeting["url"] == self.parent or meeting["index"]
        locked = self.keep_locked and meeting["locked"] and meeting["materials"]
        if page["materials"] and not locked and (weak and own_page or not meeting["materials"]):
            if weak and own_page:
                self.by_url[meeting["url"]].discard(at)
                self.by_url.setdefault(page["url"], set()).add(at)
                meeting["url"], meeting["index"] = page["url"], False
            meeting["materials"] = page["materials"]
            self.mark(meeting, "upgraded")
        elif meeting["url"] == page["url"]:
            self.add_materials(meeting, page)

    def take(self, page: dict) -> None:
        self.council, self.parent = page["council"], page["parent"]
        if not self.fits(page):
            return
        day, rounds, new_period = _day(page["date"]), page["rounds"], False
        stored = sorted({at for r in rounds for at in self.by_round.get(r, ())})
        if stored:
            newer, near = False, []
            for at in stored:
                m = self.meetings[at]
                d = None if m["unconfirmed"] else _day(m["date"])
                if m["url"] in (page["url"], self.parent) or m["index"] or d is None or day is None or abs((day - d).days) <= PERIOD:
                    near.append(at)
                else:
                    newer |= d >= day
            for at in near:
                self.complete(at, page)
            late = day is not None and not newer and (self.newest is None or (self.newest - day).days <= PERIOD)
            if near or not late or page["url"] in ("", self.parent):
                return
            new_period = True
        same_page = self.by_url.get(page["url"]) if page["url"] not in ("", self.parent) else None
        if same_page:
            return self.add_materials(self.meetings[max(same_page)], page)
        if not new_period and page["title"] in self.names:
            return
        if page["unconfirmed"] and (not page["materials"] or not rounds or page["undated_word"]) or not page["materials"] and page["wordless"]:
            return
        same_day = [] if page["unconfirmed"] else self.by_day.get(page["date"], [])
        for at in same_day:
            self.add_materials(self.meetings[at], page)
        if not same_day:
            self.insert(page, sorted(rounds), new_period)

    def identity(self, page: dict, rounds: list[int]) -> str:
        """Council, day and round, or where there is none or it is taken a running number, the first that is free."""
        stamp = f"{self.id}-{page['date'].replace('/', '')}"
        wanted = f"{stamp}-{rounds[0]:03d}" if rounds else f"{stamp}-s{len(self.meetings) + self.changed + 1:02d}"
        if wanted not in self.taken:
            return wanted
        k = self.free.get(stamp, 1)
        while f"{stamp}-s{k:02d}" in self.taken:
            k += 1
        self.free[stamp] = k + 1
        return f"{stamp}-s{k:02d}"

    def insert(self, page: dict, rounds: list[int], new_period: bool) -> None:
        known = not page["unconfirmed"]
        name, stem = page["shown"], page["stem"]
        if page["stock"] or name.startswith("http"):
            name, stem = f"第{rounds[0]}回 {self.council}" if rounds else f"{self.council} ({page['date'] if known else '開催日不明'})", page["council_stem"]
        elif self.council not in name and rounds:
            name, stem = f"第{rounds[0]}回 {self.council}", page["council_stem"]
        if new_period and known and not (page["has_period"] and name == page["shown"]):
            name = f"{name} ({page['date'][:4]}年)"
        if not known and "開催日不明" not in name:
            name = f"{name} (開催日不明)"
        meeting_id = self.identity(page, rounds)
        self.changed += 1
        self.add({
            "meeting_id": meeting_id, "name": name, "date": page["date"], "unconfirmed": not known, "url": page["url"] or self.parent, "materials": page["materials"], "locked": False,
            "rounds": set(rounds), "stem": stem, "index": False, "action": "inserted",
        })


@lru_cache(100_000)
def like(a: str, b: str) -> bool:
    """Whether two stems are alike; the cheap upper bounds are asked first."""
    if a == b:
        return True
    match = SequenceMatcher(None, a, b)
    return match.real_quick_ratio() >= LIKENESS and match.quick_ratio() >= LIKENESS and match.ratio() >= LIKENESS


SYNCED_COLUMNS = [c.split()[0] for c in SYNCED.replace(f"array<{MATERIAL}>", "array").split(", ")]


def _fold(keep_locked: bool):
    """Arrow batches sorted by council, with stored meetings before pages, to SYNCED rows; a council's book is held while its rows pass."""

    def run(batches):
        import pyarrow as pa

        material = pa.list_(pa.struct([("name", pa.string()), ("url", pa.string()), ("type", pa.string())]))
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), material, pa.bool_(), pa.string()]

        def written(book):
            for i in range(0, len(book.meetings), OUT_ROWS):
                some = book.meetings[i : i + OUT_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array([book.id] * len(some) if c == "council_id" else [m[c] for m in some], k) for c, k in zip(SYNCED_COLUMNS, kinds)], names=SYNCED_COLUMNS)

        book, seen = None, False
        for b in batches:
            for row in b.to_pylist():
                if not seen or row["council_id"] != book.id:
                    if seen:
                        yield from written(book)
                    book, seen = Book(row["council_id"], keep_locked), True
                row["rounds"] = set(row["rounds"] or ())
                if row["meeting_id"] is not None:
                    book.add({**row, "action": "kept"})
                else:
                    book.take(row)
        if seen:
            yield from written(book)

    return run


def sync_scraped(councils: DataFrame, stored: DataFrame, scraped: DataFrame, rules: DataFrame | None = None, keep_locked: bool = True) -> DataFrame:
    """SYNCED: every stored meeting and the inserted ones, each with what was done to it (kept, merged, upgraded, inserted).

    councils: council_id, ministry, name, official_url. stored: council_id, meeting_id, name, date (yyyy/MM/dd), unconfirmed, url,
    materials, locked. scraped: council_id, seq, url, title, page_title, found_dates, materials. rules: council_id, no_self, not_urls,
    not_titles, only_urls. Pages are taken by seq; applying them again changes nothing. A locked meeting with materials is not
    upgraded unless keep_locked is False, but gets further materials of its own page.

    Rows stream by council through one task each, as every page sees what the ones before it changed; what is held is the council's
    meetings and their indexes, and a page costs as much as the meetings of its rounds, address and day.
    """
    pages = prepared(scraped, councils, rules)
    slash = F.regexp_replace(F.coalesce("url", F.lit("")), "/+$", "")
    known = stored.filter("meeting_id is not null").select(
        "council_id", "meeting_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("date", F.lit("")).alias("date"), F.coalesce("unconfirmed", F.lit(False)).alias("unconfirmed"), slash.alias("url"),
        F.coalesce("materials", F.array().cast(f"array<{MATERIAL}>")).alias("materials"), F.coalesce("locked", F.lit(False)).alias("locked"),
        text.sessions(F.concat_ws(" ", "name", "url", "meeting_id")).alias("rounds"), names.title_stem(F.col("name")).alias("stem"), urls.is_generic_index(F.col("url"), F.lit("")).alias("index"),
    )
    return folded(known, pages, keep_locked)


def folded(known: DataFrame, pages: DataFrame, keep_locked: bool) -> DataFrame:
    """SYNCED of stored meetings and prepared pages: the fold alone."""
    rows = known.unionByName(pages.withColumn("seq", F.col("seq").cast("long")), allowMissingColumns=True)
    sorted_rows = rows.repartition("council_id").sortWithinPartitions("council_id", F.col("meeting_id").asc_nulls_last(), F.col("seq").asc_nulls_first(), "url", "title")
    return sorted_rows.mapInArrow(_fold(keep_locked), SYNCED)


def council_counts(councils: DataFrame, synced: DataFrame) -> DataFrame:
    """councils with `meetings` and `is_new`: where a page was inserted or upgraded a meeting, the number of all; else nulls."""
    changed = F.col("action").isin("inserted", "upgraded")
    n = synced.groupBy("council_id").agg(F.count("*").alias("meetings"), F.bool_or(changed).alias("is_new")).filter("is_new")
    return councils.join(n, "council_id", "left")
