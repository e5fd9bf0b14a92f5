"""Date columns. What is not a date is null; nothing here throws under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from minuteloom.functions.text import let
from minuteloom.functions.udf import nfkc
from minuteloom.schema import UNKNOWN_DATE

# Years before the first of an era, in words and in letters.
ERAS = {"令和": 2018, "平成": 1988}
LETTER_ERAS = {"R": 2018, "H": 1988, "S": 1925}
#: Characters that stand for era words while a text is scanned.
ERA_MARKS = {"令和": "\ue000", "平成": "\ue001"}
#: A date as the scanner sees it: era, year, sign, month, sign, day (of a range the first), end.
SCAN = (
    r"(?:([\ue000\ue001])\s*|(?<![A-Za-z0-9])([RHSrhs])\s*|(?<![0-9])(?=[0-9]{4}\s*年)|(?<![A-Za-z0-9_]))"
    r"([0-9]{1,4}|元)(\s*年\s*|[./-])([0-9]{1,2})(\s*[年月]\s*|[./-])([0-9]{1,2})"
    r"(?:\s*[～~ー―〜-]\s*(?:[0-9]{1,2}\s*月\s*)?[0-9]{1,2}(?=\s*日))?(\s*日(?![0-9])|(?![0-9A-Za-z_]))"
)


def fiscal_year(date: Column) -> Column:
    """April to March; null for no date."""
    return F.year(date) - (F.month(date) < 4).cast("int")


def date_of(text: Column) -> Column:
    """yyyy/MM/dd or yyyy-MM-dd text as a date."""
    return F.try_to_date(F.replace(text, F.lit("-"), F.lit("/")), "yyyy/M/d")


def _made(year: Column, month: Column, day: Column, least: int = 1000) -> Column:
    """A day of numbers, null for none. They are tested before: to read a text that is no day costs an exception, and most texts are none."""
    def made(x: Column) -> Column:
        y, m, d = x["y"], x["m"], x["d"]
        leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
        last = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
        return F.when(y.between(least, 9999) & m.between(1, 12) & (d >= 1) & (d <= last), F.make_date(y, m, d))

    return let(F.struct(year.cast("int").alias("y"), month.try_cast("int").alias("m"), day.try_cast("int").alias("d")), made)


def _era_year(base: int, year: Column) -> Column:
    return F.lit(base) + F.when(year == "元", F.lit(1)).otherwise(year.try_cast("int"))


def scanned_dates(text: Column) -> Column:
    """array<struct(kind, date)> of all dates in a text, in order; kind is the rank of the notation, and what is no day has a null date.

    Kinds: 0 and 1 the eras in words, 2 a year with its sign, 3 a year with slashes or dashes, 4 an era's letter, 5 two digits with dots. A
    year's sign in the month's place is read as the month's.
    """
    return scanned_plain(nfkc(text))


#: Groups of SCAN side by side, with a mark between them that no group holds.
_GROUPS = "\u0001".join(f"${i}" for i in range(1, 9))


def scanned_plain(t: Column) -> Column:
    """scanned_dates of a text in NFKC. Each date is matched once more for its groups, and what they say is worked out once."""
    for era, mark in ERA_MARKS.items():
        t = F.replace(t, F.lit(era), F.lit(mark))

    def said(g: Column) -> Column:
        mark, letter, year, s1, month, s2, day, end = (F.get(g, F.lit(i)) for i in range(8))
        signed = (s1 == "年") & s2.isin("年", "月") & (end == "日")
        slashed = s1.isin("/", "-") & s2.isin("/", "-")
        marked = [(signed & (mark == ERA_MARKS[era]), kind, _era_year(base, year)) for kind, (era, base) in enumerate(ERAS.items())]
        bare, four, number = (mark == "") & (letter == ""), F.length(year) == 4, year.try_cast("int")
        era_letter = (letter != "") & s1.isin(".", "/", "-") & s2.isin(".", "/", "-")
        by_letter = F.coalesce(*[F.when(F.upper(letter) == k, _era_year(base, year)) for k, base in LETTER_ERAS.items()])
        short = F.when(number.between(1, 15), number + 2018).when(number.between(16, 31), number + 1988)
        rules = [*marked, (bare & four & signed, 2, number), (bare & four & slashed, 3, number), (era_letter, 4, by_letter), (bare & (F.length(year) <= 2) & (s1 == ".") & (s2 == "."), 5, short)]
        found = F.coalesce(*[F.when(rule, F.struct(F.lit(k).alias("kind"), y.alias("of"))) for rule, k, y in rules])
        return let(found, lambda f: F.struct(f["kind"].alias("kind"), _made(f["of"], month, day).alias("date")))

    read = lambda x: let(F.transform(F.split(F.regexp_replace(x, SCAN, _GROUPS), "\u0001"), lambda s: F.trim(s)), said)
    return F.filter(F.transform(F.regexp_extract_all(t, F.lit(SCAN), F.lit(0)), read), lambda x: x["kind"].isNotNull())


def parse_era_date(text: Column) -> Column:
    """The first readable date by notation: of each the first one found, as long as it is a day. Null for none."""
    first = lambda found, kind: F.get(F.filter(found, lambda x: x["kind"] == kind), F.lit(0))["date"]
    return let(scanned_dates(F.trim(text)), lambda found: F.coalesce(*[first(found, kind) for kind in range(6)]))


def valid_date(text: Column, now: str) -> Column:
    """The text, trimmed, where it reads as a day from 1990 to two years ahead; else null."""
    year = F.year(parse_era_date(text))
    return F.when(year.between(1990, F.year(F.lit(now).cast("date")) + 2), F.trim(text))


def resolve_date(found: Column, title: Column, url: Column) -> Column:
    """struct(date, unconfirmed): the day that the page, else the title, else the address tells, as yyyy/MM/dd; else the sentinel, unconfirmed."""
    year, month, day = (F.regexp_extract(found, r"([0-9]{4})[/-]([0-9]{1,2})[/-]([0-9]{1,2})", i) for i in (1, 2, 3))
    loose = _made(year.try_cast("int"), month, day, 1)
    days = F.coalesce(parse_era_date(found), loose, parse_era_date(title), date_from_url(url))
    return let(days, lambda day: F.struct(F.coalesce(F.date_format(day, "yyyy/MM/dd"), F.lit(UNKNOWN_DATE)).alias("date"), day.isNull().alias("unconfirmed")))


def news_date(text: Column, base_year: Column) -> Column:
    """yyyy/MM/dd of a news item: its full date, else month and day in the base year, with no test of the day; null for none."""
    return news_date_plain(nfkc(text), base_year)


def news_date_plain(plain: Column, base_year: Column) -> Column:
    """news_date of a text in NFKC."""
    full = F.get(F.filter(scanned_plain(plain), lambda x: (x["kind"] <= 3) & x["date"].isNotNull()), F.lit(0))["date"]
    signed, slashed = r"(?<![0-9])([0-9]{1,2})月([0-9]{1,2})日", r"(?<![0-9A-Za-z_/-])([0-9]{1,2})[/-]([0-9]{1,2})(?![0-9A-Za-z_/-])"
    part = lambda i: F.when(plain.rlike(signed), F.regexp_extract(plain, signed, i)).otherwise(F.regexp_extract(plain, slashed, i)).try_cast("int")
    numbers = F.when(plain.rlike("[0-9]"), F.struct(part(1).alias("month"), part(2).alias("day")))
    short = let(numbers, lambda n: F.when(n["month"].between(1, 12) & n["day"].between(1, 31), F.format_string("%04d/%02d/%02d", base_year.cast("int"), n["month"], n["day"])))
    return F.coalesce(F.date_format(full, "yyyy/MM/dd"), short)


#: Words in front of a run of eight digits in a file's name.
FILE_WORDS = ("kai", "meeting", "giji")


def date_from_url(url: Column) -> Column:
    """The day that an address tells, from 1995 to 2035, without query and fragment.

    Names between slashes and dots are cut at dashes and underscores. A day is a part of four digits and two of one or two behind it, or a part of
    eight digits, also behind one of FILE_WORDS, or r or h with the era's year, month and day in one part or in three. Full years count before eras, parted ones before runs.
    """
    u = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), "[?#].*$", ""))
    parts = F.split(F.regexp_replace(u, "[/.]", "_|_"), "[_-]")
    # Each part with the two behind it.
    three = F.arrays_zip(parts.alias("a"), F.slice(parts, 2, 10_000).alias("b"), F.slice(parts, 3, 10_000).alias("c"))
    day = lambda y, m, d: F.when(m.rlike("^[0-9]{1,2}$") & d.rlike("^[0-9]{1,2}$"), _made(y, m, d))
    fits = lambda d: F.when(F.year(d).between(1995, 2035), d)
    first = lambda three, of: F.get(F.filter(F.transform(three, lambda x: fits(of(x["a"], x["b"], x["c"]))), lambda d: d.isNotNull()), F.lit(0))

    def parted(a, b, c):
        return F.when(a.rlike("^[0-9]{4}$"), day(a.try_cast("int"), b, c))

    def run(a, b, c):
        words = [F.when(F.contains(a, F.lit(w)), F.regexp_extract(F.substring_index(a, w, -1), "^[0-9]{8}", 0)) for w in FILE_WORDS]
        digits = F.coalesce(F.when(a.rlike("^[0-9]{8}$"), a), *[F.nullif(w, F.lit("")) for w in words])
        return day(F.substring(digits, 1, 4).try_cast("int"), F.substring(digits, 5, 2), F.substring(digits, 7, 2))

    def era(mark, base):
        def of(a, b, c):
            digits = F.regexp_extract(a, f"^{mark}0?([0-9]{{1,6}})$", 1)
            n = F.length(digits)
            whole = F.when(n.isin(5, 6), day(F.substring(digits, F.lit(1), n - 4).try_cast("int") + base, F.right(F.left(digits, n - 2), F.lit(2)), F.right(digits, F.lit(2))))
            return F.coalesce(whole, F.when(n.isin(1, 2), day(digits.try_cast("int") + base, b, c)))

        return of

    kinds = parted, run, era("r", ERAS["令和"]), era("h", ERAS["平成"])
    return let(three, lambda parts: F.coalesce(*[first(parts, of) for of in kinds]))


def in_range(date: Column, code: str, ref: str) -> Column:
    """7D, 30D, 90D, PAST_YEAR (365 days), YEAR and PREV_YEAR (fiscal) against a reference time; ALL or any other code is true.

    Days are fractions, so a time of day in ref leaves out the boundary day; later rows and missing dates are out.
    """
    at = F.lit(ref).cast("timestamp")
    days = {"7D": 7, "30D": 30, "90D": 90, "PAST_YEAR": 365}
    if code in days:
        gap = (F.unix_micros(at) - F.unix_micros(date.cast("timestamp"))) / 86_400_000_000
        return F.coalesce(gap.between(0, days[code]), F.lit(False))
    if code in ("YEAR", "PREV_YEAR"):
        return F.coalesce(fiscal_year(date) == fiscal_year(at) - (1 if code == "PREV_YEAR" else 0), F.lit(False))
    return F.lit(True)
