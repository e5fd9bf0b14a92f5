"""Text columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from minuteloom.functions.udf import nfkc

# Radicals that NFKC leaves, and the characters they stand for.
RADICALS = "⺠⺁⺄⺅⺈⺌⺐⺗⺘⺝⺡⺢⺣⺤⺧⺨⺮⺱⺲⺳⺶⺷⺻⻁⻂⻅⻋⻎⻐⻑⻔⻖⻝"
RADICAL_TARGETS = "民人ノ亻刀小山心手日水火犬王礻糸肉艸艹衤言貝車金長門雨青食長首高鬼"
RADICAL_CLASS = "[\\x{2E80}-\\x{2EF3}\\x{2F00}-\\x{2FD5}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it; without it plans spell the value out each time. body calls no Python function."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def search_text(*parts: Column) -> Column:
    """NFKC and lower case of all parts side by side; null parts are left out."""
    return F.lower(nfkc(F.concat_ws(" ", *parts)))


def normal_text(text: Column) -> Column:
    """Radicals to characters, NFKC, runs of white space to one blank, trimmed; null to ''."""
    return F.trim(F.regexp_replace(nfkc(F.translate(F.coalesce(text, F.lit("")), RADICALS, RADICAL_TARGETS)), r"(?U)[\s\x{3000}]+", " "))


_RADICALS, _TARGETS = re.compile(f"[{RADICALS}]"), str.maketrans(RADICALS, RADICAL_TARGETS)
_WHITE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: The longest text whose normal form is kept for the next one that is like it.
KEPT_TEXT = 100


def plain(text: str) -> str:
    """NFKC of a text."""
    return text if text.isascii() or unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)


def _normal(text: str) -> str:
    said = plain(text)
    return _WHITE.sub(" ", said.translate(_TARGETS) if _RADICALS.search(said) else said).strip(" ")


class Kept(dict):
    """What a function gave for texts, up to a number of them; empty in each task that it is sent to, as caches of functools don't go there."""

    MOST = 4096

    def __init__(self, of: Callable):
        self.of = of

    def __missing__(self, text):
        if len(self) >= self.MOST:
            self.clear()
        found = self[text] = self.of(text)
        return found

    def __reduce__(self):
        return Kept, (self.of,)


_known_normal = Kept(_normal)


def normal(text: str) -> str:
    """normal_text of a text that is in Python already, so that no column has to go there once more."""
    return _known_normal[text] if len(text) <= KEPT_TEXT else _normal(text)


def ascii_digits(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "０１２３４５６７８９", "0123456789")


def terms(query: str) -> list[str]:
    """Search terms: split on white space, the ideographic one included; lower-cased after NFKC."""
    return unicodedata.normalize("NFKC", query).lower().split()


def bigrams(text: Column) -> Column:
    """Distinct character bigrams without blanks, brackets, marks, ordinal signs and digits; a single character is itself."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\s\\x{3000}・、。()（）「」『』【】第回0-9０-９]+", "")
    many = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))
    return F.array_distinct(F.when(F.length(s) >= 2, many).when(F.length(s) == 1, F.array(s)).otherwise(F.array().cast("array<string>")))


def csv_field(text: Column) -> Column:
    """A leading = + - @ gets an apostrophe; null is ''."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike("^[=+\\-@]"), F.concat(F.lit("'"), t)).otherwise(t)


def capitalize(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 2**30))


def escape_html(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(c), F.lit(e))
    return out


def radical_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(RADICAL_CLASS)), F.lit(0))


def sessions(text: Column) -> Column:
    """Distinct session numbers: 第N回, daiN, and up to three digits behind a slash or underscore before an underscore, dot, pdf or giji."""
    t = F.lower(ascii_digits(normal_text(text)))
    every = [F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in (r"第\s*([0-9]+)\s*回", r"dai\s*([0-9]+)", r"[/_]([0-9]{1,3})(?:[_.]|pdf|giji)")]
    return F.array_compact(F.array_distinct(F.transform(F.concat(*every), lambda x: x.try_cast("int"))))


def is_council_id(text: Column) -> Column:
    return F.coalesce(text.rlike("^[a-z0-9]+-[a-z0-9_]+$"), F.lit(False))


def is_meeting_id(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[a-z0-9]+-[a-z0-9_]+-\d{8}-(\d{3,4}|[a-z]\d{2,3})$"), F.lit(False))


def ministry_of(identifier: Column) -> Column:
    """Upper-case prefix of an id; ENV is an alias of MOE."""
    code = F.upper(F.split_part(identifier, F.lit("-"), F.lit(1)))
    return F.when(code == "ENV", "MOE").otherwise(code)


def bytes_label(size: Column, units: tuple[str, ...] = ("B", "KB", "MB", "GB", "TB", "PB")) -> Column:
    """A size in the largest of the units that leaves it at 1 or more, with two decimals."""
    label = lambda i: F.format_string(f"%.2f {units[i]}", size / F.lit(float(1024**i)))
    return F.coalesce(*[F.when(size < 1024 ** (i + 1), label(i)) for i in range(len(units) - 1)], label(len(units) - 1))
