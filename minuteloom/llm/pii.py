"""Operator 5: personal data, with offset-preserving deobfuscation.

Base identifiers are found on the text as it stands. Then three transducers rewrite the text while carrying, for each
character they emit, the source range it came from: look-alike letters and digits to ASCII (invisible characters
vanish), at/dot disguises to '@' and '.', runs of spelled digits to digits. The same detectors run on the
result, and what they find is mapped back to source ranges. Base spans always stay; a disguised span is added
where it touches no base span of its kind, or where it holds and widens those that it touches.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minuteloom.llm.common import in_batches, table, with_columns

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:long,end:long,disguised:boolean>>"

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping; each '@' is looked at once, so the cost is linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def detect(text: str) -> list[tuple[str, int, int]]:
    """Base spans (kind, start, end) of one text, in code points."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# Look-alike characters by the ASCII character they pass for.
LOOK_ALIKES = {
    "a": "аα", "c": "сϲ", "d": "ԁ", "e": "еε", "g": "ɡ", "h": "һ", "i": "іıι", "j": "ј", "k": "κ", "l": "ӏ", "m": "м", "n": "ո", "o": "оοօ", "p": "рρ",
    "q": "ԛ", "s": "ѕ", "u": "υս", "v": "ν", "w": "ԝ", "x": "хχ", "y": "уγ", "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј",
    "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "Υ", "Z": "Ζ", "-": "‐‑‒–−", ".": "․。｡", "@": "﹫",
}
#: Characters that show nothing.
INVISIBLE = "­​‌‍⁠﻿"
#: Digit words of English, French, German and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
FOLD = {ord(c): a for a, cs in LOOK_ALIKES.items() for c in cs} | {0xFF01 + i: chr(0x21 + i) for i in range(94)} | {ord(c): "" for c in INVISIBLE}
_FOLDED = re.compile("[" + "".join(re.escape(chr(c)) for c in FOLD if c < 0xFF01 or c > 0xFF5E) + "！-～]")
# Last parts of domains, needed where a dot is spelled in plain words, as prose has such words too.
TOP_DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|dev|app|io|co|ai|me|tv|eu|uk|us|ca|au|nz|ie|de|fr|es|it|nl|be|ch|at|pt|pl|se|no|dk|fi|jp|cn|kr|in|br|mx|ru"
# A blank run is entered at its start only and a spelled domain has ten parts at most, so the cost is linear in the text.
_DISGUISE = re.compile(
    r"(?:(?<!\s)\s+)?[\[({<]\s*(?:(?P<at>at|@)|(?P<dot>dot|\.))\s*[\])}>]\s*"
    r"|(?<=[a-z0-9])\s+(?P<at2>at)\s+(?=[a-z0-9-]+(?:\s+dot\s+|\s*[\[({<]\s*dot\b))|(?<=[a-z0-9-])\s+(?P<dot2>dot)\s+"
    rf"(?=(?:[a-z0-9-]+\s+dot\s+){{0,8}}(?:{TOP_DOMAINS})(?![a-z0-9-])|[0-9])",
    re.I,
)
_DISGUISE_SIGN = re.compile(r"[\[({<]\s*(?:at|@|dot|\.)\s*[\])}>]|\bdot\b", re.I)
_DIGIT_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + "|[0-9]+)"
_SPELLED = re.compile(rf"(?<!\w)(?:plus[\s,.-]+)?{_DIGIT_WORD}(?:[\s,.()-]+{_DIGIT_WORD}){{6,}}(?!\w)", re.I)
_SPELLED_PART = re.compile(r"\w+")
DIGIT_SET = frozenset(DIGIT_WORDS)


class Mapped:
    """A text and, for each of its characters, the source range it stands for, in arrays of 32-bit numbers."""

    __slots__ = ("text", "first", "last", "spelled")

    def __init__(self, text: str, first, last, spelled: list[tuple[int, int]] = ()):
        self.text, self.first, self.last, self.spelled = text, first, last, list(spelled)

    @classmethod
    def of(cls, text: str) -> Mapped:
        import numpy as np

        first = np.arange(len(text), dtype=np.int32)
        return cls(text, first, first + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Replace [start, end) by a string, for edits in order; every new character stands for the whole range."""
        import numpy as np

        if not edits:
            return Mapped(self.text, self.first, self.last)
        parts, at = [], 0
        for start, end, new in edits:
            parts += [self.text[at:start], new]
            at = end
        parts.append(self.text[at:])
        starts, ends, sizes = (np.array(x, dtype=np.int64) for x in ([e[0] for e in edits], [e[1] for e in edits], [len(e[2]) for e in edits]))
        # Each character of the new text comes from one of this text: kept ones from themselves, new ones from the first or last of their range.
        kept = np.ones(len(self.text), dtype=bool)
        grown = np.zeros(len(self.text) + 1, dtype=np.int32)
        np.add.at(grown, starts, 1)
        np.add.at(grown, ends, -1)
        kept[np.cumsum(grown[:-1]) > 0] = False
        own = np.flatnonzero(kept)
        place = np.searchsorted(own, starts)  # of the new characters among the kept ones
        merged = [np.insert(side[own], np.repeat(place, sizes), np.repeat(side[at], sizes)) for side, at in ((self.first, starts), (self.last, ends - 1))]
        return Mapped("".join(parts), *merged)


class Taken:
    """Spans of one kind that are in use: the widest of those that overlap, apart from each other and in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [s for s, _ in spans], [e for _, e in spans]

    def touches(self, start: int, end: int) -> tuple[int, int]:
        """The spans from the first to before the second number overlap [start, end)."""
        return bisect_right(self.ends, start), bisect_left(self.starts, end)

    def add(self, start: int, end: int) -> bool:
        """Takes the span, where it holds all that it overlaps and equals none."""
        i, j = self.touches(start, end)
        if i < j and (self.starts[i] < start or self.ends[j - 1] > end or (self.starts[i], self.ends[i]) == (start, end)):
            return False
        self.starts[i:j], self.ends[i:j] = [start], [end]
        return True


def fold_look_alikes(m: Mapped) -> Mapped:
    return m.rewrite([(x.start(), x.end(), FOLD[ord(x[0])]) for x in _FOLDED.finditer(m.text)])


def undo_disguises(m: Mapped) -> Mapped:
    return m.rewrite([(x.start(), x.end(), "@" if x["at"] or x["at2"] else ".") for x in _DISGUISE.finditer(m.text)])


def undo_spelling(m: Mapped) -> Mapped:
    """Digits of spelled runs; the runs' places in the new text are kept in `spelled`."""
    edits, runs, shift = [], [], 0
    for x in _SPELLED.finditer(m.text):
        words = _SPELLED_PART.findall(x[0].lower())
        if sum(w in DIGIT_SET for w in words) < 4:
            continue
        new = "".join("+" if w == "plus" else DIGIT_WORDS.get(w, w) for w in words)
        edits.append((x.start(), x.end(), new))
        runs.append((x.start() + shift, x.start() + shift + len(new)))
        shift += len(new) - (x.end() - x.start())
    out = m.rewrite(edits)
    out.spelled = runs
    return out


def looks_disguised(text: str) -> tuple[bool, bool, bool]:
    """Cheap tests for what each transducer needs to have anything to do, none narrower than its pattern.

    Every branch of _DISGUISE has what _DISGUISE_SIGN finds, and undo_spelling takes runs of whole words, four of them
    digit words; undoing a disguise replaces no word but 'at' and 'dot', so the words can be counted in the text itself.
    """
    folded = not text.isascii() and _FOLDED.search(text) is not None
    dots = _DISGUISE_SIGN.search(text) is not None
    return folded, dots, folded or sum(w in DIGIT_SET for w in _SPELLED_PART.findall(text.lower())) >= 4


def find_spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """All spans of one text by start, then kind: (kind, start, end, disguised). None for a null text."""
    if not text:
        return []
    base = detect(text)
    out = [(*s, False) for s in base]
    folded, dots, digits = looks_disguised(text)
    if folded or dots or digits:
        m = Mapped.of(text)
        for wanted, step in ((folded, fold_look_alikes), (dots or folded, undo_disguises), (digits, undo_spelling)):
            if wanted:
                m = step(m)
        if m.text != text:
            found = detect(m.text)
            cards = Taken([(s, e) for k, s, e in found if k == "card"])
            for s, e in m.spelled:
                i, j = cards.touches(s, e)
                if 10 <= e - s <= 15 and m.text[s] != "+" and i == j:
                    found.append(("phone", s, e))
            taken = {kind: Taken([(s, e) for k, s, e in base if k == kind]) for kind in KINDS}
            for kind, s, e in found:
                start, end = int(m.first[s]), int(m.last[e - 1])
                if m.text[s:e] != text[start:end] and taken[kind].add(start, end):
                    out.append((kind, start, end, True))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str | None, spans: list[tuple[str, int, int, bool]]) -> str | None:
    """Each run of overlapping spans becomes its first kind in brackets."""
    if not spans:
        return text
    out, at, k = [], 0, 0
    while k < len(spans):
        kind, start, end, _ = spans[k]
        while k < len(spans) and spans[k][1] < end or spans[k : k + 1] and spans[k][1] == start:
            end = max(end, spans[k][2])
            k += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, keep: list[str], text_col: str = "text", out: str = "spans") -> DataFrame:
    """The columns `keep`, and the spans as `out` for every row. Null and empty texts have none; rows are never merged.

    Repeated rows have their spans each, and an empty table gives no rows. A kept column called like `out` gives way to it.
    """

    def finder():
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_())]))
        return lambda column: [pa.array([[dict(zip(("kind", "start", "end", "disguised"), s)) for s in find_spans(t)] for t in column.to_pylist()], kind)]

    return with_columns(docs, keep, text_col, f"`{out}` {SPANS}", finder)


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with its text redacted in place; all columns and rows stay as they are, whatever the columns' names.

    Null texts stay null, empty ones empty, repeated rows are redacted each, and an empty table gives no rows.
    """
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cols = b.columns
            cols[at] = pa.array([redact(t, find_spans(t)) for t in cols[at].to_pylist()], cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    held = in_batches(docs.toDF(*[f"c{i}" for i in range(len(names))]))
    return held.mapInArrow(run, held.schema).toDF(*names)


def span_text(spans) -> F.Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def count_of(spans, kind: str) -> F.Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op5_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_* and base_sha256 are of the base spans; spans holds the disguised ones too, n_disguised counts them."""
    found = find_pii(table(spark, sf_dir, "documents"), ["doc_id"])
    base = F.filter("spans", lambda s: ~s["disguised"])
    return found.select(
        "doc_id",
        *[count_of(base, k).alias(f"n_{k}") for k in KINDS],
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["disguised"])).cast("long").alias("n_disguised"),
    )
