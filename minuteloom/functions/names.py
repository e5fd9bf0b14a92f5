"""Names of councils and titles of meetings: category, cleaned name, core name, stem."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from minuteloom.functions.text import normal_text

# Categories and the words that tell them; the first category with a word in the text holds.
CATEGORY_WORDS = {
    "EXPERT_COMMITTEE": ("専門調査会", "専門委員会", "専門審査会"),
    "SPECIAL_COMMITTEE": ("特別委員会",),
    "TASKFORCE": ("タスクフォース", "TF"),
    "SUBCOMMITTEE": ("分科会",),
    "SECTION": ("部会",),
    "WORKING_GROUP": ("ワーキンググループ", "ワーキング・グループ", "作業部会", "作業班", "WG"),
    "PANEL": ("有識者会議",),
    "ROUNDTABLE": ("懇談会",),
    "STUDY": ("スタディグループ", "スタディ・グループ", "SG", "検討会", "研究会", "協議会"),
    "LIAISON": ("関係閣僚会議", "連絡会議"),
    "HQ": ("本部", "推進会議"),
    "ADVISORY": ("諮問会議",),
    "COMMITTEE": ("審査会", "委員会"),
    "COUNCIL": ("審議会", "会合"),
}
# Labels in front of a name, papers and phrases behind it, the signs around it, and what a title's bracket says of its day.
LABELS = ("審議会等", "報道発表", "会議等", "その他", "国際政策", "財総研", "お知らせ", "新着情報", "トピックス", "プレスリリース")
PAPERS_BEHIND = ("配布資料", "配付資料", "について", "開催概要", "議事要旨", "議事録", "議事次第", "議事概要")
FROM_HERE_ON = ("の開催について", "開催について", "の開催案内", "開催案内", "報告書")
TO_THE_END = ("取りまとめ",)
OPENING, CLOSING = "「『【[(", "」』】])"
DAY_NOTES = ("開催", "非公開", "不明")
ERA_WORDS = ("令和", "平成")
#: Numbers of rounds, terms and years, in digits or in signs.
_N = "[0-9一-九]+"
_ERA = "(?:" + "|".join(ERA_WORDS) + ")"


def _without(text: Column, *patterns: str) -> Column:
    """The text without what the patterns match, one after another; \\s is any blank."""
    return reduce(lambda t, p: F.regexp_replace(t, "(?U)" + p, ""), patterns, text)


def _before(text: Column, word: str) -> Column:
    """What stands before the first occurrence of a word."""
    return F.substring_index(text, word, 1)


def _bare(text: Column) -> Column:
    """A name without what stands in front of it and behind it, in that order."""
    opening = "".join("\\" + c for c in OPENING)
    closing = "".join("\\" + c for c in CLOSING)
    tagged = "|".join(f"\\{a}[^\\{b}]+\\{b}" for a, b in ("〈〉", "<>", "【】", "[]"))
    front = _without(text, rf"^(?:{'|'.join(LABELS)})[\s:]+", rf"^(?:{tagged})(?:\s*\(更新\))?\s*")
    when = rf"^{_ERA}\s*[0-9一-九元]+\s*年\s*{_N}\s*月\s*{_N}\s*日(?:開催)?\s*"
    front = _without(front, when, rf"^{_ERA}\s*[0-9一-九元]+\s*年度\s*", r"^[0-9]{4}\s*年度\s*", rf"^第\s*{_N}\s*期\s*", rf"^第{_N}回\s*")
    held = _without(front, rf"\(第{_N}回.*?\)", r"【[0-9]+月[0-9]+日開催】", r"【[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}開催】", rf"\s*第{_N}回.*")
    named = reduce(_before, FROM_HERE_ON, held)
    ended = _without(F.trim(named), rf"\s*(?:{'|'.join(PAPERS_BEHIND)}|(?:{'|'.join(TO_THE_END)}).*)$")
    return _without(ended, rf"^[{opening}\s]+", rf"[{closing}\s]+$")


def category(text: Column) -> Column:
    """struct(code, is_default): the first category whose word the text holds, else COUNCIL as a default. Null has none."""
    said = F.coalesce(text, F.lit(""))
    found = F.coalesce(*[F.when(said.rlike("|".join(words)), code) for code, words in CATEGORY_WORDS.items()])
    return F.struct(F.coalesce(found, F.lit("COUNCIL")).alias("code"), found.isNull().alias("is_default"))


def clean_name(name: Column) -> Column:
    """The council's name alone; null is ''."""
    return F.trim(_bare(normal_text(name)))


def core_name(name: Column) -> Column:
    """The cleaned name without what brackets add, years, terms, blanks and marks, in lower case; equal for spellings of one name."""
    plain = F.regexp_replace(normal_text(name), r"\([^)]*\)?", "")
    year, term = rf"^(?:{'|'.join(ERA_WORDS)}|[0-9]{{4}})\S*年度?\s*", r"^第\s*[0-9]+\s*期\s*"
    return F.lower(F.trim(_without(_bare(plain), year, term, "について$", r"[\s・~―\-_:/()]")))


def title_stem(title: Column) -> Column:
    """A meeting's title without round, year, date note, list number and blanks."""
    round_, year = r"\(?\s*第\s*[0-9]+\s*回\s*\)?", rf"(?:{_ERA}\s*[0-9]+|[0-9]{{4}})\s*年度?"
    note, number = rf"\([^)]*(?:{'|'.join(DAY_NOTES)})[^)]*\)", r"^[0-9一二三四五六七八九十]+[.、\s]+"
    return F.trim(_without(normal_text(title), round_, year, note, number, r"[\s・_/]"))


def is_round_or_date_only(title: Column) -> Column:
    """A title made of a round, a year, a day and how the meeting was held alone; such titles fit any council. Null and '' are none."""
    plain = normal_text(title)
    number = "[0-9一二三四五六七八九十百千元]+"
    round_, year = rf"第\s*{number}\s*[回次](?:合同会議)?", rf"(?:令和|平成|昭和)\s*{number}\s*年度?|[0-9]{{4}}\s*年度?"
    day, held = r"[0-9]{4}[/.-][0-9]{1,2}[/.-][0-9]{1,2}|[0-9]{1,2}\s*月\s*(?:[0-9]{1,2}\s*日)?", "持ち回り開催|持ち回り|書面開催|書面|非公開|公開|開催|議事次第|配付資料|資料"
    return (plain != "") & (_without(plain, round_, year, day, held, r"[\s・_/()\-~〜:,.]") == "")


def name_in_news(title: Column, words: list[str]) -> Column:
    """The council that a news title names, or '': a bracketed name with one of the words, else what stands before the end of the longest word.

    What stands behind the last dash before such a name counts; names have four characters at least.
    """
    said = _without(normal_text(title), rf"^(?:{'|'.join(LABELS)})[\s:]+")
    some = "|".join(words)
    said = F.regexp_replace(said, rf"^.*?[~―－](?=[^~―－]+(?:{some}))", "")
    first = lambda i: _bare(F.coalesce(F.get(F.regexp_extract_all(said, F.lit("[「『【]([^」』】]+)[」』】]"), F.lit(1)), F.lit(i)), F.lit("")))
    fits = lambda c: c.rlike(some) & (F.length(c) >= 4)
    bracket = [F.when(fits(first(i)), first(i)) for i in range(3)]
    plain = _bare(said)
    cut = [F.when(F.contains(plain, F.lit(w)), F.concat(F.substring_index(plain, w, 1), F.lit(w))) for w in sorted(words, key=len, reverse=True)]
    found = [F.when(fits(F.trim(_bare(c))), F.trim(_bare(c))) for c in cut]
    return F.coalesce(*bracket, *found, F.lit(""))
