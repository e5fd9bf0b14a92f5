"""URL columns. Four normal forms are in use; each join names the one it needs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from minuteloom.functions import vocabulary as v
from minuteloom.functions.text import let
from minuteloom.functions.titles import closes_any, ends_any, has_any, has_one_of, holds_any, line

NEWS_HOSTS = "(twitter|facebook|youtube|instagram|line)\\.(com|me)|x\\.com"


def _part(url: Column, part: str) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit(part)), F.lit(""))


def host(url: Column) -> Column:
    return F.lower(_part(url, "HOST"))


def path(url: Column) -> Column:
    return F.regexp_replace(_part(url, "PATH"), "/+$", "")


def plain_url(url: Column) -> Column:
    """scheme://host/path without query, fragment and trailing slash; null is ''."""
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(F.concat(_part(url, "PROTOCOL"), F.lit("://"), _part(url, "AUTHORITY"), path(url)))


def clean_key(url: Column) -> Column:
    """host/path: no scheme, query or trailing slash."""
    return F.concat(F.lower(_part(url, "AUTHORITY")), path(url))


def canonical_url(url: Column) -> Column:
    """https, lower-case host, no index file, no trailing slash, query keys in order."""
    p = F.regexp_replace(F.regexp_replace(_part(url, "PATH"), "/index\\.[A-Za-z]+$", ""), "/+$", "")
    query = F.array_join(F.array_sort(F.split(_part(url, "QUERY"), "&")), "&")
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(F.concat(F.lit("https://"), F.lower(_part(url, "AUTHORITY")), p, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def schemeless(url: Column) -> Column:
    """As given but for scheme, fragment and trailing slash."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "^https?://", ""), "#.*$", ""), "/+$", "")


def numbers(url: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit("(\\d+)"), F.lit(1)), lambda x: x.try_cast("long"))


def is_government(url: Column) -> Column:
    return host(url).endswith(".go.jp")


def is_news_host(url: Column) -> Column:
    """A substring test of the whole host, so any host that holds one of the names matches."""
    return host(url).rlike(NEWS_HOSTS)


def safe_url(url: Column) -> Column:
    """Control characters stripped; only http(s) and relative links pass, else '#'."""
    u = F.trim(F.regexp_replace(F.coalesce(url, F.lit("")), "[\\x00-\\x1F\\x7F]", ""))
    return F.when(u.rlike("(?i)^(https?://|[/.?#])"), u).otherwise(F.lit("#"))


def material_type(declared: Column, url: Column) -> Column:
    """The declared type, else PDF for .pdf, HTML for any other url, PDF for none."""
    return F.coalesce(F.nullif(declared, F.lit("")), F.when(F.lower(url).endswith(".pdf"), "PDF").when(F.coalesce(url, F.lit("")) != "", "HTML").otherwise("PDF"))


def is_document(url: Column) -> Column:
    u = F.lower(F.coalesce(url, F.lit("")))
    return ends_any(u, v.DOCUMENTS) | F.contains(u, F.lit("/pdf/"))


def is_generic_index(url: Column, title: Column, url_parts: Column | None = None, words: Column | None = None) -> Column:
    """A portal, list or archive page, by address or title, or by the excluded parts and words of its ministry or council (array
    columns). No address is generic, a document never is."""
    u, t = F.lower(F.coalesce(url, F.lit(""))), F.trim(F.coalesce(title, F.lit("")))
    page = "(?:" + "|".join(v.INDEX_PAGES) + r")(?:\.html|/)?$"
    archive = r"agenda/meeting/[^/]+/archive\.html$|archive(?:_[0-9]+-[0-9]+)\.html$|/proceedings(?:_[a-z0-9_]+)?/(?:index\.html?)?$|/proceedings$|singi_kento/kento/[0-9]{4}/(?:index\.html)?$"

    def told(x: Column) -> Column:
        u, t, end = x["u"], x["t"], x["end"]
        archives = holds_any(u, ("archive", "proceedings", "kento")) & u.rlike(archive)
        pages = holds_any(u, v.INDEX_PAGES) & u.rlike(page)
        out = t.isin(*v.INDEX_TITLES_ALONE) | closes_any(end, v.INDEX_ENDS) | holds_any(u, v.INDEX_PARTS) | holds_any(t, v.INDEX_TITLES) | pages | archives
        for said, listed in ((u, url_parts), (t, words)):
            if listed is not None:
                out = out | has_one_of(said, listed)
        return (u == "") | out

    return ~u.rlike("(?:" + "|".join(re.escape(e) for e in v.DOCUMENTS) + ")$|/pdf/") & let(let(F.struct(u.alias("u"), t.alias("t")), lambda x: F.struct(x["u"].alias("u"), x["t"].alias("t"), line(x["u"]).alias("end"))), told)


#: A plain address with a path whose last name is not one of those that is_parent_or_nav asks for.
OTHER_PAGE = r"\Ahttps?://[A-Za-z0-9.-]+/(?:[A-Za-z0-9._~-]+/)*(?!(?:index(?:\.html)?|shingikai)/*\z)[A-Za-z0-9._~-]+/*\z"


def is_parent_or_nav(url: Column, target: Column) -> Column:
    """The target itself, or a shorter index page of its host."""
    a, b = (F.rtrim(F.coalesce(u, F.lit("")), F.lit("/")) for u in (url, target))

    def shorter(x: Column) -> Column:
        here = x["here"]
        index = (F.length(here) < F.length(x["there"])) & ((here == "") | here.rlike("/index(?:\\.html)?$"))
        return (index | here.isin("/shingikai/index.html", "/shingikai", "/index.html")) & (host(url) == host(target))

    # Most addresses are no index page's by their last name; those are not taken apart.
    return (a == b) | ~F.coalesce(url, F.lit("")).rlike(OTHER_PAGE) & let(F.struct(path(url).alias("here"), path(target).alias("there")), shorter)


def of_other_ministry(url: Column, ministry: Column, hosts: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Whether the host holds one of the hosts of other ministries; those that share a domain with the ministry's own are no others."""
    known = hosts if hosts is not None else v.MINISTRY_HOSTS
    every = sorted({d for ds in known.values() for d in ds})
    kin = lambda d, o: d == o or d.endswith(f".{o}") or o.endswith(f".{d}")
    others = {m: [d for d in every if not any(kin(d, o) for o in own)] for m, own in known.items()}
    return F.coalesce(*[F.when(ministry == m, has_any(host(url), ds)) for m, ds in others.items() if ds], F.lit(False))


def ministry_of_host(url: Column, hosts: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Ministries whose host the address has, or a host under it."""
    h = F.regexp_replace(host(url), r"^www\.", "")
    known = hosts if hosts is not None else v.MINISTRY_HOSTS
    of = lambda ds: F.lit(False) if not ds else h.isin(*ds) | ends_any(h, [f".{d}" for d in ds])
    return F.array_compact(F.array(*[F.when(of(ds), F.lit(m)) for m, ds in known.items()]))


def host_seconds(url: Column) -> Column:
    """Seconds to leave between two requests to the host."""
    h = host(url)
    return F.coalesce(*[F.when((h == d) | h.endswith(f".{d}"), F.lit(s)) for d, s in v.HOST_SECONDS.items()], F.lit(v.OTHER_HOST_SECONDS))


def subpage_priority(url: Column) -> Column:
    """3 for agendas and papers, 2 for folders and numbered pages, 1 for minutes alone, 0 for others."""
    u = F.lower(F.coalesce(url, F.lit("")))
    return F.when(has_any(u, ("gijishidai", "shiryo", "siryou", "haifu")), 3).when(u.rlike("/$|/index\\.html$|dai|kai"), 2).when(F.contains(u, F.lit("gijiroku")), 1).otherwise(0)


def is_browser_check(status: Column, body: Column) -> Column:
    """A page that checks the browser in place of an answer."""
    said = F.coalesce(body, F.lit(""))
    return (said != "") & ((status == 202) | has_any(F.lower(said), v.BROWSER_CHECKS))


def is_missing_page(status: Column, body: Column) -> Column:
    """403 or 404 with the words of a page that isn't there."""
    return status.isin(403, 404) & has_any(F.lower(body), v.MISSING_PAGES)
