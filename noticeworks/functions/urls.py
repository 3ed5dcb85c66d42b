"""Addresses: normal form, host, extension, score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text

ATTACHMENT = r"(?i)\.(xlsx|xls|pdf|docx)(?:\?|#|$)"
#: Fixed values: (pattern on the address in lower case, points), and those on the title.
SCORES = ((r"\.edu\.cn", 2), (r"rsc\.|rs\.|hr\.|renshi|rlzy|rczp|zpxx|zp\.|zhaopin|rsxx|rszp|招聘", 3), (r"\.(?:pdf|doc|docx|xlsx|xls|zip|rar)(?:\?|#|$)", -5), ("javascript:|#", -5), ("login|register|javascript", -3), (r"rst\.hunan\.gov\.cn.*/t20[0-9]{6}_[0-9]+\.html", -2))
TITLE_SCORES = (("招聘|招贤|引才|人才|人事", 2),)
#: An index page counts where the address also has one of the words.
INDEX_SCORE = (r"index\.html?(?:\?|#|$)", "zpxx|zp|rsxx|招聘", 1)
DETAIL = (r"(?i)/info/[0-9]+/[0-9]+\.(?:htm|html|shtml|aspx)(?:\?|#|$)", r"(?i)/content\.jsp|article_[0-9]+|/([0-9]{4})/([0-9]{2})/[0-9]+")
COLUMN_PAGES = r"(?i)/zczd/|/jgsz/|/bszn/|/zcfg/|column/|list\.(?:htm|html|aspx)$"


def normal(url: Column) -> Column:
    """Without query and fragment, index page and final slash, in lower case."""
    bare = F.regexp_replace(text(url), r"[?#].*$", "")
    bare = F.regexp_replace(bare, r"(?i)/index\.html?$", "")
    return F.lower(F.when(bare.rlike(r"^[a-zA-Z]+://[^/]+/.*/$"), F.regexp_replace(bare, "/$", "")).otherwise(bare))


def host(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(text(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1), F.lit("")))


def attachment_kind(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(text(url), ATTACHMENT, 1)), F.lit(""))


def score(url: Column, title: Column | None = None, scores=SCORES, title_scores=TITLE_SCORES, index=INDEX_SCORE) -> Column:
    """Points of an address and its link's title for being a list of notices."""
    u, out = F.lower(text(url)), F.lit(0)
    for pattern, n in scores:
        out = out + F.when(u.rlike(pattern), n).otherwise(0)
    for pattern, n in title_scores if title is not None else ():
        out = out + F.when(F.lower(text(title)).rlike(pattern), n).otherwise(0)
    if index:
        out = out + F.when(u.rlike(index[0]) & u.rlike(index[1]), index[2]).otherwise(0)
    return out


def is_list_page(url: Column, title: Column, least: int = 4) -> Column:
    return score(url, title) >= least


def path_and_query(url: Column) -> Column:
    """From the path up to the fragment, / where there is none; null for what is no absolute address."""
    return F.when(host(url).isNotNull(), F.regexp_extract(text(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^#]*)", 1))


def is_detail_page(url: Column, list_url: Column | None = None) -> Column:
    """The shape of a notice's own page, on the list's host if one is given."""
    same = F.lit(True) if list_url is None else F.coalesce((text(list_url) == "") | (host(url) == host(list_url)), F.lit(False))
    p = path_and_query(url)
    return F.coalesce(text(url).rlike("(?i)^https?://") & same & (p.rlike(DETAIL[0]) | p.rlike(DETAIL[1])), F.lit(False))


def is_column_page(url: Column) -> Column:
    """The shape of a site's column page."""
    return F.coalesce(F.lower(F.regexp_replace(path_and_query(url), r"\?.*$", "")).rlike(COLUMN_PAGES), F.lit(False))


def links(html: Column) -> Column:
    """array<string>: each address of an anchor once, in order."""
    return F.array_distinct(F.regexp_extract_all(text(html), F.lit(r'<a [^>]*href="([^"#]+)"'), 1))


def title(html: Column) -> Column:
    return F.nullif(F.regexp_extract(text(html), r"<title>([^<]*)</title>", 1), F.lit(""))


def page_text(html: Column) -> Column:
    """A page's text: without scripts, styles, frames, menus, comments and tags, white space collapsed."""
    out = text(html)
    for tag in ("script", "style", "noscript", "iframe", "nav", "footer", "header"):
        out = F.regexp_replace(out, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    out = F.regexp_replace(F.regexp_replace(out, "(?s)<!--.*?-->", " "), "<[^>]*>", " ")
    for name, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(mark))
    return F.trim(F.regexp_replace(out, r"[\x09-\x0D\x20]+", " "))


def without_dots(path: Column) -> Column:
    """A path that starts with a slash, its `.` and `..` segments resolved."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"), lambda out, p: F.when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(p == ".", out).otherwise(F.concat(out, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))


def resolve(href: Column, base: Column) -> Column:
    """An address as seen from a page: absolute ones stay, others take what they lack from the page's address.

    Null where the page's address is needed and isn't absolute. Hosts are lower-cased and dot segments resolved.
    """
    h, b = F.trim(text(href)), text(base)
    scheme = F.lower(F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    site = F.concat(scheme, F.lit("://"), F.lower(F.regexp_extract(b, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)))
    path = F.regexp_extract(b, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    tail = F.regexp_extract(h, r"^[^?#]*(.*)$", 1)
    own = F.regexp_extract(h, "^([^?#]*)", 1)
    absolute = F.concat(F.lower(F.regexp_extract(h, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)), without_dots(F.regexp_replace(F.regexp_extract(h, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), "^$", "/")), tail)
    out = F.when(h.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), absolute).when(h.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), h).when(scheme == "", None)
    out = out.when(h.startswith("//"), F.concat(scheme, F.lit(":"), h)).when(h == "", F.concat(site, path, F.regexp_extract(b, r"^[^?#]*(\?[^#]*)", 1)))
    out = out.when(h.startswith("#"), F.concat(site, path, F.regexp_extract(b, r"^[^?#]*(\?[^#]*)", 1), h)).when(h.startswith("?"), F.concat(site, path, h))
    return out.when(h.startswith("/"), F.concat(site, without_dots(own), tail)).otherwise(F.concat(site, without_dots(F.concat(F.regexp_replace(path, "[^/]*$", ""), own)), tail))
