"""URL functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEAD = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^@/?#]*@)?"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _HEAD + r"([^:/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _HEAD + r"[^/?#]*([^?#]*)", 1)


def last_extension(url: Column) -> Column:
    """The part of the path behind its last dot, in ASCII lower case (the whole path if there is none)."""
    return F.translate(F.substring_index(path(url), ".", -1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def valid(url: Column) -> Column:
    """Whether the text parses as an absolute URL with a host."""
    return F.coalesce(url.rlike(_HEAD + r"[^:/?#\s]+(:[0-9]*)?([/?#]\S*)?$"), F.lit(False))


def markdown_url(url: Column) -> Column:
    """Where a site would serve the markdown of a page: x.md, and index.md for the root; query and fragment stay."""
    p = path(url)
    renamed = F.when(p.isin("/", ""), "/index.md").otherwise(F.concat(F.regexp_replace(p, "/$", ""), F.lit(".md")))
    return F.concat(F.regexp_extract(url, "(" + _HEAD + r"[^/?#]*)", 1), renamed, F.regexp_extract(url, r"^[^?#]*(.*)$", 1))


def match_key(url: Column) -> Column:
    """Without the fragment and one trailing slash."""
    bare = F.regexp_extract(url, r"^([^#]*)", 1)
    return F.when(F.length(bare) > 1, F.regexp_replace(bare, "/$", "")).otherwise(bare)


def archive_probe(url: Column) -> Column:
    escaped = url
    for a, b in (("%", "%25"), ("#", "%23"), ("&", "%26"), ("+", "%2B"), (" ", "%20")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    return F.concat(F.lit("https://archive.org/wayback/available?url="), escaped)


def archive_raw(snapshot: Column) -> Column:
    """A snapshot's address with id_ behind its digits, which serves the page as it was; null if it isn't a snapshot's."""
    shape = r"^(.*?/web/)(\d+)/(.*)$"
    return F.when(snapshot.rlike(shape), F.concat(F.regexp_extract(snapshot, shape, 1), F.regexp_extract(snapshot, shape, 2), F.lit("id_/"), F.regexp_extract(snapshot, shape, 3)))


def charset_of_header(content_type: Column) -> Column:
    found = F.regexp_extract(content_type, r"""(?i)(?:^|;)\s*charset=\s*["']*([^;"']*)""", 1)
    return F.nullif(F.trim(found), F.lit(""))


def charset_of_meta(html: Column) -> Column:
    found = F.regexp_extract(F.substring(html, 1, 4096), r"""(?i)<meta[^>]*?charset\s*=\s*["']?([^\s>/;"']+)""", 1)
    return F.nullif(found, F.lit(""))


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def first_heading(markdown: Column) -> Column:
    return F.when(markdown.rlike(r"(?m)^# "), F.trim(F.regexp_extract(markdown, r"(?m)^# (.*)$", 1)))
