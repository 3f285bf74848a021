"""Predicates over bodies, URLs and cache rows, as Columns that Catalyst can push down and compile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.urls import host, last_extension, path

#: Unicode white space, spelled out so that every regex dialect agrees on it.
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The other characters, as ranges with those of most texts first: many times faster than the same class as a negation.
NO_SPACE = r"!-~\x00-\x08\x0E-\x1F\x7F-\x{84}\x{86}-\x{9F}\x{A1}-\x{167F}\x{1681}-\x{1FFF}\x{200B}-\x{2027}\x{202A}-\x{202E}\x{2030}-\x{205E}\x{2060}-\x{2FFF}\x{3001}-\x{10FFFF}"
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases of pages that turn an automated reader away.
BLOCK_PHRASES = [
    "your request could not be processed",
    "please note that your reference id is",
    "please contact support",
    "access denied",
    "reference #",
    "you don't have permission to access",
    "the requested url was rejected",
    "please verify you are a human",
    "prove you are a human",
    "checking your browser",
    "just a moment",
    "verifying you are human",
    "pardon our interruption",
    "unusual traffic",
    "automated requests",
    "are you a robot",
]
BLOCK_BYTES = 4096
# Endings for which no markdown variant is probed.
NOT_PROBED = ["md", "markdown", "txt", "json", "xml", "css", "js"]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def trimmed_bytes(c: Column) -> Column:
    return F.octet_length(trimmed(c))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[{NO_SPACE}]+"))


def has_words(c: Column, least: int) -> Column:
    """Whether a text has so many words; reads no further than the last of them."""
    return c.rlike(rf"\A[{SPACE}]*+(?:[{NO_SPACE}]++[{SPACE}]++){{{least - 1}}}[{NO_SPACE}]")


def _thin(c: Column, size: int, words: int) -> Column:
    return (trimmed_bytes(c) < size) | ~has_words(c, words)


def is_html(content_type: Column) -> Column:
    return F.coalesce(ascii_lower(content_type).contains("html"), F.lit(False))


def is_text_plain(content_type: Column) -> Column:
    return F.coalesce(ascii_lower(content_type).startswith("text/plain"), F.lit(False))


def looks_like_markdown(content_type: Column, url: Column) -> Column:
    ct = ascii_lower(content_type)
    declared = ct.startswith("text/markdown") | ct.startswith("text/x-markdown")
    return F.coalesce(declared | (ct.startswith("text/plain") & last_extension(url).isin("md", "markdown")), F.lit(False))


def has_real_content(text: Column) -> Column:
    return ~_thin(text, 32, 8)


def looks_like_stub(text: Column) -> Column:
    return _thin(text, 200, 40)


def worth_escalating(text: Column) -> Column:
    return _thin(text, 100, 20)


def looks_like_bot_block(text: Column) -> Column:
    """The length guard is a CASE, so long pages aren't searched."""
    low = ascii_lower(text)
    hit = reduce(lambda a, b: a | b, [low.contains(p) for p in BLOCK_PHRASES])
    return F.when(F.octet_length(text) <= BLOCK_BYTES, hit).otherwise(F.lit(False))


def markdown_probe_eligible(url: Column) -> Column:
    return ~last_extension(url).isin(NOT_PROBED)


def html_masquerade(text: Column) -> Column:
    return text.rlike(f"^[{SPACE}]*(<!DOCTYPE html|<html)")


def looks_like_pdf_url(url: Column) -> Column:
    return ascii_lower(F.substring_index(path(url), "/", -1)).endswith(".pdf")


def is_pdf_body(content_type: Column, body: Column) -> Column:
    ct = ascii_lower(content_type)
    return F.coalesce(ct.contains("pdf") | ct.startswith("application/octet-stream"), F.lit(True)) & (F.substring(body, 1, 5) == F.encode(F.lit("%PDF-"), "UTF-8"))


def is_archive(url: Column) -> Column:
    return host(url).isin("web.archive.org", "archive.org") | host(url).endswith(".archive.org")


def snapshot_usable(available: Column, status: Column) -> Column:
    return available & F.coalesce(status.startswith("2"), F.lit(True))


def is_origin_root(url: Column) -> Column:
    return path(url).isin("/", "")


def eval_passes(text: Column) -> Column:
    """Of the text without a warning banner: at least 200 bytes of lines with collapsed blanks, and 40 words."""
    from webloom.functions.text import strip_banner

    body = strip_banner(text)
    lines = F.transform(F.split(F.regexp_replace(body, r"\n\z", ""), "\n"), lambda x: F.octet_length(F.trim(F.regexp_replace(x, "[ \\t]+", " "))) + 1)
    size = F.aggregate(lines, F.lit(0).cast("int"), lambda a, b: a + b)
    return (size >= 200) & (F.regexp_count(body, F.lit(r"[^ \t\n\x0B\f\r]+")) >= 40)


def fresh_for_lookup(expires_at: Column, now: Column) -> Column:
    return F.coalesce(expires_at >= now, F.lit(True))


def fresh_for_stats(expires_at: Column, now: Column) -> Column:
    """Unlike a lookup, statistics count a row that expires right now as expired."""
    return F.coalesce(expires_at > now, F.lit(True))
