"""The last steps on a chosen text: clean lines, a link table, a token budget; and bytes to text."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.text import CUTS, LABEL, RESERVE, WINDOW, by_row, postprocess
from webloom.functions.urls import charset_of_header, charset_of_meta
from webloom.operators.links import linkified, linkify


def truncate(markdown: str, tokens: int, label: str = LABEL) -> str:
    """As functions.text.truncate_ascii, for any text: sizes are UTF-8 bytes and characters stay whole."""
    raw = markdown.encode()
    budget = 4 * tokens
    if len(raw) <= budget:
        return markdown
    body = raw.rpartition(b"\n## Links\n")[0] or raw if b"\n## Links\n" in raw else raw
    gone = len(raw) - len(body)
    if len(body) <= budget:
        return f"{body.decode().rstrip()}\n\n<!-- truncated by {label}: dropped link table, ~{gone // 4} tokens / {gone} bytes omitted -->\n"
    whole = body[: max(0, budget - RESERVE)].decode(errors="ignore").encode()
    window = whole[-WINDOW:]
    found = [window.rfind(mark.encode()) for mark in CUTS]
    cut = next((len(whole) - len(window) + at + 1 for at in found if at >= 0), len(whole))
    omitted = len(raw) - cut
    note = " (link table dropped first)" if gone else ""
    return f"{body[:cut].decode().rstrip()}\n\n<!-- truncated by {label}: ~{omitted // 4} tokens / {omitted} bytes omitted{note} -->\n"


def truncated(markdown: Column, tokens: int) -> Column:
    return by_row(lambda x: truncate(x, tokens), markdown)


def finalize(markdown: Column, link_table: bool = True, max_tokens: int | None = None) -> Column:
    """postprocess, linkified and truncated; the last two in one pass, so that no batch of whole rewritten texts goes back and forth."""
    out = postprocess(markdown)
    if link_table and max_tokens is not None:
        return by_row(lambda x: truncate(linkify(x), max_tokens), out)
    out = linkified(out) if link_table else out
    return truncated(out, max_tokens) if max_tokens is not None else out


_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


def _decode(body: bytes, label: str | None) -> str:
    for mark, name in _MARKS:
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    try:
        return body.decode(codecs.lookup((label or "utf-8").strip()).name, "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def known_charset(label: Column) -> Column:
    """The label if the decoder knows it, else null; decided per distinct label by name shape."""
    ok = F.lower(label).rlike(r"^(utf-?8|utf-?16(le|be)?|us-ascii|ascii|iso-?8859-\d+|latin-?1|windows-125\d|cp125\d|shift[_-]?jis|sjis|euc-(jp|kr)|gbk|gb2312|gb18030|big5|koi8-[ru]|iso-2022-jp)$")
    return F.when(ok, label)


def decoded(captures: DataFrame, body_col: str = "body", type_col: str = "content_type") -> DataFrame:
    """Adds `text`: a byte-order mark decides, then the header's charset, then a meta tag's, then UTF-8; malformed bytes
    become U+FFFD. Plain UTF-8 rows are decoded by Spark; only the others go through Python."""
    head = F.decode(F.substring(F.col(body_col), 1, 4096), "ISO-8859-1")
    label = F.coalesce(known_charset(charset_of_header(F.col(type_col))), known_charset(charset_of_meta(head)), F.lit("utf-8"))
    marked = captures.withColumn("charset", F.lower(label))
    plain = F.col("charset").isin("utf-8", "utf8") & F.is_valid_utf8(F.col(body_col).cast("string")) & ~F.hex(F.substring(F.col(body_col), 1, 3)).rlike("^(EFBBBF|FFFE|FEFF)")

    @F.pandas_udf(T.StringType())
    def udf(body: pd.Series, charset: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else _decode(bytes(b), c) for b, c in zip(body, charset, strict=True)])

    # one pass: rows that Spark decodes give the function a null
    plain, body = F.coalesce(plain, F.lit(False)), F.col(body_col)
    return marked.withColumn("text", F.when(plain, body.cast("string")).otherwise(udf(F.when(~plain, body), F.col("charset"))))
