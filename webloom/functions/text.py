"""Text and markdown functions as Columns."""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.predicates import SPACE

#: How the engine signs the notes that it leaves in a text.
LABEL = "webloom"

# Ligatures of PDF text and the letters that they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def postprocess(markdown: Column) -> Column:
    """Lines without trailing white space, blank runs as one blank line, a line end at the end; empty stays empty."""
    inner = SPACE.replace(r"\t-\r", r"\t\x0B\f\r")
    lines = F.regexp_replace(F.regexp_replace(markdown, r"\r\n", "\n"), f"[{inner}]+(\n|\\z)", "$1")
    lines = F.regexp_replace(F.regexp_replace(lines, "\n{3,}", "\n\n"), "^\n+", "\n")
    return F.when(markdown == "", "").otherwise(F.concat(F.regexp_replace(lines, r"\n\z", ""), F.lit("\n")))


def pdf_text(raw: Column) -> Column:
    out = F.regexp_replace(raw, "\f", "\n\n---\n\n")
    for a, b in LIGATURES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"(?<=\p{L})-\n(?=[a-z])", "")


def pdf_title(text: Column) -> Column:
    """The first line of the first page that isn't blank; null without one."""
    head = F.substring_index(text, "\n---\n", 1)
    return F.get(F.filter(F.transform(F.split(head, "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))


def block_banner(host: Column, markdown: Column, label: str = LABEL) -> Column:
    """The text of a rejection page below a note that says so."""
    head = f"> [!warning] **{label}: site rejected our automated request**\n>\n> The body below is the rejection page of "
    return F.concat(F.lit(head), host, F.lit(", not real content.\n\n---\n\n"), markdown)


def strip_banner(markdown: Column, label: str = LABEL) -> Column:
    return F.regexp_replace(markdown, rf"(?s)^> \[!warning\] \*\*{label}:.*?\n---\n\n?", "")


def human_bytes(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((10, "KB"), (20, "MB"), (30, "GB")):
        out = F.when(n >= 2**power, F.format_string(f"%.1f {unit}", n / F.lit(float(2**power)))).otherwise(out)
    return out


def age_short(ms: Column) -> Column:
    """12s, 5m, 3h, 2d; negative ages count as none."""
    s = F.floor(F.greatest(ms, F.lit(0)) / 1000).cast("long")
    part = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(s < 60, part(1, "s")).when(s < 3600, part(60, "m")).when(s < 86400, part(3600, "h")).otherwise(part(86400, "d"))


def relative_time(at_ms: Column, now_ms: Column) -> Column:
    """'5s ago (1700000000)' or 'in 5s (1700000000)'."""
    d, secs = F.expr("0"), F.floor(at_ms / 1000).cast("string")
    d = F.floor(F.abs(now_ms - at_ms) / 1000).cast("string")
    return F.when(at_ms <= now_ms, F.concat(d, F.lit("s ago ("), secs, F.lit(")"))).otherwise(F.concat(F.lit("in "), d, F.lit("s ("), secs, F.lit(")")))


def ellipsis(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def shell_quote(text: Column) -> Column:
    return F.when(text.rlike(r"^[A-Za-z0-9_./:=@%+,-]+$"), text).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'")))


def token_estimate(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("long")


def line_range(spec: Column) -> Column:
    """struct(start, end) of 'L:R', or null."""
    shape = r"^\s*(\d+)\s*:\s*(\d+)\s*$"
    return F.when(spec.rlike(shape), F.struct(F.regexp_extract(spec, shape, 1).cast("int").alias("start"), F.regexp_extract(spec, shape, 2).cast("int").alias("end")))


def body_cap(text: Column, limit: int = 200_000) -> Column:
    """Texts over `limit` characters cut there, with a note of the bytes left out; never inside a character."""
    kept = F.substring(text, 1, limit)
    note = F.concat(F.lit("…[truncated; "), (F.octet_length(text) - F.octet_length(kept)).cast("string"), F.lit(" more bytes]"))
    return F.when(F.octet_length(text) > limit, F.concat(kept, note)).otherwise(text)


def base64_text(content: Column) -> Column:
    return F.decode(F.unbase64(F.regexp_replace(content, "\n", "")), "UTF-8")


def strip_comment(markup: str) -> str:
    """Comment HTML as text: paragraphs and breaks as line ends, other tags dropped, character references decoded."""
    for tag, text in (("<p>", "\n\n"), ("</p>", ""), ("<br>", "\n"), ("<br/>", "\n")):
        markup = markup.replace(tag, text)
    return re.sub(r"&#?\w+;", lambda m: html.unescape(m[0]), re.sub(r"<[^>]*>", "", markup))


#: So many texts of a batch are Python strings at once.
AT_ONCE = 128


def by_row(fn: Callable[[str], str], text: Column) -> Column:
    """fn of each text, in Python: besides the Arrow batches that come and go, a few texts at a time are in memory."""

    @F.arrow_udf("string")
    def udf(batch: pa.Array) -> pa.Array:
        parts = (batch.slice(at, AT_ONCE) for at in range(0, len(batch), AT_ONCE))
        made = [pa.array([fn(x.as_py()) if x.is_valid else None for x in part], pa.string()) for part in parts]
        return pa.concat_arrays(made) if made else pa.array([], pa.string())

    return udf(text)


def comment_text(markup: Column) -> Column:
    """strip_comment over a column, in Arrow batches."""
    return by_row(strip_comment, markup)


def visible_text(page: Column) -> Column:
    """The text of a page without scripts, styles, comments and tags, blanks collapsed; no Python needed."""
    out = F.regexp_replace(page, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]*>", " "), r"\s+", " "))


def last_at(text: Column, mark: str) -> Column:
    """Position (from 1) of the last `mark` in `text`; 0 if there is none."""
    back = F.instr(F.reverse(text), mark[::-1])
    return F.when(back > 0, F.char_length(text) - back - len(mark) + 2).otherwise(0)


WINDOW, RESERVE = 16_384, 128
# Where a text is best cut, by preference.
CUTS = ["\n# ", "\n## ", "\n### ", "\n\n", "\n"]


def truncated_ascii(docs, md_col: str, tokens: int, label: str = LABEL):
    """`docs` with their ASCII markdown cut to about `tokens` tokens of four bytes: the link table goes first, then all
    behind the best cut. Each step is a column of its own, so that the plan computes it once.
    """
    budget, md = 4 * tokens, F.col(md_col)
    target = max(0, budget - RESERVE)
    start = max(0, target - WINDOW)
    table = last_at(md, "\n## Links\n")
    out = docs.withColumn("_table", F.when(F.octet_length(md) > budget, table).otherwise(0))
    out = out.withColumn("_body", F.when(F.col("_table") > 0, F.substring(md, F.lit(1), F.col("_table") - 1)).otherwise(md))
    out = out.withColumn("_window", F.substring(F.substring("_body", 1, target), start + 1, WINDOW)).withColumn("_cut", F.lit(None).cast("int"))
    for mark in CUTS:
        at = last_at(F.col("_window"), mark)
        out = out.withColumn("_cut", F.coalesce("_cut", F.when(at > 0, start + at)))
    out = out.withColumn("_cut", F.coalesce("_cut", F.lit(target)))
    size, gone = F.octet_length(md), F.octet_length(md) - F.octet_length("_body")
    whole = F.concat(F.regexp_replace("_body", r"\s+$", ""), F.format_string(f"\n\n<!-- truncated by {label}: dropped link table, ~%d tokens / %d bytes omitted -->\n", F.floor(gone / 4).cast("long"), gone.cast("long")))
    omitted = size - F.col("_cut")
    note = F.when(gone > 0, " (link table dropped first)").otherwise("")
    tail = F.format_string(f"\n\n<!-- truncated by {label}: ~%d tokens / %d bytes omitted%s -->\n", F.floor(omitted / 4).cast("long"), omitted.cast("long"), note)
    part = F.concat(F.regexp_replace(F.substring(F.col("_body"), F.lit(1), F.col("_cut")), r"\s+$", ""), tail)
    done = F.when(size <= budget, md).when(F.octet_length("_body") <= budget, whole).otherwise(part)
    return out.withColumn(md_col, done).drop("_table", "_body", "_window", "_cut")
