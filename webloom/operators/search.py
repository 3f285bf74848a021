"""Search and slicing over stored markdown, line by line. Lines count from 1 and cover the body only."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions.predicates import LOWER, UPPER, ascii_lower


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(tab_id, line_number, line): one row per line; a trailing line end adds none, carriage returns go."""
    text = F.regexp_replace(F.regexp_replace(F.col(text_col), "\r\n", "\n"), r"\n\z", "")
    split = docs.where(F.col(text_col) != "").select(F.col(id_col).alias("tab_id"), F.posexplode(F.split(text, "\n")).alias("n", "line"))
    return split.select("tab_id", (F.col("n") + 1).cast("long").alias("line_number"), "line")


def regex_error(query: str) -> str | None:
    """Why Java, which runs the pattern, doesn't take it as one; None if it does."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(query)
    except IllegalArgumentException as e:
        return str(e).splitlines()[0]
    return None


def lowered(text: str) -> str:
    """ASCII letters only, as ascii_lower does."""
    return text.translate({ord(a): b for a, b in zip(UPPER, LOWER, strict=True)})


def literals(query: str, mode: str = "plain") -> list[str] | None:
    """Texts that each hit's line holds, ASCII case aside; None if nothing is known of it. Of a pattern these are the runs of plain
    characters outside groups, classes and choices; a pattern with syntax beyond those is not looked into."""
    if mode == "fuzzy":
        return None
    if mode == "plain" or regex_error(query) is not None:
        return [query]
    found, run, i, n = [], "", 0, len(query)
    flags = re.match(r"\(\?([a-zA-Z]+)\)", query)
    if flags:
        if set(flags[1]) - set("ims"):
            return None
        i = flags.end()
    if re.search(r"\\[QEcxupPNkvHhRXG0-9]|\(\?[a-zA-Z-]+[:)]|&&|\[\^?\]|\[[^\]]*\[", query[i:]):
        return None
    depth = 0
    while i < n:
        c, i = query[i], i + 1
        literal = ""
        if c == "\\":
            c, i = query[i], i + 1
            literal = "" if c.isalnum() else c
        elif c == "[":
            while query[i] != "]":
                i += 1 + (query[i] == "\\")
            i += 1
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|":
            if not depth:
                return None
        elif c not in ".^$*+?{":
            literal = c
        if c == "{" and not literal:
            i = query.index("}", i) + 1
        if literal and not depth:
            if query[i : i + 1] in ("*", "?", "{"):
                literal = ""  # may be absent
            else:
                run += literal
                if query[i : i + 1] != "+":
                    continue
        found, run = [*found, run], ""
    return [x for x in [*found, run] if x] or None


def edits(word: str) -> int:
    """How many edits from a query's word a line's word may be."""
    return 1 if len(word) < 6 else 2


def words(text: Column) -> Column:
    return F.split(ascii_lower(text), r"[^\p{L}\p{N}]+")


def query_words(query: str) -> list[str]:
    """A query's words, split as lines are."""
    return [w for w in re.split(r"[\W_]+", lowered(query)) if w]


def near(word: Column, asked: str) -> Column:
    return (word != "") & (F.abs(F.char_length(word) - len(asked)) <= edits(asked)) & (F.levenshtein(word, F.lit(asked), edits(asked)) >= 0)


def _in_a_row(held: Column, asked: list[str]) -> Column:
    """Whether words near to those asked for follow each other: one pass, in which bit j of the state says that the last words are
    near to the first j + 1 asked for."""
    if len(asked) > 60:
        raise ValueError("a fuzzy query may have 60 words")
    number = lambda x: F.lit(x).cast("long")
    found, last = number(1 << 62), len(asked) - 1

    def step(state: Column, word: Column) -> Column:
        fits = reduce(Column.bitwiseOR, [F.when(near(word, w), number(1 << j)).otherwise(number(0)) for j, w in enumerate(asked)])
        seen = F.when(state.bitwiseAND(number((1 << 62) | (1 << last))) != 0, found).otherwise(number(0))
        return F.when(word == "", state).otherwise(F.shiftleft(state.bitwiseAND(number((1 << last) - 1)), 1).bitwiseOR(number(1)).bitwiseAND(fits).bitwiseOR(seen))

    return F.aggregate(held, number(0), step, lambda state: state.bitwiseAND(number((1 << 62) | (1 << last))) != 0)


def matcher(line: Column, query: str, mode: str = "plain") -> Column:
    """plain: substring, case-sensitive only if the query has an ASCII capital; regex: Java syntax, an invalid one is
    taken literally; fuzzy: words in a row, each within one edit of the query's (two from six letters on); a query without
    a word matches nothing."""
    if mode == "regex":
        return line.rlike(query) if regex_error(query) is None else line.contains(query)
    if mode == "fuzzy":
        asked = query_words(query)
        if len(asked) < 2:
            return F.exists(words(line), lambda w: near(w, asked[0])) if asked else F.lit(False)
        return _in_a_row(words(line), asked)
    if re.search("[A-Z]", query):
        return line.contains(query)
    return ascii_lower(line).contains(query)


def narrowed(docs: DataFrame, text_col: str, query: str, mode: str = "plain") -> DataFrame:
    """The rows whose text can hold a hit, by a pass over whole texts that splits none into lines."""
    held = literals(query, mode) or []
    if mode == "plain" and re.search("[A-Z]", query):
        text = F.col(text_col)
    else:
        # lower() changes ASCII letters as ascii_lower() does, and others too: only ASCII is asked for
        text, held = F.lower(F.col(text_col)), [x for literal in held for x in re.findall("[\x00-\x7f]+", lowered(literal))]
    return docs.where(reduce(Column.__and__, [text.contains(x) for x in held])) if held else docs


def search_texts(docs: DataFrame, id_col: str, text_col: str, query: str, mode: str = "plain", limit: int | None = 50, before: int = 0, after: int = 0) -> DataFrame:
    """search() over the lines of the texts that can hold a hit."""
    return search(lines(narrowed(docs, text_col, query, mode), id_col, text_col), query, mode, limit, before, after)


def search(rows: DataFrame, query: str, mode: str = "plain", limit: int | None = 50, before: int = 0, after: int = 0) -> DataFrame:
    """Matching lines of `lines(...)` in order, with the lines around them; `limit` is the caller's page size.

    In regex mode a column says why the query was taken literally (null: it wasn't).
    """
    hits = rows
    if before or after:
        by_tab = Window.partitionBy("tab_id").orderBy("line_number")
        around = lambda a, b: F.collect_list("line").over(by_tab.rowsBetween(a, b))
        empty = F.array().cast("array<string>")
        # only tabs with a hit are windowed
        tabs = rows.where(matcher(F.col("line"), query, mode)).select("tab_id").distinct()
        hits = rows.join(tabs, "tab_id", "left_semi")
        hits = hits.withColumn("context_before", around(-before, -1) if before else empty).withColumn("context_after", around(1, after) if after else empty)
    hits = hits.where(matcher(F.col("line"), query, mode))
    if mode == "regex":
        hits = hits.withColumn("regex_fallback_error", F.lit(regex_error(query)).cast("string"))
    return hits.orderBy("tab_id", "line_number").limit(limit) if limit is not None else hits


def search_stats(rows: DataFrame, query: str, mode: str = "plain") -> DataFrame:
    hit = matcher(F.col("line"), query, mode)
    per_tab = rows.groupBy("tab_id").agg(F.count_if(hit).alias("hits"))
    return per_tab.agg(F.count(F.lit(1)).alias("total_files"), F.count_if(F.col("hits") > 0).alias("files_with_matches"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))


def read_lines(docs: DataFrame, id_col: str, text_col: str, start: int, end: int) -> DataFrame:
    """(tab_id, total_lines, first, last, content): lines start..end, both clamped to what there is; none if start > end."""
    text = F.regexp_replace(F.regexp_replace(F.col(text_col), "\r\n", "\n"), r"\n\z", "")
    parts = docs.select(F.col(id_col).alias("tab_id"), F.when(F.coalesce(F.col(text_col), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n")).alias("parts"))
    n = F.size("parts")
    first, last = F.greatest(F.lit(1), F.least(F.lit(start), n)), F.greatest(F.lit(1), F.least(F.lit(end), n))
    content = F.when((n > 0) & (first <= last), F.array_join(F.slice("parts", first, last - first + 1), "\n")).otherwise("")
    return parts.select("tab_id", n.alias("total_lines"), first.alias("first"), last.alias("last"), content.alias("content"))


def read_whole(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(tab_id, first, last, content) of whole tabs, empty ones too."""
    return read_lines(docs, id_col, text_col, 1, 2**31 - 1).select("tab_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "content")


def headings(rows: DataFrame) -> DataFrame:
    """Adds `level` (the run of # that a line begins with, after blanks; 0: none) to lines."""
    return rows.withColumn("level", F.char_length(F.regexp_extract("line", r"^\s*(#*)", 1)))


def read_section(docs: DataFrame, id_col: str, text_col: str, needle: str) -> DataFrame:
    """(tab_id, first, last, content): the section under a tab's first heading whose text holds `needle`, to before the
    next heading of no lower rank; all of a tab that has no such heading. Narrow: each tab is cut where it is read.
    """
    text = F.regexp_replace(F.regexp_replace(F.col(text_col), "\r\n", "\n"), r"\n\z", "")
    level = lambda x: F.char_length(F.regexp_extract(x, r"^\s*(#*)", 1))
    named = lambda x: ascii_lower(F.trim(F.regexp_replace(x, r"^\s*#*", ""))).contains(needle.lower())
    out = docs.where(F.col(text_col) != "").select(F.col(id_col).alias("tab_id"), F.split(text, "\n").alias("parts"))
    out = out.withColumn("levels", F.transform("parts", level)).withColumn("n", F.size("parts"))
    hits = F.transform("parts", lambda x, i: F.get("levels", i).between(1, 6) & named(x))
    out = out.withColumn("start", F.array_position(hits, True)).withColumn("rank", F.get("levels", (F.col("start") - 1).cast("int")))
    ends = F.transform("levels", lambda v, i: (i >= F.col("start")) & v.between(1, F.col("rank")))
    out = out.withColumn("next", F.when(F.col("start") > 0, F.array_position(ends, True)).otherwise(0))
    first = F.when(F.col("start") > 0, F.col("start")).otherwise(1)
    last = F.when(F.col("next") > 0, F.col("next") - 1).otherwise(F.col("n"))
    content = F.array_join(F.slice("parts", first.cast("int"), (last - first + 1).cast("int")), "\n")
    return out.select("tab_id", first.cast("long").alias("first"), last.cast("long").alias("last"), content.alias("content"))
