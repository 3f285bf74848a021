"""Links of markdown: a grammar for scanning, the relational table of repeated ones, and texts rewritten to refer to it."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.text import by_row

#: What a scan steps over as a whole: fenced code, inline code, images and links. Brackets in a link's text and
#: parentheses in its URL may nest; a backslash takes the next character with it; a title ends the URL.
GRAMMAR = regex.compile(
    r"""
    (?P<fence> (?<![^\n]) (?P<mark>```|~~~) (?s:.*?) (?: \n(?P=mark)[^\n]* | \Z ) )
  | (?P<code> ` [^`\n]* `? )
  | (?P<image> ! )? \[ (?P<text> (?: \\. | [^\[\]\\] | \[(?&text)\] )* ) \]
    \( (?P<url> (?: \\. | [^()\\\n] | \((?&url)\) )*? ) (?: [ \t] (?=["']) [^)]* \) | \) )
    """,
    regex.VERBOSE,
)
BLANK_LINE = regex.compile(r"\n[ \t]*\n")


#: A link whose title may go on behind the end of a text.
OPEN_TITLE = regex.compile(r"\]\([^\n]*[ \t][\"'](?=[^)]*\Z)")


def _scan(markdown: str, at: int = 0) -> tuple[list[tuple[int, int, str, str]], str | None]:
    """(start, end, text, url) of each inline link, and the mark of a fence that is left open."""
    found = []
    while m := GRAMMAR.search(markdown, at):
        at = m.end()
        if m["mark"] and "\n" + m["mark"] not in markdown[m.start() + 3 : at]:
            return found, m["mark"]
        if m["text"] is None:
            continue
        if BLANK_LINE.search(m["text"]) or not m["url"].strip():
            at = m.start() + 1 + bool(m["image"])
        elif not m["image"]:
            found.append((m.start(), m.end(), m["text"], m["url"].strip()))
    return found, None


def linkify(markdown: str) -> str:
    """Links whose URL occurs again become references L1, L2, ... in order of first use, with a table of them at the end."""
    found, _ = _scan(markdown)
    urls = [u for *_, u in found]
    uses = Counter(urls)
    labels = {u: f"L{i}" for i, u in enumerate((u for u in uses if uses[u] > 1), 1)}
    if not labels:
        return markdown
    out, done = [], 0
    for start, end, text, url in found:
        if url in labels:
            out += [markdown[done:start], f"[{text}][{labels[url]}]"]
            done = end
    body = "".join([*out, markdown[done:]])
    return body.rstrip("\n") + "\n" * max(2, len(body) - len(body.rstrip("\n"))) + "## Links\n\n" + "".join(f"[{n}]: {u}\n" for u, n in labels.items())


#: Characters of a group that are scanned at once; bytes of rewritten groups that are sent on at once.
CHUNK, SENT = 1 << 18, 1 << 22


def _chunks(parts: Iterable[str]) -> Iterator[str]:
    """The parts joined by line ends, cut behind blank lines where no link goes on: its text holds no blank line, its URL no line
    end, and a title that may go on puts the cut off."""
    held, size, enough = [], 0, CHUNK
    for i, part in enumerate(parts):
        held.append("\n" + part if i else part)
        size += len(held[-1])
        if size < enough:
            continue
        text = "".join(held)
        cut = text.rfind("\n\n") + 2
        if cut > 1 and not OPEN_TITLE.search(text, text.rfind("\n", 0, text.rfind(")", 0, cut) + 1) + 1, cut):
            yield text[:cut]
            text = text[cut:]
        held, size, enough = [text], len(text), max(CHUNK, 2 * len(text))
    if held:
        yield "".join(held)


def linkify_parts(parts: Iterable[str]) -> bytearray | None:
    """linkify() of the parts joined by line ends, in UTF-8, or None without parts: besides the result only a chunk is in memory as
    it is, the others are compressed."""
    kept, uses, ids, mark = [], Counter(), {}, None
    for chunk in _chunks(parts):
        at = 0
        if mark:
            end = regex.search(rf"(?:\A|\n){mark}[^\n]*", chunk)
            at, mark = (end.end(), None) if end else (len(chunk), mark)
        found, mark = ([], mark) if mark else _scan(chunk, at)
        spots = array("i")
        for start, end, text, url in found:
            spots.extend((start + len(text) + 2, end, ids.setdefault(url, len(ids))))
            uses[url] += 1
        raw = chunk.encode()
        kept.append((pa.compress(raw, "zstd", asbytes=True), len(raw), spots))
    if not kept:
        return None
    names = [u for u in ids if uses[u] > 1]
    labels = {ids[u]: f"[L{i}]" for i, u in enumerate(names, 1)}
    out = bytearray()
    kept.reverse()
    while kept:
        packed, size, spots = kept.pop()
        chunk, pieces, done = pa.decompress(packed, size, "zstd", asbytes=True).decode(), [], 0
        for k in range(0, len(spots), 3):
            if label := labels.get(spots[k + 2]):
                pieces += [chunk[done : spots[k]], label]
                done = spots[k + 1]
        out += "".join([*pieces, chunk[done:]]).encode()
    if labels:
        out += b"\n" * (2 - min(2, len(out[-2:]) - len(out[-2:].rstrip(b"\n")))) + b"## Links\n\n"
        for u in names:
            out += f"{labels[ids[u]]}: {u}\n".encode()
    return out


def linkified_groups(docs: DataFrame, key: str, order: str, md_col: str) -> DataFrame:
    """(key, md): the markdown of each group, joined by line ends in the order of a column and linkified as one text. Groups go
    through Python one after another, row by row, so that a group is in memory once, as the row that it becomes."""

    def groups(batches):
        rows = ((k.as_py(), x.as_py()) for batch in batches for k, x in zip(*batch.columns, strict=True))
        row = next(rows, None)

        def texts(name):
            nonlocal row
            while row is not None and row[0] == name:
                if row[1] is not None:
                    yield row[1]
                row = next(rows, None)

        while row is not None:
            name = row[0]
            yield name, linkify_parts(texts(name))

    def batch_of(held):
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in held], pa.string()), _strings([b for _, b in held])], [key, "md"])

    def run(batches):
        held, size = [], 0
        for name, body in groups(batches):
            if held and size + len(body or b"") > SENT:
                yield batch_of(held)
                held, size = [], 0
            held.append((name, body))
            size += len(body or b"")
            del body
            if size > SENT:
                made, held, size = batch_of(held), [], 0
                yield made
                del made
                yield batch_of([])  # in place of the large one, which both sides would hold until the next
        if held:
            yield batch_of(held)

    rows = docs.select(key, order, md_col).repartition(key).sortWithinPartitions(key, order, md_col)
    return rows.select(key, md_col).mapInArrow(run, f"`{key}` string, md string")


def _strings(bodies: list[bytearray | None]) -> pa.Array:
    """UTF-8 texts as an array; a single one isn't copied."""
    if len(bodies) == 1 and bodies[0] is not None:
        return pa.Array.from_buffers(pa.string(), 1, [None, pa.array([0, len(bodies[0])], pa.int32()).buffers()[1], pa.py_buffer(bodies[0])])
    return pa.array([None if b is None else bytes(b) for b in bodies], pa.binary()).cast(pa.string())


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("url", T.StringType())])))
def _links_udf(markdown: pd.Series) -> pd.Series:
    return markdown.map(lambda x: [{"pos": i, "text": t, "url": u} for i, (_, _, t, u) in enumerate(_scan(x or "")[0])])


def linkified(markdown: Column) -> Column:
    return by_row(linkify, markdown)


def link_rows(docs: DataFrame, id_col: str, md_col: str) -> DataFrame:
    """(id, pos, text, url) of every link, by the full grammar."""
    return docs.select(F.col(id_col).alias("id"), F.inline(_links_udf(F.col(md_col))))


def simple_links(docs: DataFrame, id_col: str, md_col: str) -> DataFrame:
    """(id, pos, text, url) of plain inline links [text](url), without Python: no nesting, escapes or code."""
    whole = F.regexp_extract_all(F.col(md_col), F.lit(r"(\[[^\[\]\n]*\]\([^()\s]+\))"), F.lit(1))
    split = docs.select(F.col(id_col).alias("id"), F.posexplode(whole).alias("pos", "link"))
    return split.select("id", "pos", F.regexp_extract("link", r"^\[([^\]]*)\]", 1).alias("text"), F.regexp_extract("link", r"\(([^)]*)\)$", 1).alias("url"))


def link_table(links: DataFrame) -> DataFrame:
    """(id, label, url, uses): the URLs that a document links to more than once, labelled in order of first use."""
    repeated = links.groupBy("id", "url").agg(F.count(F.lit(1)).alias("uses"), F.min("pos").alias("pos")).where("uses > 1")
    n = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    return repeated.select("id", F.concat(F.lit("L"), n).alias("label"), "url", "uses")
