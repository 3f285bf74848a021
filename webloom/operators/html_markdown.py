"""HTML to markdown in Arrow batches: whole pages, or their main content, with a second pass only for rows that need it."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.predicates import looks_like_stub, trimmed_bytes
from webloom.functions.urls import title as title_of

SKIPPED = {"script", "style", "noscript", "iframe", "svg", "template", "head"}
BOILERPLATE = {"nav", "footer", "aside", "header", "form"}
BLOCKS = {"p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dl", "dt", "dd", "figure", "body", "html", *BOILERPLATE}
#: What a start tag ends if it is open, up to the element that holds both.
CELLS, ROWS = {"td", "th"}, {"tr", "td", "th"}
ENDS = {"li": ({"li"}, {"ul", "ol"}), "td": (CELLS, {"table"}), "th": (CELLS, {"table"}), "tr": (ROWS, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
EMPTY = {"br", "hr", "img", "input", "meta", "link", "wbr", "source"}


class _Element:
    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.inside = tag, attrs, parent, []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.inside if isinstance(c, str) or c.tag not in SKIPPED)


class _Builder(HTMLParser):
    """A forgiving tree: a block closes an open paragraph, an end tag closes what it finds open, strays are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Element("html", {}, None)
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS or tag in CELLS:
            self._close({"p"}, stop={"ul", "ol", "table", "blockquote", *CELLS})
        if tag in ENDS:
            self._close(*ENDS[tag])
            while tag in ENDS and self.at.tag in ENDS[tag][0]:  # a row that was open behind its cell
                self._close(*ENDS[tag])
        if self.depth > 400 and tag not in EMPTY:
            return
        child = _Element(tag, dict(attrs), self.at)
        self.at.inside.append(child)
        if tag not in EMPTY:
            self.at, self.depth = child, self.depth + 1

    def handle_endtag(self, tag):
        self._close({tag}, stop={"table"} - {tag} if tag in ENDS else set() if tag in BLOCKS or tag in SKIPPED else BLOCKS | CELLS)

    def _close(self, tags, stop):
        e, n = self.at, 0
        while e.parent is not None and e.tag not in tags:
            if e.tag in stop:
                return
            e, n = e.parent, n + 1
        if e.parent is not None:
            self.at, self.depth = e.parent, self.depth - n - 1

    def handle_data(self, data):
        self.at.inside.append(data)


def _inline(e) -> str:
    out = []
    for c in e.inside:
        if isinstance(c, str):
            out.append(re.sub(r"\s+", " ", c))
        elif c.tag == "br":
            out.append("\n")
        elif c.tag == "img":
            if c.attrs.get("src"):
                out.append(f"![{c.attrs.get('alt') or ''}]({c.attrs['src']})")
        elif c.tag not in SKIPPED:
            t = _inline(c)
            if c.tag == "a" and c.attrs.get("href") and t.strip():
                t = f"[{t.strip()}]({c.attrs['href']})"
            elif c.tag in ("b", "strong") and t.strip():
                t = f"**{t.strip()}**"
            elif c.tag in ("i", "em") and t.strip():
                t = f"*{t.strip()}*"
            elif c.tag == "code" and t.strip():
                t = f"`{t.strip()}`"
            out.append(t)
    return "".join(out)


def _blocks(e, dropped, out, prefix=""):
    run = _Element("span", {}, None)

    def flush():
        text = re.sub(r" *\n *", "\n", _inline(run)).strip()
        run.inside.clear()
        if text:
            out.append(prefix + text)

    for c in e.inside:
        if isinstance(c, str) or c.tag not in BLOCKS and not any(not isinstance(x, str) and x.tag in BLOCKS for x in c.inside):
            run.inside.append(c)
            continue
        flush()
        if c.tag in dropped or c.tag in SKIPPED or dropped and re.search(r"\bads?\b", c.attrs.get("class") or ""):
            continue
        if re.fullmatch("h[1-6]", c.tag):
            text = _inline(c).strip()
            if text:
                out.append("#" * int(c.tag[1]) + " " + text)
        elif c.tag in ("ul", "ol"):
            items: list[str] = []
            for li in (x for x in c.inside if not isinstance(x, str)):
                parts: list[str] = []
                _blocks(li, dropped, parts)
                if parts:
                    mark = f"{len(items) + 1}. " if c.tag == "ol" else "* "
                    items.append(mark + "\n".join(parts).replace("\n", "\n  "))
            if items:
                out.append("\n".join(items))
        elif c.tag == "table" and (rows := _cells(c)):
            out.append(_table(rows))
        elif c.tag == "pre":
            out.append("```\n" + c.text().strip("\n") + "\n```")
        elif c.tag == "blockquote":
            parts = []
            _blocks(c, dropped, parts)
            out.append("\n".join("> " + line for p in parts for line in p.split("\n")))
        else:
            _blocks(c, dropped, out, prefix)
    flush()


def _all(e):
    yield e
    for c in e.inside:
        if not isinstance(c, str):
            yield from _all(c)


def _cells(table) -> list[list[str]] | None:
    """The texts of a table's cells by rows; None if it lays out blocks instead of listing data."""
    rows, found = [e for e in _all(table) if e.tag == "tr"], []
    for row in rows:
        cells = [c for c in row.inside if not isinstance(c, str) and c.tag in CELLS]
        if any(e.tag in BLOCKS - {"p", "div"} for c in cells for e in _all(c)):
            return None
        texts = []
        for c in cells:
            wide = str(c.attrs.get("colspan") or 1)
            texts += [re.sub(r"\s+", " ", _inline(c)).strip().replace("|", r"\|"), *[""] * ((int(wide) if wide.isascii() and wide.isdigit() and len(wide) < 3 else 1) - 1)]
        if texts:
            found.append(texts)
    return found if found and max(map(len, found)) > 1 else None


def _table(rows: list[list[str]]) -> str:
    """The first row heads the table; short rows are filled up."""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


#: Elements whose text counts, if it has so many characters, and the share of its points that each ancestor gets.
PARAGRAPHS, LEAST_CHARS, SHARES = {"p", "pre", "td", "blockquote"}, 25, (1, 1 / 2, 1 / 6)


def measured(root) -> dict:
    """(characters, characters in links) of the text below each element, blanks collapsed, without navigation and the like."""
    order, of = list(_all(root)), {}
    for e in reversed(order):
        if e.tag in SKIPPED or e.tag in BOILERPLATE:
            of[e] = (0, 0)
            continue
        n = sum(len(" ".join(c.split())) for c in e.inside if isinstance(c, str))
        chars = n + sum(of[c][0] for c in e.inside if not isinstance(c, str))
        of[e] = (chars, chars if e.tag == "a" else sum(of[c][1] for c in e.inside if not isinstance(c, str)))
    return of


def scores(root, size: dict) -> dict:
    """What each element that holds paragraphs is worth: a paragraph gives a point, one for each comma and one for each hundred
    characters up to three to its parent, half of that to the next ancestor and a sixth to the one above; all is cut by
    the share of an element's text that is in links."""
    found: dict = {}
    for e in _all(root):
        if e.tag in PARAGRAPHS and size[e][0] >= LEAST_CHARS:
            points, up = 1 + e.text().count(",") + min(size[e][0] // 100, 3), e.parent
            for share in SHARES:
                if up is None:
                    break
                found[up] = found.get(up, 0) + points * share
                up = up.parent
    return {e: x * (1 - size[e][1] / size[e][0]) for e, x in found.items() if size[e][0]}


def _main(root):
    """The elements of a page's main content, in order: the element of highest score, or the article or main element around it, with
    the parts beside it that belong to it: headings before it, and what scores a fifth of it or is a paragraph of its own."""
    size = measured(root)
    worth = scores(root, size)
    best = max(worth, key=worth.get, default=None)
    if best is None:
        return [next((e for e in _all(root) if e.tag in ("article", "main")), root)]
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None or best.parent is None or best.tag == "body":
        return [up or best]

    def belongs(e, before: bool) -> bool:
        chars, linked = size[e]
        if worth.get(e, 0) >= max(10, worth[best] / 5) or before and re.fullmatch("h[1-6]", e.tag) and chars:
            return True
        sparse = linked < chars / 4 if chars > 80 else not linked and "." in e.text()
        return e.tag == "p" and chars > 0 and sparse

    beside = [e for e in best.parent.inside if not isinstance(e, str)]
    at = beside.index(best)
    return [e for i, e in enumerate(beside) if e is best or belongs(e, i < at)]


def to_markdown(html: str | None, raw: bool = False) -> str:
    """Markdown of a page: all of it if `raw`, else its main content without navigation, footers, forms and adverts."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    out: list[str] = []
    if raw:
        _blocks(builder.root, set(), out)
    else:
        chosen = _Element("div", {}, None)  # so that a chosen paragraph or heading is a block itself
        chosen.inside = _main(builder.root)
        _blocks(chosen, BOILERPLATE, out)
    return "\n\n".join(out) + "\n" * bool(out)


@F.pandas_udf(T.StringType())
def _main_udf(html: pd.Series) -> pd.Series:
    return html.map(lambda x: to_markdown(x))


@F.pandas_udf(T.StringType())
def _raw_udf(html: pd.Series) -> pd.Series:
    return html.map(lambda x: to_markdown(x, raw=True))


def html_to_markdown(html: Column, raw: bool = False) -> Column:
    return _raw_udf(html) if raw else _main_udf(html)


@F.pandas_udf(T.StructType([T.StructField("markdown", T.StringType()), T.StructField("whole", T.StringType())]))
def _both_udf(html: pd.Series) -> pd.DataFrame:
    main = html.map(to_markdown)
    # whatever could be a stub (under 200 bytes or 40 words) is converted again; which of these is one is decided outside
    short = main.map(lambda x: len(x.encode()) < 1000 or len(x.split()) < 80)
    return pd.DataFrame({"markdown": main, "whole": [to_markdown(h, raw=True) if again else None for h, again in zip(html, short, strict=True)]})


def with_raw_fallback(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds title and markdown: the main content, or the whole page where the former is a stub and the latter strictly longer.

    One Arrow function reads each page once and converts only short results a second time.
    """
    both = "both"
    while both in pages.columns:
        both += "_"
    rows = pages.withColumn("title", title_of(F.col(html_col))).withColumn(both, _both_udf(F.col(html_col)))
    main, whole = F.col(both)["markdown"], F.col(both)["whole"]
    longer = looks_like_stub(main) & (trimmed_bytes(whole) > trimmed_bytes(main))
    return rows.withColumn("markdown", F.when(F.coalesce(longer, F.lit(False)), whole).otherwise(main)).drop(both)
