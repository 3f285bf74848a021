"""Comment threads as rows: one row a comment, with its place in the tree, from which the markdown is aggregated."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.text import strip_comment
from webloom.operators.adapters import _replies

COMMENTS = "path array<int>, depth int, author string, text string, score long"


def _tree(nodes, read) -> Iterator[tuple]:
    """(path, node), parents before their replies; a path holds the place of each ancestor among those kept beside it."""
    stack = [([], iter(nodes or []), [0])]
    while stack:
        path, left, count = stack[-1]
        node = next(left, None)
        if node is None:
            stack.pop()
            continue
        kept, replies = read(node)
        if kept is not None:
            own = [*path, count[0]]
            count[0] += 1
            yield own, kept
            stack.append((own, iter(replies or []), [0]))


def _text(value) -> str:
    return value if isinstance(value, str) else ""


@F.udtf(returnType=COMMENTS)
class HnComments:
    """The comments of a Hacker News item as its API gives it; none for what isn't one."""

    def eval(self, body: str):
        try:
            item = json.loads(body or "")
        except ValueError:
            return
        if not isinstance(item, dict) or "id" not in item:
            return
        for path, c in _tree(item.get("children"), lambda n: (n, n.get("children")) if isinstance(n, dict) else (None, None)):
            yield path, len(path) - 1, c.get("author"), strip_comment(_text(c.get("text"))), c.get("points")


@F.udtf(returnType=COMMENTS)
class RedditComments:
    """The comments of a Reddit thread as its API gives it; none for what isn't one."""

    def eval(self, body: str):
        try:
            both = json.loads(body or "")
            both[0]["data"]["children"][0]["data"]["title"]
            comments = both[1]["data"]["children"]
        except (ValueError, LookupError, TypeError):
            return
        for path, c in _tree(comments, _replies):
            yield path, len(path) - 1, c.get("author"), _text(c.get("body")), c.get("score")


def comments(threads: DataFrame, id_col: str, body_col: str, site: str) -> DataFrame:
    """(id, path, depth, author, text, score) of every comment of threads of a site ('hackernews' or 'reddit'). A path orders a thread's
    comments, parents before their replies; null and broken bodies have none."""
    if site not in ("hackernews", "reddit"):
        raise ValueError(f"no such site: {site}")
    of = {"hackernews": HnComments, "reddit": RedditComments}[site]
    rows = threads.select(F.col(id_col).alias("id"), F.col(body_col).alias("body"))
    return rows.lateralJoin(of(F.col("body").outer())).select("id", "path", "depth", "author", "text", "score")


def _quoted(head: Column, blank_after: bool) -> Column:
    """A comment's lines below each other, each quoted to its depth behind its author."""
    quote = F.repeat(F.lit("> "), F.col("depth"))
    # a last line end begins no line
    text = F.regexp_replace(F.regexp_replace("text", r"\r\n|[\r\x0B\f\x1C-\x1E\x85  ]", "\n"), r"\n\z", "")
    lines = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n"))
    said = F.array_join(F.transform(lines, lambda x: F.concat(quote, head, x, F.lit("\n"))), "")
    return F.concat(said, quote, F.lit("\n")) if blank_after else said


def thread_markdown(rows: DataFrame, site: str) -> DataFrame:
    """(id, md): the comments of each thread as adapters.hn_thread and reddit_thread write them below their heading."""
    who = F.coalesce(F.when(F.col("author") != "", F.col("author")), F.lit("?"))
    if site == "hackernews":
        own = rows.where("text <> ''").withColumn("said", _quoted(F.concat(F.lit("**"), who, F.lit("**: ")), True))
    else:
        score = F.coalesce("score", F.lit(0)).cast("string")
        own = rows.withColumn("said", F.concat(_quoted(F.concat(F.lit("**u/"), who, F.lit("** ("), score, F.lit("↑): ")), False), F.repeat(F.lit("> "), F.col("depth")), F.lit("\n")))
    put = F.array_sort(F.collect_list(F.struct("path", "said")))
    return own.groupBy("id").agg(put.alias("x")).select("id", F.array_join(F.transform("x", lambda c: c["said"]), "").alias("md"))
