import json
import random

import pytest
from pyspark.sql import functions as F

from webloom.operators import adapter_chain as K
from webloom.operators import adapters as A
from webloom.operators import threads as H


def test_a_declined_url_reaches_the_next_adapter(spark):
    mirror = K.Adapter("mirror", lambda u: u.startswith("https://github.com/"), lambda u: F.concat(F.lit("https://mirror/"), K._at(u, 1)), lambda u, b, r: F.concat(F.lit("mirrored "), b), lambda u, b: F.lit("M"), lambda u: F.lit(True))
    urls = spark.createDataFrame([(f"https://github.com/o/r{i}", "x") for i in range(6)] + [("https://github.com/o/r0", "twice"), ("https://e.com/", "x"), (None, "x")], "url string, title string")
    readme = json.dumps({"content": "aGVsbG8=", "encoding": "base64"})
    captures = [(f"https://api.github.com/repos/o/r{i}/readme", s, b) for i, (s, b) in enumerate([(200, readme), (500, readme), (200, "{broken"), (200, json.dumps({"encoding": "none", "content": "x"})), (200, None)])]
    captures += [("https://mirror/r1", 200, "one"), ("https://mirror/r2", 200, "two"), ("https://mirror/r3", 404, "three"), ("https://mirror/r0", 200, "zero"), ("https://mirror/r0", 200, "zero")]
    captures = spark.createDataFrame(captures, "url string, status int, body string")
    got = {(r.url[-2:], r.adapter): r.outcome for r in K.attempts(urls, captures, adapters=(*K.ADAPTERS, mirror)).collect()}
    assert got == {
        ("r0", "github"): "ok", ("r1", "github"): "failed", ("r2", "github"): "declined", ("r3", "github"): "declined", ("r4", "github"): "failed", ("r5", "github"): "missing",
        ("r0", "mirror"): "ok", ("r1", "mirror"): "ok", ("r2", "mirror"): "ok", ("r3", "mirror"): "failed", ("r4", "mirror"): "missing", ("r5", "mirror"): "missing",
    }
    tier = {r.url[-2:]: (r.tier, r.source, r.markdown, r.title) for r in K.adapter_tier(urls, captures, adapters=(*K.ADAPTERS, mirror)).collect()}
    assert tier == {"r0": (4, "adapter", "hello", "o/r0 README"), "r1": (4, "adapter", "mirrored one", "M"), "r2": (4, "adapter", "mirrored two", "M")}


def test_titles_and_readmes(spark):
    thread = json.dumps([{"data": {"children": [{"data": {"title": "Post"}}]}}, {"data": {"children": []}}])
    listing = json.dumps({"data": {"children": [{"data": {"title": "One", "permalink": "/r/x/1"}}]}})
    pages = [
        ("https://github.com/o/r/blob/main/a/b.md", "raw text", "o/r: a/b.md"),
        ("https://github.com/o/r/issues/7", json.dumps({"number": 7, "title": "Bug", "state": "open"}), "Bug"),
        ("https://www.reddit.com/r/x/comments/1/t", thread, "Post"),
        ("https://old.reddit.com/r/x", listing, "r/x"),
        ("https://npmjs.com/package/@s/n", json.dumps({"version": "2"}), "@s/n"),
        ("https://pypi.org/project/p", json.dumps({"info": {"version": "1"}}), "p"),
        ("https://en.wikipedia.org/wiki/A_b", "<p>text</p>", "A b"),
        ("https://news.ycombinator.com/item?id=3", json.dumps({"id": 3, "title": "HN"}), "HN"),
    ]
    urls = spark.createDataFrame([(u,) for u, _, _ in pages], "url string")
    captures = spark.createDataFrame([(u, b) for u, b, _ in pages], "u string, body string").select(A.api_url(F.col("u")).alias("url"), F.lit(200).alias("status"), "body")
    readmes = spark.createDataFrame([("@s/n", "from unpkg"), ("p", "not of npm")], "package string, readme string")
    got = {r.url: r for r in K.adapter_tier(urls, captures, readmes).collect()}
    assert {u: got[u].title for u, _, _ in pages} == {u: t for u, _, t in pages}
    assert "from unpkg" in got["https://npmjs.com/package/@s/n"].markdown and "not of npm" not in got["https://pypi.org/project/p"].markdown


def test_empty(spark):
    none = spark.createDataFrame([], "url string, status int, body string")
    assert K.adapter_tier(none, none).collect() == []


def tree(rng, depth, hn):
    text = rng.choice(["", "one line", "two\nlines", "<p>a<p>b &amp; c", "end\n", "\r\nx", "a b"])
    replies = [tree(rng, depth - 1, hn) for _ in range(rng.randint(0, 3))] if depth else []
    if hn:
        return {"author": rng.choice([None, "", "joe"]), "text": rng.choice([None, text]), "children": replies}
    data = {"author": rng.choice([None, "ann"]), "body": text, "score": rng.choice([None, 5]), "replies": rng.choice(["", {"data": {"children": replies}}])}
    return {"kind": rng.choice(["t1", "t1", "more"]), "data": data}


@pytest.mark.parametrize("site", ["hackernews", "reddit"])
def test_markdown_of_rows_equals_the_renderers(spark, site):
    rng = random.Random(site)
    rows = []
    for i in range(60):
        nodes = [tree(rng, 3, site == "hackernews") for _ in range(rng.randint(0, 4))]
        body = {"id": i, "title": "T", "children": nodes} if site == "hackernews" else [{"data": {"children": [{"data": {"title": "T"}}]}}, {"data": {"children": nodes}}]
        rows.append((i, json.dumps(body)))
    rows += [(100, "{"), (101, None), (102, "[]"), (103, "3")]
    threads = spark.createDataFrame(rows, "doc long, body string")
    render = A.hn_thread if site == "hackernews" else A.reddit_thread
    whole = {r.doc: r.md for r in threads.select("doc", render(F.col("body")).alias("md")).collect()}
    want = {d: md.split("## Comments\n\n", 1)[1] for d, md in whole.items() if md and md.split("## Comments\n\n", 1)[1]}
    found = H.comments(threads, "doc", "body", site)
    assert {r.id: r.md for r in H.thread_markdown(found, site).collect()} == want
    order = {}
    for r in found.orderBy("id", "path").collect():
        assert r.depth == len(r.path) - 1
        if r.depth:
            assert r.path[:-1] in order[r.id]
        order.setdefault(r.id, []).append(r.path)


def test_a_deep_thread(spark):
    node = {"author": "a", "text": "leaf"}
    for _ in range(300):
        node = {"author": "a", "text": "x", "children": [node]}
    threads = spark.createDataFrame([(1, json.dumps({"id": 1, "children": [node]}))], "id long, body string")
    assert H.comments(threads, "id", "body", "hackernews").agg(F.max("depth")).first()[0] == 300
