"""Groups of pages that are linkified piece by piece: the same texts as linkify() gives for each as a whole."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from webloom.functions import urls as U
from webloom.operators import links as L
from webloom.plans import fixtures as V

PIECES = ["[a](u)", "[b](v)", "![i](u)", "[", "]", "](u)", "](u \"t", "[c](u 't", "(", ")", "`", "```", "~~~", "\n", "\n\n", "\n```\n", "\n~~~\n", "\n \n", " ", "word", "é", "\\", "[x [n]](w(1) \"t\")", " \"", "!"]


def test_equals_whole_texts(monkeypatch):
    monkeypatch.setattr(L, "CHUNK", 4)
    r = random.Random(1)
    cuts = 0
    for _ in range(20_000):
        parts = ["".join(r.choices(PIECES, k=r.randrange(12))) for _ in range(r.randrange(1, 9))]
        cuts += len(list(L._chunks(parts))) > 1
        assert L.linkify_parts(parts).decode() == L.linkify("\n".join(parts)), parts
    assert cuts > 5_000
    assert L.linkify_parts([]) is None


def test_groups_of_rows(spark):
    rows = [("a", 2, "[y](u)"), ("a", 1, "[x](u)"), ("b", 1, None), (None, 1, "t"), ("c", 3, "é" * 3_000_000 + "\n[x](v)"), ("c", 4, "[y](v)"), ("c", 5, None)]
    got = {r["k"]: r["md"] for r in L.linkified_groups(spark.createDataFrame(rows, "k string, n int, md string"), "k", "n", "md").collect()}
    whole = {"a": "[x](u)\n[y](u)", "c": "é" * 3_000_000 + "\n[x](v)\n[y](v)"}
    assert got == {k: L.linkify(x) for k, x in whole.items()} | {"b": None, None: "t"}


def test_no_row_holds_a_host_before_it_is_done(spark):
    plan = entry.queries()["linkify_udf"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_query_equals_its_pieces(spark):
    d = "/root/testdata/sf0.01"
    pages = V.page_md(spark, d).select(U.host(F.col("url")).alias("host"), "page_id", "md").orderBy("page_id").collect()
    want: dict = {}
    for r in pages:
        want.setdefault(r["host"], []).append(r["md"])
    got = {r["host"]: r["md"] for r in entry.queries()["linkify_udf"](spark, d).collect()}
    assert got == {h: L.linkify("\n".join(x)) for h, x in want.items()}
