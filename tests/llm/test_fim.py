import hashlib

import pytest
from pyspark.sql import functions as F

from webloom.llm import fim


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def held(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, output string, form string, units int")
    made = fim.fill_in_middle(docs)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", fim.rebuilt(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r)[:-1] for r in got), key=key) == sorted((brute(r[0], r[1]) for r in rows), key=key)
    assert sorted(r.back for r in got) == sorted(r[1] or "" for r in rows)
    return {r.form for r in got}


def test_equals_brute_force_and_goes_back(spark):
    texts = ["one two three", "née 😀 x́ \U0001f469‍\U0001f4bb end", "a\r\nb\n\nc d\u0085", "<<<P<S<M >P> S> M>", "x", "<", "M>tail<", "a\x00b", " \t "]
    rows = [(i, texts[i % len(texts)] * (1 + i % 4), "n", "o", "f", 1) for i in range(300)]
    assert held(spark, rows) == {"plain", "psm", "spm"}


def test_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text, "n", None, "f", 1) for r in odd.collect()]
    rows += [(10, "holds <P> here", "", "", "", 0), (11, "holds <S>", "", "", "", 0), (12, "<M>", "", "", "", 0), (13, "é" * 300_000, "", "", "", 0)]
    held(spark, rows)


def test_empty(none):
    assert fim.fill_in_middle(none).collect() == []


def test_own_units_and_sentinels(spark):
    docs = spark.createDataFrame([(i, f"word{i} and more  words\nof it") for i in range(60)], "id string, body string")
    made = fim.fill_in_middle(docs, "id", "body", 100, 50, ("[pre]", "[suf]", "[mid]"), r"\S+\s*|\s+")
    got = made.withColumn("back", fim.rebuilt(F.col("output"), F.col("form"), ("[pre]", "[suf]", "[mid]"))).join(docs, "id").collect()
    assert {r.form for r in got} == {"psm", "spm"} and all(r.back == r.body and r.n == 6 for r in got)
    # cuts lie between words
    assert all((r.body[: r.prefix_chars] + " ")[-1].isspace() or r.prefix_chars in (0, len(r.body)) or r.body[r.prefix_chars - 1].isspace() for r in got)


@pytest.mark.parametrize("bad", [("<P>", "<P>", "<M>"), ("<P>", "|S|", "<M>"), ("<P<", "<S>", "<M>"), ("<P", "<PX", "<M>"), ("<", "<S", "<M")])
def test_sentinels_that_could_arise_are_refused(none, bad):
    with pytest.raises(ValueError):
        fim.fill_in_middle(none, sentinels=bad)


def test_plan_is_narrow_and_native(spark):
    plan = fim.op13_fill_in_middle(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
