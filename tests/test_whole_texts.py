"""Queries without SQL take whole texts."""

from pyspark.sql import functions as F

from webloom.plans import catalogue

D = "/root/testdata/sf0.001"


def test_threads_hold_whole_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()}
    plain = {i: t for i, t in texts.items() if t and len(t) > 200 and not set(t) & set("<>&")}
    assert plain
    for name in ("hn_thread", "reddit_thread"):
        got = {r.doc_id: r.md for r in catalogue.QUERIES[name](spark, D).collect()}
        assert got.keys() == texts.keys()
        for i, t in plain.items():
            for line in t.splitlines():
                assert line in got[i]


def test_pdf_tier_reads_whole_texts(spark):
    import hashlib

    from webloom.functions.text import pdf_text, postprocess
    from webloom.plans import fixtures as V

    d = "/root/testdata/sf0.01"
    own = V.pages_text(spark, d).select(postprocess(pdf_text(F.col("v"))).alias("md")).collect()
    whole = {hashlib.md5(r.md.encode()).hexdigest() for r in own if len(r.md) > 320}
    got = [r.md5 for r in catalogue.QUERIES["pdf_tier"](spark, d).collect()]
    assert got and sum(m in whole for m in got) > len(got) / 2
