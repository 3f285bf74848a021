"""Titles of PDF texts whose first page is blank, and documents that are blank or hold page marks of their own."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from webloom.functions.text import pdf_title


def test_without_a_line_there_is_no_title(spark):
    texts = {"": None, " \n  ": None, " \n---\nsecond page": None, "\n a \n---\nb": "a", "---\nb": "---"}
    rows = spark.createDataFrame(list(texts.items()), "text string, want string").select("want", pdf_title(F.col("text")).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


def test_query_equals_its_sql_on_odd_documents(spark, tmp_path):
    odd = ["", "  \n ", "---\nthe fifth", " \n---\nx", " \n---", "a\n---\nb", "---\n---\n", None]
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = [tuple(r) for r in entry.queries()["pdf_postprocess"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(c.execute(entry.oracle_sql()["pdf_postprocess"]).fetchall())
