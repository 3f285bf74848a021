"""Candidate selection where several pages have one URL: the SQL takes the first of a tier."""

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = ["first_ok", "waterfall_decide", "waterfall_headless_only", "waterfall_banner"]


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    d = tmp_path_factory.mktemp("repeated")
    duckdb.sql(f"COPY (SELECT page_id, 'https://e' || page_id % 3 || '.example/' || page_id % 37 AS url, html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id) TO '{d}/pages.parquet'")
    return d


@pytest.mark.parametrize("name", NAMES)
def test_equals_its_sql_on_repeated_urls(spark, repeated, name):
    c = duckdb.connect()
    c.execute("SET threads = 1")  # the first is the one of the smallest page_id
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{repeated}/pages.parquet'")
    want = c.execute(entry.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    got = [tuple(r[x] for x in columns) for r in entry.queries()[name](spark, str(repeated)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want.fetchall()))
