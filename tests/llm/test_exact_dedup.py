import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from webloom.llm.common import checkpointed, merge_copies
from webloom.llm.exact_dedup import drop_exact_copies, exact_copies


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def test_groups_against_brute_force(spark, odd):
    got = exact_copies(odd).collect()
    groups = defaultdict(list)
    for i, t, _ in ODD:
        groups[norm(t)].append(i)
    assert len(got) == len(ODD)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == min((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)


def test_kept_rows_have_the_columns_of_the_input(spark, odd):
    kept = drop_exact_copies(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert sorted(norm(r.text) for r in rows) == sorted({norm(t) for _, t, _ in ODD})
    assert {r.doc_id for r in rows} == {1, 3, 5, 6, 7, None}


def test_empty(none):
    assert exact_copies(none).count() == 0 and drop_exact_copies(none).count() == 0


def test_many_runs(spark):
    rows = spark.range(0, 5000, 1, 40).selectExpr("4999 - id as doc_id", "concat('t', id % 7) as text")
    got = exact_copies(rows).collect()
    assert {r.keep_id for r in got} == set(range(7)) and sum(r.group_size for r in got if r.kept) == 5000


def test_columns_named_like_helpers(spark):
    rows = [(1, "a", "q", "i", "s"), (2, "a", "r", "j", "t")]
    got = drop_exact_copies(spark.createDataFrame(rows, "doc_id long, text string, text_sha string, id string, sha string")).collect()
    assert [tuple(r) for r in got] == rows[:1]


def test_merge_needs_every_key_at_every_level(spark):
    rows = spark.range(0, 4000, 1, 64).selectExpr(
        "id", "unhex(sha2(cast(id % 5 as string), 256)) as digest", "id % 2 as check", "spark_partition_id() as run", "id % 3 as lane"
    )
    rows = checkpointed(rows.withColumn("first", F.col("id")))
    got = merge_copies(rows, ["digest", "check"], "first")
    assert got.columns == [*["digest", "check", "run"], "id", "lane", "first", "keep", "group_size"]
    for r in got.collect():
        assert r.keep == next(i for i in range(10) if i % 5 == r.id % 5 and i % 2 == r.id % 2) and r.group_size == 400


def test_runs_meet_by_range_of_digests_and_merge_in_order(spark, capsys):
    rows = checkpointed(spark.range(0, 100, 1, 16).selectExpr("unhex(sha2(cast(id as string), 256)) as digest", "spark_partition_id() as run", "struct(id) as first"))
    merge_copies(rows, ["digest"], "first").explain()
    plan = capsys.readouterr().out
    met = [line for line in plan.splitlines() if "REPARTITION_BY_COL" in line]
    assert met and all("lane" in line and "digest" not in line for line in met) and "SortAggregate" in plan
