"""Sources and sinks: markdown files of tabs, category lists, registry tables and evaluation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.text import LABEL
from webloom.schema import TABLES


def tab_file(label: str = LABEL) -> Column:
    """The text of a tab's file: a header of its provenance above the body. Columns: id, url, source, title, fetched_at, markdown."""
    field = lambda name: F.concat(F.lit(f"  {name}: "), F.coalesce(F.col(name).cast("string"), F.lit("")), F.lit("\n"))
    return F.concat(F.lit(f"<!-- {label}-tab\n"), *[field(n) for n in ("id", "url", "source", "title", "fetched_at")], F.lit("-->\n\n"), F.col("markdown"))


def without_header(content: Column, label: str = LABEL) -> Column:
    return F.regexp_replace(content, rf"(?s)^<!-- {label}-tab\n.*?-->\n*", "")


def write_tabs(tabs: DataFrame, path: str) -> None:
    """Bodies as Parquet, a directory for each source, in ranges of (source, id) so that no source is one task's and ids prune."""
    tabs.repartitionByRange("source", "id").sortWithinPartitions("source", "id").write.partitionBy("source").mode("overwrite").parquet(path)


def read_tab_files(spark: SparkSession, path: str) -> DataFrame:
    """(tab_id, markdown) of a folder of <id>.md files."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_name").alias("file"), "value")
    return raw.select(F.regexp_replace("file", r"\.md$", "").alias("tab_id"), without_header(F.col("value")).alias("markdown"))


def category_urls(lines: DataFrame) -> DataFrame:
    """URLs of a category list (value): comments and blank lines dropped."""
    url = F.rtrim(F.regexp_replace("value", "#.*$", ""))
    return lines.select(url.alias("url")).where("url <> ''")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{path}/{name}.parquet")


def write_summary(found: DataFrame, path: str) -> None:
    """Evaluation rows as tab-separated text."""
    found.select("category", "url", "result", "source", "bytes", "ms").write.mode("overwrite").csv(path, sep="\t")


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def fetched_by(captures: DataFrame, kind: str) -> DataFrame:
    """The captures of one fetcher; an unknown kind is an error."""
    if kind not in ("plain", "stealth", "headless"):
        raise ValueError(f"no such fetcher: {kind}")
    return captures.where(F.col("fetcher") == kind)
