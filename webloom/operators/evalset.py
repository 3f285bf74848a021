"""Coverage evaluation: results per URL, pass rates, a gate against the run before, and differences between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.predicates import eval_passes


def results(runs: DataFrame) -> DataFrame:
    """Adds result and bytes to (run_ts, category, url, rc, body, ms)."""
    result = F.when(F.col("rc") != 0, F.format_string("❌ err(%d)", "rc")).when(eval_passes(F.col("body")), "✅").otherwise("⚠️ stub")
    return runs.withColumn("result", result).withColumn("bytes", F.octet_length("body"))


def pass_rates(found: DataFrame) -> DataFrame:
    """Per run and category, and per run over all (category null), in one rollup."""
    rolled = found.rollup("run_ts", "category").agg(F.count_if(F.col("result") == "✅").alias("passed"), F.count(F.lit(1)).alias("total"), F.grouping_id().alias("g"))
    rate = F.round(100 * F.col("passed") / F.col("total")).cast("long")
    return rolled.where("g < 3").select("run_ts", "category", "passed", "total", rate.alias("percent"))


def regression_gate(found: DataFrame, category: str) -> DataFrame:
    """(run_ts, passed, before, regressed) of one category: whether a run passes fewer than the one before."""
    per_run = found.where(F.col("category") == category).groupBy("run_ts").agg(F.count_if(F.col("result") == "✅").alias("passed"))
    before = F.lag("passed").over(Window.partitionBy(F.lit(category)).orderBy("run_ts"))
    return per_run.withColumn("before", before).withColumn("regressed", F.coalesce(F.col("passed") < F.col("before"), F.lit(False)))


def run_diff(found: DataFrame, old: int, new: int) -> DataFrame:
    """URLs whose results differ between two runs."""
    pick = lambda k, name: found.where(F.col("run_ts") == k).select("url", F.col("result").alias(name))
    both = pick(old, "old").join(pick(new, "new"), "url", "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def metrics(found: DataFrame) -> DataFrame:
    return found.groupBy("run_ts", "category").agg(F.sum("bytes").alias("bytes"), F.max("ms").alias("slowest_ms"), F.avg("ms").alias("mean_ms"))


def report_lines(rates: DataFrame) -> DataFrame:
    """A Markdown table row for each rate."""
    name = F.coalesce("category", F.lit("**all**"))
    return rates.select("run_ts", "category", F.format_string("| %s | %d/%d | %d%% |", name, "passed", "total", "percent").alias("line"))
