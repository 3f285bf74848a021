"""Candidate selection: the cheapest substantive result wins, else the longest stub."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.predicates import looks_like_bot_block, looks_like_stub, trimmed_bytes, worth_escalating
from webloom.functions.text import block_banner
from webloom.functions.urls import host

CHEAP, HEADLESS, ARCHIVE = 6, 7, 8
#: Tiers by the source that they sign with.
TIERS = {"accept_md": 1, "cloudflare": 2, "llms_full": 3, "llms_index": 3, "adapter": 4, "pdf": 5, "parse": CHEAP, "headless": HEADLESS, "wayback": ARCHIVE}


def tier_of(source: Column) -> Column:
    return F.coalesce(*[F.when(source == s, F.lit(t)) for s, t in TIERS.items()])


def classify(candidates: DataFrame) -> DataFrame:
    """Adds outcome (ok, stub, failed) and size (trimmed bytes) to (url, tier, source, markdown)."""
    md = F.col("markdown")
    outcome = F.when(md.isNull(), "failed").when(looks_like_bot_block(md) | worth_escalating(md), "stub").otherwise("ok")
    return candidates.withColumn("outcome", outcome).withColumn("size", trimmed_bytes(md))


def timed(candidates: DataFrame) -> DataFrame:
    """Attempts that took longer than their tier may (10, 13 or 15 seconds) count as failed."""
    limit = F.when(F.col("tier") == HEADLESS, 13_000).when(F.col("tier") == ARCHIVE, 15_000).otherwise(10_000)
    late = F.col("latency_ms") > limit
    return candidates.withColumn("timed_out", late).withColumn("markdown", F.when(~late, F.col("markdown")))


def first_ok(classified: DataFrame, order: str | None = None) -> DataFrame:
    """The substantive result of the earliest tier for each URL; of several of one tier the first by the column `order`, then the
    longest."""
    came = [F.col(order)] if order else []
    by = F.struct("tier", *[c.alias("came") for c in came], -F.col("size"), "source")
    return classified.where("outcome = 'ok'").groupBy("url").agg(F.min_by(F.struct("tier", "source", "size"), by).alias("x")).select("url", "x.*")


def rendered(classified: DataFrame) -> DataFrame:
    """Every headless result, as it is: what is asked to be rendered is asked for once a request, so nothing is decided."""
    return classified.where((F.col("tier") == HEADLESS) & (F.col("outcome") != "failed")).select("url", "tier", "source", "markdown", F.lit(False).alias("banner"))


def longest_stub(classified: DataFrame) -> DataFrame:
    """Of equally long stubs the one of the earliest tier."""
    return classified.where("outcome = 'stub'").groupBy("url").agg(F.max_by(F.struct("tier", "source", "size"), F.struct("size", -F.col("tier"))).alias("x")).select("url", "x.*")


def measured(candidates: DataFrame, order: str | None = None) -> DataFrame:
    """What decides between candidates, without their bodies: url, tier, source, outcome, size, whether the text is weak (a stub or a
    rejection) or a rejection, and a hash that tells bodies of one tier apart; with `order` also that column, as `came`."""
    came = [F.col(order).alias("came")] if order else []
    md = F.col("markdown")
    own = [trimmed_bytes(md).alias("size"), looks_like_bot_block(md).alias("blocked"), worth_escalating(md).alias("thin"), looks_like_stub(md).alias("stub"), F.xxhash64("markdown").alias("print")]
    outcome = F.when(F.col("size").isNull(), "failed").when(F.col("blocked") | F.col("thin"), "stub").otherwise("ok")
    rows = candidates.select("url", "tier", "source", *own, *came)
    return rows.select("url", "tier", "source", outcome.alias("outcome"), "size", (F.col("stub") | F.col("blocked")).alias("weak"), "blocked", "print", *(["came"] if came else []))


def winners(rows: DataFrame, mode: str = "auto") -> DataFrame:
    """(url, tier, source, size, print, banner) of the result for each URL, from measured() rows; see decide(). One aggregation
    of a few numbers a row. Of several rows of one tier the longest counts, of equally long ones the first by source. Where
    rows have `came`, the first by it counts instead: of renderings and archived copies the first that didn't fail."""
    pick = F.struct("tier", "source", "size", "weak", "blocked", "print", "outcome")
    came = [F.col("came")] if "came" in rows.columns else []
    cheap, tier, outcome = F.col("tier") <= CHEAP, F.col("tier"), F.col("outcome")
    # an order without ties: what comes first is the same in every run
    one = lambda cond, *by: F.min(F.when(cond, F.struct(*[x.alias(f"k{i}") for i, x in enumerate((*by, *came, -F.col("size"), F.col("source"), F.col("print")))], pick.alias("pick"))))["pick"]
    got = rows.groupBy("url").agg(
        one(cheap & (outcome == "ok"), tier).alias("ok"),
        one(cheap & (outcome == "stub"), -F.col("size"), tier).alias("stub"),
        one((tier == HEADLESS) & (outcome != "failed")).alias("head"),
        F.max(F.when(tier == HEADLESS, outcome == "ok")).alias("head_ok"),
        one((tier == ARCHIVE) & (outcome == "ok")).alias("old"),
        one((tier == ARCHIVE) & (outcome == "stub")).alias("old_stub"),
        *([one((tier == ARCHIVE) & (outcome != "failed")).alias("first_old")] if came else []),
    )
    if came:
        first = F.col("first_old")
        got = got.withColumns({"head_ok": F.col("head.outcome") == "ok", "old": F.when(first["outcome"] == "ok", first), "old_stub": F.when(first["outcome"] == "stub", first)})
    if mode == "on":
        return got.where("head is not null").select("url", "head.tier", "head.source", "head.size", "head.print", F.lit(False).alias("banner"))
    ok, stub, head = F.col("ok"), F.col("stub"), F.col("head") if mode == "auto" else F.lit(None).cast(got.schema["head"].dataType)
    head_ok = F.col("head_ok") if mode == "auto" else F.lit(False)
    longer = F.coalesce(stub["size"] > head["size"], F.lit(False))
    rendered = F.when(head_ok & ~longer, head).when(head_ok & longer, stub)  # returned as it is
    best = F.when(head.isNotNull() & ~longer, head).otherwise(stub)
    best = F.when(head_ok, F.lit(None)).otherwise(best)
    weak = best.isNull() | best["weak"]
    archived = F.when(weak & F.col("old").isNotNull(), F.col("old"))
    older = F.when(weak & F.col("old_stub").isNotNull() & F.coalesce(F.col("old_stub")["size"] > best["size"], F.lit(True)), F.col("old_stub")).otherwise(best)
    final = F.coalesce(ok, rendered, archived, older)
    last = ok.isNull() & rendered.isNull() & archived.isNull()
    out = got.select("url", final.alias("x"), last.alias("last")).where("x is not null")
    return out.select("url", "x.tier", "x.source", "x.size", "x.print", (F.col("last") & F.col("x.blocked")).alias("banner"))


def decide(candidates: DataFrame, mode: str = "auto", order: str | None = None) -> DataFrame:
    """(url, tier, source, markdown, banner) of the result for each URL; URLs without any result are left out.

    mode: 'auto' renders where the cheap tiers give no substantive text, 'off' never, 'on' at once and only. The archive
    is asked where nothing is left or what is left is a stub or a rejection; a rejection that is returned at last gets a
    banner. order: a column in whose order the results of one tier came in; the first counts (see winners()).

    The decision is made on measures of the candidates alone, and the winners' bodies are fetched by URL and tier
    afterwards: no body is part of an aggregation, and each is shuffled once at most.
    """
    chosen = winners(measured(candidates, order), mode).withColumnRenamed("url", "won")
    rows = candidates.where(F.col("markdown").isNotNull()).select("url", F.col("tier").alias("t"), F.col("source").alias("s"), "markdown", F.xxhash64("markdown").alias("p"))
    same = (F.col("url") == F.col("won")) & (F.col("t") == F.col("tier")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("p") == F.col("print"))
    found = rows.join(chosen, same).select("url", "tier", "source", "markdown", "banner")
    return found.dropDuplicates(["url"])  # a candidate may be there twice


def with_banner(decided: DataFrame) -> DataFrame:
    md = F.when(F.col("banner"), block_banner(host(F.col("url")), F.col("markdown"))).otherwise(F.col("markdown"))
    return decided.withColumn("markdown", md)
