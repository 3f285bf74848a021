import random
import re

import pytest

from webloom.operators import waterfall as W

GOOD = "A sentence of several ordinary words that goes on for a while. " * 12
SOME = ["", None, "tiny", "Access Denied", "Just a moment...", GOOD, GOOD + "more", "word " * 25 + "x" * 60, "word " * 50 + "y" * 10, "Checking your browser " + GOOD, "z" * 5000 + " access denied"]


def brute(rows, mode):
    """The tiers asked in order, on the measured rows of one URL."""
    rows = sorted(rows, key=lambda r: (r.tier, -(r.size or 0), r.source, r.print))
    first = lambda found: next(iter(found), None)
    head = first(r for r in rows if r.tier == 7 and r.outcome != "failed")
    if mode == "on":
        return head and (head, False)
    cheap = [r for r in rows if r.tier <= 6]
    if ok := first(r for r in cheap if r.outcome == "ok"):
        return ok, False
    best = min((r for r in cheap if r.outcome == "stub"), key=lambda r: (-r.size, r.tier, r.source, r.print), default=None)
    if mode == "auto" and head:
        rendered = any(r.tier == 7 and r.outcome == "ok" for r in rows)
        best = best if best and best.size > head.size else head
        if rendered:
            return best, False
    old = {kind: first(r for r in rows if r.tier == 8 and r.outcome == kind) for kind in ("ok", "stub")}
    if best is None or best.weak:
        if old["ok"]:
            return old["ok"], False
        if old["stub"] and (best is None or old["stub"].size > best.size):
            best = old["stub"]
    return best and (best, best.blocked)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    out = [(f"u{u}", rng.choice((1, 2, 6, 7, 7, 8, 8)), rng.choice("ab"), rng.choice(SOME), 1) for u in range(250) for _ in range(rng.randint(1, 6))]
    return spark.createDataFrame(out + out[:40], "url string, tier int, source string, markdown string, won int").repartition(4).cache()


@pytest.mark.parametrize("mode", ["auto", "off", "on"])
def test_equals_the_tiers_asked_in_order(rows, mode):
    by_url = {}
    for r in W.measured(rows).collect():
        by_url.setdefault(r.url, []).append(r)
    want = {u: x for u, own in by_url.items() if (x := brute(own, mode))}
    bodies = {(r.url, r.print): r for r in W.measured(rows).collect()}
    got = W.decide(rows, mode)
    assert got.columns == ["url", "tier", "source", "markdown", "banner"]
    found = got.collect()
    assert len(found) == len(want) == len({r.url for r in found})
    text = {}
    for r in rows.selectExpr("url", "xxhash64(markdown) as print", "markdown").collect():
        text[r.url, r.print] = r.markdown
    for r in found:
        x, banner = want[r.url]
        assert (r.tier, r.source, r.markdown, r.banner) == (x.tier, x.source, text[r.url, x.print], banner) and (r.url, x.print) in bodies


def test_no_body_is_aggregated(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c"))
    plan = W.winners(W.measured(stored))._jdf.queryExecution().executedPlan().toString()
    own = next(a for a in re.findall(r"Exchange hashpartitioning.*?\n(.*?)\n", plan, re.S) if "Aggregate" in a)
    assert "first(" not in plan and not re.search(r"output=.*markdown", own)
    schema = W.winners(W.measured(stored)).columns
    assert schema == ["url", "tier", "source", "size", "print", "banner"]
    # the pass that measures hands on numbers only
    assert "markdown" not in W.measured(stored).columns


def test_empty(spark):
    none = spark.createDataFrame([], "url string, tier int, source string, markdown string")
    assert W.decide(none).collect() == [] and W.decide(none, "on").collect() == []
