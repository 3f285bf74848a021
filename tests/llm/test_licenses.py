import math

from webloom.llm.licenses import CLASSES, TEMPLATES, UNKNOWN, ngrams, scan_licenses, train


def brute(line):
    model = train()
    z = [sum(model[g][c] for g in {"", *ngrams(line)} if g in model) for c in range(len(CLASSES))]
    p = [math.exp(v - max(z)) for v in z]
    best = max(range(len(z)), key=lambda c: z[c])
    return CLASSES[best], p[best] / sum(p)


def test_families_of_notices_that_were_not_templates(spark):
    unseen = {
        "This repository is licensed under the Apache License, Version 2.0, see below.": "apache-2.0",
        "My little tool is released under the MIT License and has no warranty.": "mit",
        "All code here is licensed under the GNU General Public License, version 3 or later.": "gpl",
        "The text of this site is licensed under CC BY-NC 4.0, the images are not.": "cc-by-nc",
        "Some words before. Licensed under the BSD 3-Clause License. And after.": "bsd",
    }
    rows = [(i, f"Intro.\n{t}\nEnd") for i, t in enumerate(unseen)]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.family for i, r in got.items()} == dict(enumerate(unseen.values()))
    assert all(r.confirmed and r.paragraph == 1 for r in got.values())
    for i, t in enumerate(unseen):
        family, p = brute(t)
        assert got[i].family == family and abs(got[i].probability - p) < 1e-3


def test_unknown_is_left_alone(spark):
    rows = [(i, t) for i, t in enumerate(UNKNOWN + ["The license of the hunter had expired when he met the warden.", "Her permission slip was copied."])]
    assert scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect() == []


def test_every_template_is_found(spark):
    rows = [(i, t, f) for i, (f, t) in enumerate((f, t) for f, ts in TEMPLATES.items() for t in ts)]
    got = {r.doc_id: r.family for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, family string")).collect()}
    assert sum(got.get(i) == f for i, _, f in rows) >= len(rows) - 3


def test_odd_rows(spark, odd, none):
    assert scan_licenses(odd).count() == 0 and scan_licenses(none).count() == 0
    rows = [(None, "Released under the MIT License."), (1, "Released under the MIT License.\nx\nReleased under the MIT License."), (1, None)]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((repr(r.doc_id), r.paragraph, r.family) for r in got) == [("1", 0, "mit"), ("1", 2, "mit"), ("None", 0, "mit")]


def test_lines_without_usual_words_are_scored(spark):
    line = "Available under Apache-2.0 or MIT."
    (got,) = scan_licenses(spark.createDataFrame([(1, f"Intro.\n{line}\nEnd")], "doc_id long, text string")).collect()
    assert (got.paragraph, got.family) == (1, brute(line)[0]) == (1, "mit")


def test_every_line_of_the_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {}
    for r in docs.select("doc_id", "text").collect():
        for n, line in enumerate((r.text or "").split("\n")):
            family, p = brute(line)
            if family != "unknown" and p >= 0.5:
                want[r.doc_id, n] = family
    assert {(r.doc_id, r.paragraph): r.family for r in scan_licenses(docs).collect()} == want
