"""Licence scan: a paragraph classifier over word n-grams with an unknown class, confirmed by templates; DataFrame operations only."""

from __future__ import annotations

import functools
import random
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import checkpointed, table

# Wordings by which published licences are announced, by family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "Released under the 2-clause BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GPL v2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the Creative Commons Attribution license.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "public-domain": [
        "This work has been released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "proprietary": [
        "Copyright 2020. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying is strictly prohibited.",
    ],
}
# Sentences that use words of licences without announcing one.
UNKNOWN = [
    "The driver lost his license after the accident and had to pay a fine.",
    "She holds a licence to practise medicine in three states.",
    "Public houses need a license to sell alcohol to the general public.",
    "The museum released a new version of its guide under the direction of the author.",
    "Copyright law is a difficult subject that courts read in different ways.",
    "The apache helicopter was flown over the desert for training.",
    "Researchers at MIT published a paper on batteries last week.",
    "The software has no restriction on the number of users.",
    "Permission to enter the building was granted to the visitors.",
    "The terms of the treaty were published by the foundation.",
    "All children have rights, and adults reserved seats for them.",
    "A creative person has common interests with the attribution of art.",
    "Modification of the source of the river is not permitted.",
    "The general said the public would support the new law.",
    "Licensed plumbers work under the supervision of a master.",
    "A gnu is a large animal that lives on the plains.",
    "He was released under bail and this work was done.",
    "The domain of public policy is wide and open to all.",
    "Conditions were met with prior notice and written consent.",
    "The team worked on version 3 of the plan and on version 2.0 of the map.",
]
WORD = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
CLASSES = ["unknown", *TEMPLATES]
#: A family must be so likely, and share so much of one of its templates' word pairs, to be confirmed.
PROBABILITY = 0.5
SIMILARITY = 0.5


def ngrams(paragraph: str) -> list[str]:
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), paragraph))
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def _examples(seed: int = 5) -> tuple[list[list[str]], list[int]]:
    """Templates and sentences, each also shortened, joined to other words and cut, as paragraphs in the wild are."""
    rng, rows, labels = random.Random(seed), [], []
    filler = [w for s in UNKNOWN for w in re.findall(WORD, s.lower())]
    for label, texts in enumerate([UNKNOWN, *TEMPLATES.values()]):
        for text in texts:
            w = re.findall(WORD, text.lower())
            for variant in range(14 if label else 24):
                v = list(w)
                if variant % 3 == 1:
                    v = [x for x in v if rng.random() > 0.12] or v
                if variant % 2:
                    v = rng.choices(filler, k=rng.randint(1, 12)) + v + rng.choices(filler, k=rng.randint(0, 12))
                rows.append(ngrams(" ".join(v)))
                labels.append(label)
    for _ in range(400):
        rows.append(ngrams(" ".join(rng.choices(filler, k=rng.randint(3, 30)))))
        labels.append(0)
    return rows, labels


@functools.cache
def train(rounds: int = 250) -> dict[str, list[float]]:
    """Multinomial logistic regression over word uni- and bigrams; the temperature of the softmax is fitted on a third of
    the examples that the weights haven't seen. Returns n-gram to class weights ('' holds the biases); deterministic.
    """
    rows, labels = _examples()
    vocabulary = sorted({g for r in rows for g in r})
    place = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary) + 1))
    x[:, -1] = 1
    for i, r in enumerate(rows):
        x[i, [place[g] for g in set(r)]] = 1
    y = np.eye(len(CLASSES))[labels]
    fit = np.arange(len(rows)) % 3 != 0

    def descend(x, y):
        w, speed = np.zeros((x.shape[1], len(CLASSES))), 0.0
        for _ in range(rounds):
            z = x @ w
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            speed = 0.9 * speed - 0.3 * (x.T @ (p - y) / len(x) * 8 + 2e-3 * w)
            w = w + speed
        return w

    w = descend(x[fit], y[fit])
    z = x[~fit] @ w

    def loss(t):
        p = z * t - (z * t).max(axis=1, keepdims=True)
        return -((p - np.log(np.exp(p).sum(axis=1, keepdims=True))) * y[~fit]).sum()

    temperature = min((0.5 + 0.1 * i for i in range(30)), key=loss)
    w = np.round(w * temperature, 6)
    out = {g: w[i].tolist() for g, i in place.items() if np.abs(w[i]).max() >= 0.05}
    return out | {"": w[-1].tolist()}


def _template_grams() -> list[tuple[str, int, str, int]]:
    out = []
    for family, texts in TEMPLATES.items():
        for number, text in enumerate(texts):
            grams = sorted({g for g in ngrams(text) if " " in g})
            out += [(family, number, g, len(grams)) for g in grams]
    return out


#: n-grams are looked up by so many values of their checksum.
BUCKETS = 1 << 16


@functools.cache
def _bounds() -> tuple[list[int], list[list[float]], list[float]]:
    """Slots by bucket (0: none), by family what the n-grams of a slot can raise it above unknown, and the rise that it needs.

    A named family is likelier than unknown, so its n-grams' weights less those of unknown must make up for the biases.
    A slot counts all model n-grams of its bucket that raise the family and none that lower it, so a sum over the distinct
    slots of a paragraph is never below the true rise.
    """
    model, slot, rise = train(), [0] * BUCKETS, [[0.0] * len(TEMPLATES)]
    for gram, w in sorted(model.items()):
        gains = [max(0.0, v - w[0]) for v in w[1:]]
        if gram and any(gains):
            a, *b = [zlib.crc32(x.encode()) for x in gram.split(" ")]
            at = (a * 31 + b[0] if b else a) % BUCKETS
            if not slot[at]:
                slot[at] = len(rise)
                rise.append([0.0] * len(TEMPLATES))
            rise[slot[at]] = [x + y for x, y in zip(rise[slot[at]], gains, strict=True)]
    return slot, [list(r) for r in zip(*rise, strict=True)], [model[""][0] - v for v in model[""][1:]]


def _reach(line: Column) -> Column:
    """Whether a paragraph could be named: true for every one that is, whatever else it lets through; no text is built."""
    slot, rises, needs = _bounds()
    constant = lambda values, kind: F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")  # noqa: E731  # folded once
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  # a lambda's argument is evaluated once
    slots = constant(slot, "int")
    at = lambda h: F.get(slots, (h % BUCKETS).cast("int"))

    def total(hits: Column, rise: list[float]) -> Column:
        gains = constant(rise, "double")
        return F.aggregate(hits, F.lit(0.0), lambda x, i: x + F.get(gains, i))

    def named(hits: Column) -> Column:
        return functools.reduce(lambda a, b: a | b, [total(hits, r) >= n - 1e-3 for r, n in zip(rises, needs, strict=True)])

    def hits(h: Column) -> Column:
        pairs = F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.coalesce(at(a * 31 + b), F.lit(0)))
        return F.array_distinct(F.filter(F.concat(F.transform(h, at), pairs), lambda i: i > 0))

    sums_of = lambda words: once(F.transform(words, lambda w: F.crc32(w.cast("binary"))), lambda h: once(hits(h), named))
    return once(_words(line), sums_of)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(f"({WORD})"), F.lit(1))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per paragraph (line) that announces a licence: id, paragraph (from 0), family, probability, similarity, confirmed, line.

    A paragraph's family is the likeliest class; those of class unknown, or less likely than PROBABILITY, are left out.
    similarity is the share of the family's closest template's word pairs that the paragraph has; confirmed from
    SIMILARITY on. Null and empty texts have no paragraphs; a null id stays; repeated rows give repeated results; an
    empty table gives an empty result; other columns are not read. Weights and templates are fixed in size (a few
    thousand rows), so they are broadcast; rows are keyed by paragraph, never by its text, so a line that a third of
    all documents share is spread like any other.
    """
    spark = docs.sparkSession
    model = train()
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("paragraph", "line"))
    lines = checkpointed(lines.where(_reach(F.col("line"))).withColumn("uid", F.monotonically_increasing_id()))
    words = lines.select("uid", _words(F.col("line")).alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))
    pairs = F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<string>"))
    grams = words.select("uid", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), "w", pairs))).alias("gram"))
    names = [f"c{i}" for i in range(len(CLASSES))]
    weights = spark.createDataFrame([(g, *w) for g, w in sorted(model.items())], "gram string, " + ", ".join(f"{n} double" for n in names))
    sums = grams.join(F.broadcast(weights), "gram").groupBy("uid").agg(*[F.sum(n).alias(n) for n in names])
    top = F.greatest(*names)
    total = functools.reduce(lambda a, b: a + b, [F.exp(F.col(n) - top) for n in names])
    best = functools.reduce(lambda rest, i: F.when(F.col(names[i]) == top, CLASSES[i]).otherwise(rest), reversed(range(len(CLASSES))), F.lit("unknown"))
    named = sums.select("uid", best.alias("family"), (1 / total).alias("probability")).where(f"family <> 'unknown' and probability >= {PROBABILITY}")
    templates = spark.createDataFrame(_template_grams(), "family string, template int, gram string, grams int")
    shared = named.join(grams, "uid").join(F.broadcast(templates), ["family", "gram"])
    shared = shared.groupBy("uid", "template", "grams").agg(F.count(F.lit(1)).alias("n")).groupBy("uid").agg(F.max(F.col("n") / F.col("grams")).alias("similarity"))
    out = lines.join(named, "uid").join(shared, "uid", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    return out.select(
        F.col("id").alias(id_col),
        "paragraph",
        "family",
        F.round("probability", 4).alias("probability"),
        F.round("similarity", 4).alias("similarity"),
        (F.col("similarity") >= SIMILARITY).alias("confirmed"),
        "line",
    )


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    model = train()
    names = [f"c{i}" for i in range(len(CLASSES))]
    weights = ", ".join(f"({quote(g)}, {', '.join(f'{v}::DOUBLE' for v in w)})" for g, w in sorted(model.items()))
    templates = ", ".join(f"({quote(f)}, {n}, {quote(g)}, {k})" for f, n, g, k in _template_grams())
    top = f"greatest({', '.join(names)})"
    best = "CASE " + " ".join(f"WHEN {n} = top THEN {quote(c)}" for n, c in zip(names, CLASSES, strict=True)) + " END"
    return f"""
WITH weights(gram, {", ".join(names)}) AS (VALUES {weights}),
templates(family, template, gram, grams) AS (VALUES {templates}),
split_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS paragraph FROM documents),
numbered AS (SELECT doc_id, paragraph, line, row_number() OVER () AS uid FROM split_lines),
w AS (SELECT uid, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM numbered),
grams AS (SELECT DISTINCT uid, gram FROM (
    SELECT uid, '' AS gram FROM w UNION ALL SELECT uid, unnest(w) FROM w
    UNION ALL SELECT uid, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w)),
sums AS (SELECT uid, {", ".join(f"sum({n}) AS {n}" for n in names)} FROM grams JOIN weights USING (gram) GROUP BY uid),
named AS (SELECT uid, {best} AS family, 1 / ({" + ".join(f"exp({n} - top)" for n in names)}) AS probability FROM (SELECT *, {top} AS top FROM sums)),
kept AS (SELECT * FROM named WHERE family <> 'unknown' AND probability >= {PROBABILITY}),
shared AS (SELECT uid, max(n / grams) AS similarity FROM (
    SELECT k.uid, t.template, t.grams, count(*) AS n FROM kept k JOIN grams g ON g.uid = k.uid
    JOIN templates t ON t.family = k.family AND t.gram = g.gram GROUP BY ALL) GROUP BY uid)
SELECT doc_id, paragraph::INT AS paragraph, family, round(probability, 4) AS probability, round(coalesce(similarity, 0), 4) AS similarity,
       coalesce(similarity, 0) >= {SIMILARITY} AS confirmed, line
FROM numbered JOIN kept USING (uid) LEFT JOIN shared USING (uid)"""


SQL = {"op8_licenses": _sql}
