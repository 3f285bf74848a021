"""Fill-in-the-middle texts, in DataFrame functions only.

A text becomes an array of units, three arrangements of its slices are joined under sentinels, and a reader of sentinels
gives the text back.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import table

#: What stands before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: A unit: one code point.
UNIT = "(?s)."


def _draw(id_col: Column, group: int) -> Column:
    """An unsigned number that depends on the id alone: eight hex digits of a SHA-256."""
    digits = F.substring(F.sha2(F.concat(F.lit("1:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 8 * group + 1, 8)
    return F.conv(digits, 16, 10).cast("long")


def _bare(text: Column, sentinels: tuple[str, str, str]) -> Column:
    found = F.lit(False)
    for s in sentinels:
        found = found | F.contains(text, F.lit(s))
    return ~found


def rebuilt(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that `output` was made of, read from it by its sentinels. No text under sentinels holds one, and none arises
    where parts meet, so an output has four parts, the first of them empty."""
    part = F.split(output, "|".join(re.escape(s) for s in sentinels), -1)
    psm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))
    spm = F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rearranged: int = 90,
    suffix_first: int = 20,
    sentinels: tuple[str, str, str] = SENTINELS,
    unit: str = UNIT,
) -> DataFrame:
    """One row per row of `docs`: id, n, form, prefix_chars, middle_chars, output.

    A text is cut into units (matches of `unit`, left to right, which must leave nothing out; n of them) at two places that
    its id alone decides. Of 100 ids, about `rearranged` are rearranged, `suffix_first` of 100 of these as suffix, prefix,
    middle (`spm`), the others as prefix, suffix, middle (`psm`); the rest stay `plain`, and so do empty texts and those
    that hold a sentinel. Sentinels must begin with one character, hold it nowhere else, and none may begin another, so that
    no text and sentinel make another where they meet.

    Null texts count as empty, a null id as the empty string; repeated rows give the same row each; prefix_chars and
    middle_chars are null where plain; an empty table gives an empty result; other columns are neither read nor returned.
    A narrow plan: nothing is shuffled. A task holds the units of one text at a time, about 60 bytes a unit.
    """
    clear = len({s[:1] for s in sentinels}) == 1 and all(len(s) > 1 and s[0] not in s[1:] for s in sentinels)
    if not clear or sum(a.startswith(b) for a in sentinels for b in sentinels) > 3:
        raise ValueError("sentinels must begin with one character, hold it nowhere else, and none may begin another")
    p, s, m = (F.lit(x) for x in sentinels)
    key, text = F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(key.alias("id"), text.alias("text"), F.regexp_extract_all(text, F.lit(unit), F.lit(0)).alias("units"))
    n = F.size("units").cast("long")
    first, second = _draw(F.col("id"), 0) % (n + 1), _draw(F.col("id"), 1) % (n + 1)
    plain = (F.col("text") == "") | ~_bare(F.col("text"), sentinels) | (_draw(F.col("id"), 2) % 100 >= rearranged)
    form = F.when(plain, "plain").when(_draw(F.col("id"), 3) % 100 < suffix_first, "spm").otherwise("psm")
    cut = rows.select("id", "text", "units", n.alias("n"), form.alias("form"), F.least(first, second).cast("int").alias("a"), F.greatest(first, second).cast("int").alias("b"))
    joined = lambda start, length: F.array_join(F.slice("units", start, length), "")
    a, b = F.col("a"), F.col("b")
    parts = cut.select(
        "id", "text", "n", "form",
        F.when(F.col("form") != "plain", joined(F.lit(1), a)).alias("prefix"),
        F.when(F.col("form") != "plain", joined(a + 1, b - a)).alias("middle"),
        F.when(F.col("form") != "plain", joined(b + 1, F.size("units") - b)).alias("suffix"),
    )
    output = (
        F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle"))
        .when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle"))
        .otherwise(F.col("text"))
    )
    chars = lambda c: F.char_length(c).cast("long")
    return parts.select(F.col("id").alias(id_col), "n", "form", chars("prefix").alias("prefix_chars"), chars("middle").alias("middle_chars"), output.alias("output"))


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(rebuilt(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL = {
    "op13_fill_in_middle": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, ('0x' || substr(h, 1, 8))::UBIGINT::BIGINT AS h1, ('0x' || substr(h, 9, 8))::UBIGINT::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::UBIGINT::BIGINT AS h3, ('0x' || substr(h, 25, 8))::UBIGINT::BIGINT AS h4 FROM t),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p""",
}
