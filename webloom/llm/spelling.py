"""Spelling variants of a corpus's words by Aho-Corasick automata over halves of words.

If two words differ by one inserted, deleted or replaced code point, one half of the first is whole in the second: its first
half at the start, or its second half at the end. Every word's two halves are segments; shards of segments become
automata, words are scanned by the automata of the shards that their starts and ends can fall into, and what is found
at the right offset in a word of a length that fits is verified.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm import vec
from webloom.llm.common import checkpointed, shuffle_width, table
from webloom.llm.graph import looked_up

RUN = re.compile("[a-zÀ-ÿ]+")
#: Texts are counted in parts of about so many bytes, and counts leave a task when it holds so many words.
PART_BYTES = 4_000_000
COUNTED = 200_000
#: Segments of a shard, about so many.
SHARD_SEGMENTS = 50_000
#: Words that share a segment are compared through their rest's deletions from so many on.
CROWDED = 8
#: Words that share a segment are dealt out by their rest's deletions from so many on, so no shard holds more of one segment.
HOT = 20_000
#: At most so many hot segments (20 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000


def mistyped(word: str, state: int, every: int) -> str:
    """`word`, or if `every` divides its crc32 (continued from `state`), the word without one code point that the crc32 names."""
    if not every:
        return word
    h = zlib.crc32(word.encode(), state)
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, least: int = 6, often: int = 5, every: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of ASCII letters and U+00C0 to U+00FF, A-Z lower-cased, of at least `least` code points that occur `often`.

    With `every`, runs lose a code point where `every` divides the crc32 of `<id>:<run>`: planted mistakes. Counts are combined in
    a task before they are shuffled, so neither a frequent word nor a long text makes many rows.
    """

    def run(batches):
        held: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in vec.parts(batches, 1, PART_BYTES):
            for i, text in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True):
                if text:
                    state = zlib.crc32(f"{'' if i is None else i}:".encode())
                    for word, n in Counter(RUN.findall(text.encode().lower().decode())).items():
                        word = mistyped(word, state, every)
                        if len(word) >= least:
                            held[word] += n
                    if len(held) >= COUNTED:
                        yield out()
        if held:
            yield out()

    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def deletions(rest: str) -> set[str]:
    """`rest` and what is left of it without one code point. Two strings one edit apart have one of these in common."""
    return {rest, *(rest[:i] + rest[i + 1 :] for i in range(len(rest)))}


class Holders:
    """The rests of the words that share a segment; which of them are one edit from a given rest."""

    def __init__(self, rests: list[str]):
        self.rests, self.by_deletion = rests, None
        if len(rests) >= CROWDED:
            self.by_deletion = {}
            for i, rest in enumerate(rests):
                for d in deletions(rest):
                    self.by_deletion.setdefault(d, []).append(i)

    def near(self, rest: str) -> Iterable[int]:
        if self.by_deletion is None:
            found: Iterable[int] = range(len(self.rests))
        else:
            found = {i for d in deletions(rest) for i in self.by_deletion.get(d, ())}
        return (i for i in found if abs(len(self.rests[i]) - len(rest)) <= 1 and one_edit(self.rests[i], rest))


class Near:
    """For each held word how many near ones were found, and the one of largest n (of equal ones the smallest)."""

    def __init__(self):
        self.found: dict[str, list] = {}

    def add(self, word: str, other: str, n: int) -> None:
        best = self.found.setdefault(word, [0, 0, ""])
        best[0] += 1
        if n > best[1] or (n == best[1] and other < best[2]):
            best[1], best[2] = n, other

    def batch(self) -> pa.RecordBatch:
        n_near, best_n, best = zip(*self.found.values(), strict=True) if self.found else ((), (), ())
        columns = [pa.array(list(self.found), pa.string()), pa.array(n_near, pa.int64()), pa.array(best_n, pa.int64()), pa.array(best, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "best_n", "best"])


def scan(held: list[tuple[int, str]], scanned: Iterable[tuple[str, int]], out: Near) -> None:
    """One shard. held: (half, word), half 0 or 1; scanned: (word, n). Adds to `out` what is near a held word by its held half."""
    by_segment: dict[str, tuple[list[str], list[str]]] = {}
    for half, word in held:
        m = len(word) // 2
        by_segment.setdefault(word[m:] if half else word[:m], ([], []))[half].append(word)
    automaton = ahocorasick.Automaton()
    for segment, halves in by_segment.items():
        m = len(segment)
        rests = [w[m:] for w in halves[0]], [w[:-m] for w in halves[1]]
        automaton.add_word(segment, (m, halves, [Holders(r) for r in rests]))
    if not by_segment:
        return
    automaton.make_automaton()
    for word, n in scanned:
        last = len(word) - 1
        for end, (m, words, holders) in automaton.iter(word):
            if end == m - 1 and words[0]:
                for i in holders[0].near(word[m:]):
                    out.add(words[0][i], word, n)
            if end == last and words[1]:
                for i in holders[1].near(word[:-m]):
                    x = words[1][i]
                    if not word.startswith(x[: len(x) - m]):  # else its first half has found it
                        out.add(x, word, n)


def _rows(batches):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns)), strict=True)


_FOUND = "word string, n_near long, best_n long, best string"


def _from_shards(rows: DataFrame, shards: int) -> DataFrame:
    """rows: (half, segment, word, n, held). Each shard's segments come first, then the words that are scanned one by one."""

    def run(batches):
        # (shard, half or 2 where scanned, word, n), sorted; only held words are gathered
        out = Near()
        for _, own in itertools.groupby(_rows(batches), lambda r: r[0]):
            held, first = [], None
            for row in own:
                if row[1] == 2:
                    first = row
                    break
                held.append((row[1], row[2]))
            if held and first:
                scan(held, ((r[2], r[3]) for r in itertools.chain([first], own)), out)
            if len(out.found) >= COUNTED:
                yield out.batch()
                out = Near()
        if out.found:
            yield out.batch()

    shard = F.pmod(F.xxhash64("half", "segment"), F.lit(shards)).cast("int")
    dealt = rows.select(shard.alias("shard"), F.when(F.col("held"), F.col("half")).otherwise(2).alias("kind"), "word", "n").distinct()
    return dealt.repartition(shards, "shard").sortWithinPartitions("shard", "kind", "word").mapInArrow(run, _FOUND)


def _from_deletions(rows: DataFrame) -> DataFrame:
    """The same of hot segments: words meet where their rests have a deletion in common, so few that each is compared to each."""

    def run(batches):
        out = Near()
        for (half, segment, common), own in itertools.groupby(_rows(batches), lambda r: r[:3]):
            m = len(segment)
            own = [(r[3][:-m] if half else r[3][m:], *r[3:]) for r in own]
            held = [(rest, x) for rest, x, _, is_held in own if is_held]
            for rest, word, n, _ in own:
                for x_rest, x in held:
                    # near, and they don't meet under a smaller deletion too
                    if one_edit(x_rest, rest) and min(deletions(x_rest) & deletions(rest)) == common:
                        if not half or not word.startswith(x[: len(x) - m]):
                            out.add(x, word, n)
            if len(out.found) >= COUNTED:
                yield out.batch()
                out = Near()
        if out.found:
            yield out.batch()

    m = F.char_length("segment")
    rest = F.when(F.col("half") == 0, F.substr("word", m + 1)).otherwise(F.left("word", F.char_length("word") - m))
    cut = F.transform(F.sequence(F.lit(1), F.char_length("rest")), lambda i: F.concat(F.left("rest", i - 1), F.substr("rest", i + 1)))
    cut = F.when(F.col("rest") != "", cut).otherwise(F.array().cast("array<string>"))
    meets = rows.withColumn("rest", rest).withColumn("deletion", F.explode(F.array_distinct(F.concat(F.array("rest"), cut))))
    meets = meets.groupBy("half", "segment", "deletion", "word", "n").agg(F.max("held").alias("held"))
    keys = ["half", "segment", "deletion"]
    return meets.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, _FOUND)


def near_words(words: DataFrame, least: int = 6, shard_segments: int = SHARD_SEGMENTS, hot: int = HOT) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have near ones. words: (word, n), checkpointed, each word once, of at
    least `least` (2 or more) code points.

    Each word holds its two halves in the shards of their hashes, and is scanned in those of the starts and ends that a word
    of a length within one of its own would have as halves: at most five.
    """
    total = words.count()
    length, half = F.char_length("word"), lambda n: F.floor(n / 2).cast("int")
    row = lambda side, segment, held: F.struct(F.lit(side).alias("half"), segment.alias("segment"), F.lit(held).alias("held"))
    start = lambda n: F.left("word", half(n))
    end = lambda n: F.right("word", n - half(n))
    held = [row(0, start(length), True), row(1, end(length), True)]
    shorter = length - 1 >= least
    scanned: list[Column] = []
    for side, cut in ((0, start), (1, end)):
        for n, on in ((length - 1, shorter), (length, F.lit(True)), (length + 1, F.lit(True))):
            scanned.append(F.when(on, row(side, cut(n), False)))
    seen = F.array_distinct(F.filter(F.array(*scanned), lambda x: x.isNotNull()))
    rows = words.select("word", "n", F.explode(F.concat(F.array(*held), seen)).alias("x")).select("x.half", "x.segment", "word", "n", "x.held")
    shards = max(1, -(-2 * total // shard_segments))
    shards = max(shards, min(shuffle_width(words.sparkSession), total // 1000))
    crowds = rows.where("held").groupBy("half", "segment").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= hot)
    crowds = checkpointed(crowds.select("half", "segment"))
    if not (many := crowds.count()):
        found = _from_shards(rows, shards)
    else:
        listed = F.broadcast(crowds) if many <= BROADCAST_ROWS else crowds
        keys = ["half", "segment"]
        found = _from_shards(rows.join(listed, keys, "left_anti"), shards).union(_from_deletions(rows.join(listed, keys, "left_semi").select(*rows.columns)))
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("x"))
    return found.select("word", "n_near", (-F.col("x.n")).alias("best_n"), F.col("x.word").alias("best"))


def spelling_variants(words: DataFrame, least: int = 6, ratio: int = 5, shard_segments: int = SHARD_SEGMENTS, hot: int = HOT) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of words (word, n), one row each.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point; n_near counts the near ones. A
    word's form is its near word of largest n (of equal ones the first in code-point order), if that is at least `ratio` (more
    than 1) times its own; root is where forms lead from a word, the word itself if it has none. Since n grows along forms,
    they end, and pointers that double in length reach every root in a number of rounds that the largest n bounds.

    Words must be distinct; rows with a null word or n, a word shorter than `least` or an n below 1 are left out; an empty
    table gives an empty result; other columns are not returned.
    """
    if ratio < 2 or least < 2:
        raise ValueError("ratio and least must be 2 or more")
    words = checkpointed(words.select("word", F.col("n").cast("long").alias("n")).where((F.char_length("word") >= least) & (F.col("n") >= 1)))
    near = near_words(words, least, shard_segments, hot)
    is_form = F.col("best_n") >= ratio * F.col("n")
    forms = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    forms = checkpointed(forms)
    # only words with a form have a way to go
    ways = checkpointed(forms.where("form is not null").select("word", F.col("form").alias("root")))
    n, most = ways.count(), forms.agg(F.max("n")).first()[0] or 1
    reach, steps = 1, 0
    while ratio**steps <= most:
        steps += 1
    while reach < steps and n:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways = checkpointed(looked_up(ways, n, "root", further, "left").select("word", F.coalesce("next", "root").alias("root")))
        reach *= 2
    return forms.join(ways, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents"), every=199))


#: crc32 isn't SQL; tests/llm/test_spelling.py holds the query against brute force.
SQL: dict[str, str] = {}
