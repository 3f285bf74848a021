"""Near copies by SimHash and meet-in-the-middle ball hashing.

Two fingerprints within a radius have a variant in common that lies within half the radius of both. Every distinct
fingerprint emits all its variants within half the radius, equal variants meet, and those who meet are verified. The
variants are not shuffled one by one: they are cut into ranges by their leading bits, a fingerprint goes once to each
range that holds some of its variants, and the task of a range makes those variants and sorts them.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import vec
from webloom.llm.common import checkpointed, free_name, run_of, table
from webloom.llm.graph import components, roots

SEED = 42
#: Texts are hashed in parts of about so many bytes.
PART_BYTES = 4_000_000
#: Variants that a task makes and sorts at once, about so many; a range of leading bits that holds WIDE times as many is cut again.
VARIANTS = 1 << 20
WIDE = 4
#: At most so many leading bits are added at once.
BITS = 12
#: At most so many ranges (12 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000
U = np.uint64


def fingerprint(text: bytes | None, k: int) -> int:
    """64 bits, each set if it is in more than half of the hashes of the k-word shingles, repeats included; 0 without words."""
    words = (text or b"").lower().split()  # of bytes: A-Z, and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > k:
        starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), U, len(starts))
    counts = np.zeros(64, "i8")
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(U)[0])


def fingerprints(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long. See near_copies for odd rows."""

    def run(batches):
        for batch in vec.parts(batches, 1, PART_BYTES):
            found = np.array([fingerprint(x, k) for x in batch.column(1).cast(pa.binary()).to_pylist()], U)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view("i8"))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def masks(bits: int, flips: int) -> np.ndarray:
    """All numbers of `bits` bits of which at most `flips` are set, fewest first."""
    return np.array([sum(1 << i for i in c) for f in range(min(bits, flips) + 1) for c in itertools.combinations(range(bits), f)], U)


def ball(bits: int, flips: int) -> int:
    return sum(math.comb(bits, f) for f in range(flips + 1))


def _finer(ranges: DataFrame, depth: int, bits: int, half: int) -> DataFrame:
    """Rows of ranges of `depth` leading bits to those of `bits` more: one for each range that a row's variants reach."""
    own = F.shiftrightunsigned("fp", 64 - depth - bits).bitwiseAND(F.lit((1 << bits) - 1))
    flips = F.array(*[F.struct(F.lit(int(m)).cast("long").alias("mask"), F.lit(int(m).bit_count()).alias("cost")) for m in masks(bits, half)])
    rows = ranges.withColumn("own", own).withColumn("flip", F.explode(flips)).where("flip.cost <= left")
    key = F.shiftleft("range", bits).bitwiseOR(F.col("own").bitwiseXOR(F.col("flip.mask")))
    return rows.select(*[c for c in ranges.columns if c not in ("range", "left")], key.alias("range"), (F.col("left") - F.col("flip.cost")).alias("left"))


def _ranges(classes: DataFrame, half: int, variants: int) -> DataFrame:
    """(fp, node, range, left, depth): each fingerprint in every range of variants that it reaches with `left` flips to spare.

    Ranges have as many leading bits as make the average hold `variants`; those that hold far more, since fingerprints lie
    close, get more bits until none does. A single variant is reached by at most ball(64, half) fingerprints, so this ends.
    """

    def listed(df, n):
        return F.broadcast(df) if n <= BROADCAST_ROWS else df

    open_ = classes.select("fp", "node", F.lit(0).cast("long").alias("range"), F.lit(half).alias("left"))
    weight, depth, out = classes.count() * ball(64, half), 0, []
    while True:
        bits = min(BITS, 64 - depth, max(4, math.ceil(math.log2(max(1, weight / variants)))))
        finer = _finer(open_, depth, bits, half)
        # how many variants a range holds, from counts of the fingerprints' own leading bits
        counts = open_.groupBy("range", "left", F.shiftleft(F.shiftrightunsigned("fp", 64 - depth - bits), 64 - depth - bits).alias("fp")).agg(F.count(F.lit(1)).alias("n"))
        depth += bits
        if depth == 64:
            out.append(finer.withColumn("depth", F.lit(depth)))
            break
        size = F.element_at(F.array(*[F.lit(ball(64 - depth, f)) for f in range(half + 1)]), F.col("left") + 1)
        sizes = _finer(counts, depth - bits, bits, half).groupBy("range").agg(F.sum(F.col("n") * size).alias("size"))
        wide = checkpointed(sizes.where(F.col("size") > WIDE * variants))
        n, most = wide.agg(F.count(F.lit(1)), F.max("size")).first()
        if not n:
            out.append(finer.withColumn("depth", F.lit(depth)))
            break
        out.append(finer.join(listed(wide, n), "range", "left_anti").select(*finer.columns).withColumn("depth", F.lit(depth)))
        open_ = checkpointed(finer.join(listed(wide, n), "range", "left_semi").select(*finer.columns))
        weight = most
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


def meetings(fp: np.ndarray, base: np.ndarray, free: np.ndarray, left: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) within `radius` that connect all rows with a variant in common. A row's variants are `base` (leading bits of its
    range) with the `free` low bits of its fingerprint, of which up to `left` are flipped."""
    code = []
    for f, flips in sorted(set(zip(free.tolist(), left.tolist(), strict=True))):
        at = np.flatnonzero((free == f) & (left == flips))
        low = fp[at] & U((1 << f) - 1)
        variant = base[at][:, None] | (low[:, None] ^ masks(f, flips)[None, :])
        code.append(((vec.mix(variant) >> U(24) << U(24)) | at.astype(U)[:, None]).ravel())
    code = np.concatenate(code)
    code.sort()  # 40 bits of a variant's hash, then its row
    new = np.concatenate([[True], code[1:] >> U(24) != code[:-1] >> U(24)])
    first = np.flatnonzero(new)
    other = np.flatnonzero(~new)
    head = first[np.searchsorted(first, other, "right") - 1]
    row = (code & U((1 << 24) - 1)).astype("i8")
    i, j = row[head], row[other]
    near = np.bitwise_count(fp[i] ^ fp[j]) <= radius
    pairs = [(i[near] << 24) | j[near]]
    # where the first of a group is not near all others (a hash met another, or an odd radius), all of the group are compared
    for h in np.unique(head[~near]):
        end = int(np.searchsorted(first, h, "right"))
        own = row[h : first[end] if end < len(first) else len(row)]
        a, b = np.nonzero(np.triu(np.bitwise_count(fp[own][:, None] ^ fp[own][None, :]) <= radius, 1))
        pairs.append((own[a] << 24) | own[b])
    pairs = np.unique(np.concatenate(pairs))
    i, j = pairs >> 24, pairs & ((1 << 24) - 1)
    return i[i != j], j[i != j]


def links(classes: DataFrame, radius: int = 4, variants: int = VARIANTS) -> DataFrame:
    """Edges (a, b) that connect what links of `radius` connect. classes: (fp, node), checkpointed, each fp once."""
    half = -(-radius // 2)

    def run(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            rows = held
            if batch is not None:
                rows = [batch.column(c).to_numpy() for c in ("depth", "range", "left", "fp", "node")]
                if held is not None:
                    rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if rows is None or not len(rows[0]):
                continue
            size = np.array([[ball(64 - d, f) for f in range(half + 1)] for d in range(65)])[rows[0], rows[2]]
            ends = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
            ends = np.append(ends, len(rows[0])) if batch is None else ends
            total, start = np.concatenate([[0], np.cumsum(size)]), 0
            while start < len(rows[0]):
                later = ends[ends > start]
                enough = later[total[later] - total[start] >= variants]
                if not len(enough) and (batch is not None or not len(later)):
                    break
                end = int(enough[0] if len(enough) else later[-1])
                depth, key, left, fp, node = (x[start:end] for x in rows)
                start = end
                free = 64 - depth.astype("i8")
                base = np.where(free < 64, key.view(U) << np.minimum(free, 63).astype(U), U(0))
                i, j = meetings(fp.view(U), base, free, left, radius)
                if len(i):
                    number, root = roots(node[i], node[j])
                    out = number != root
                    yield pa.RecordBatch.from_arrays([pa.array(root[out]), pa.array(number[out])], names=["a", "b"])
            held = [x[start:] for x in rows]

    dealt = _ranges(classes, half, variants).repartition("depth", "range").sortWithinPartitions("depth", "range")
    return dealt.select("depth", "range", "left", "fp", "node").mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, k: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, fingerprint, component_id.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a shingle is k words joined by a space (all of
    them if there are fewer), repeats included; its hash is XXH64 with seed 42. Fingerprints link at `radius` or fewer
    differing bits, equal ones too; a component's id is the smallest id reachable by links, its own included.

    Null texts and texts without words have fingerprint zero, which links like any other. Ids are integers; rows of one id
    are one node; rows without an id have a fingerprint, link with nothing and have no component; an empty table gives an
    empty result; other columns are not read. Copies become one node by a combined aggregate, so they neither meet in one
    task nor add variants; no link between different fingerprints is lost, however many lie close together.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = checkpointed(fingerprints(docs, k, id_col, text_col).withColumn("run", run_of(spark)))
    named = rows.where("id is not null")
    by_run = checkpointed(named.groupBy("fp", "run").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("rows")))
    classes = checkpointed(by_run.groupBy("fp").agg(F.min("node").alias("node"), F.sum("rows").alias("rows")))
    edges = links(classes.select("fp", "node"), radius).where("a <> b")
    several = named.groupBy("id").agg(F.count_distinct("fp").alias("n")).where("n > 1")
    if several.limit(1).count():
        # rows of one id are one node: what they are equal to is connected
        held = named.join(several.select("id"), "id").select("id", "fp").distinct().join(classes, "fp")
        edges = edges.union(held.select(F.col("node").alias("a"), F.col("id").alias("b")).where("a <> b"))
    comp = components(checkpointed(edges)).withColumnRenamed("id", "node")
    # down again: from nodes to fingerprints, to the rows of one run
    classes = classes.join(comp, "node", "left").where("rows > 1 or comp <> node").select("fp", F.coalesce("comp", "node").alias("component"))
    out = rows.join(by_run.select("fp", "run").join(classes, "fp"), ["fp", "run"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return out.select(F.col("id").cast(kind).alias(id_col), digits.alias("fingerprint"), component.cast(kind).alias("component_id"))


def drop_near_copies(docs: DataFrame, k: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each component, the one with the smallest id; all columns. Rows without an id stay, and so
    do all rows that repeat an id that stays."""
    key = free_name(docs, "id")
    gone = near_copies(docs, k, radius, id_col, text_col).where(f"`{id_col}` <> component_id").select(F.col(id_col).alias(key)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(key), "left_anti")


def op12_simhash(spark, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


#: XXH64 isn't SQL; tests/llm/test_simhash.py holds the query against brute force.
SQL: dict[str, str] = {}
