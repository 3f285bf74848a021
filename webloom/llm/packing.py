"""Best-fit packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import vec
from webloom.llm.bestfit import pack
from webloom.llm.common import checkpointed, ranked, table

SEQUENCE = 1024
END_ID = 2

#: Texts of these characters alone are encoded from the vocabulary's rank file, several times faster and with the same ids
#: (tested); any other text goes through the tokenizers library itself.
PLAIN = re.compile("[\t-\r\x20-\x7e\xa1-\xac\xae-ſ‐-‧‰-⁞€]*")


@functools.cache
def _library(vocabulary: str, special_as_text: bool):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(vocabulary)
    found.encode_special_tokens = special_as_text
    return found


@functools.cache
def _ranks(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def special_tokens(vocabulary: str) -> tuple[str, ...]:
    """The strings that the library takes for special tokens wherever a text holds them."""
    with open(vocabulary, encoding="utf-8") as file:
        return tuple(t["content"] for t in json.load(file).get("added_tokens", []))


def encode(text: str, vocabulary: str, ranks: str | None = None, special: tuple[str, ...] | None = None, special_as_text: bool = False) -> np.ndarray:
    """The ids of the tokenizers library for `text` with add_special_tokens=False, as unsigned 32-bit integers.

    special: what special_tokens() says, for the caller to read once. A string of a special token in a text has that token's
    id, unless special_as_text. A worker loads the encoders that its texts need, one of them as a rule.
    """
    if ranks is not None and PLAIN.fullmatch(text):
        if special is None:
            special = special_tokens(vocabulary)
        if special_as_text or not any(s in text for s in special):
            return np.asarray(_ranks(ranks).encode_ordinary(text), dtype="<u4")
    return np.asarray(_library(vocabulary, special_as_text).encode(text, add_special_tokens=False).ids, dtype="<u4")


def pieces(docs: DataFrame, vocabulary: str, ranks: str | None, length: int, end_id: int, ids: bool, id_col: str, text_col: str, special_as_text: bool = False) -> DataFrame:
    """One row per piece of a document: id, piece, start, length, ids_crc32 and, if asked for, the ids themselves."""
    special = special_tokens(vocabulary)
    fields = [("id", docs.schema[id_col].dataType.simpleString()), ("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long")]
    fields += [("ids", "array<long>")] * ids
    arrow = {"id": None, "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.list_(pa.int64())}

    def cut(batches):
        for batch in vec.parts(batches, 1, vec.PART_BYTES):
            out = {name: [] for name, _ in fields}
            keys = batch.column(0)
            for row, text in enumerate(batch.column(1)):
                found = np.append(encode(text.as_py() or "", vocabulary, ranks, special, special_as_text), np.uint32(end_id))
                start, piece = 0, 0
                while start < len(found):
                    take = (len(found) - start) % length or length
                    part = found[start : start + take]
                    out["id"].append(row)
                    out["piece"].append(piece)
                    out["start"].append(start)
                    out["length"].append(take)
                    out["ids_crc32"].append(zlib.crc32(part.tobytes()))
                    if ids:
                        out["ids"].append(part.astype("i8"))
                    start, piece = start + take, piece + 1
            columns = [keys.take(pa.array(out["id"], pa.int64()))] + [pa.array(out[name], arrow[name]) for name, _ in fields[1:]]
            yield pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(cut, ", ".join(f"{name} {kind}" for name, kind in fields))


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    ranks: str | None = None,
    length: int = SEQUENCE,
    end_id: int = END_ID,
    ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
    special_as_text: bool = False,
) -> DataFrame:
    """Packs all documents into sequences of at most `length` ids by best-fit decreasing.

    A document is the ids of its text (null: none) and `end_id`; only longer ones are cut, into pieces of `length` of
    which the first may be shorter. Returns per piece: id, piece, start, length, ids_crc32, sequence_id, offset and,
    with `ids`, the ids. Pieces of one length are interchangeable: the plan is made from the histogram of lengths (at
    most `length` rows), and a piece finds its place from its rank within its length. Null ids stay null; repeated
    rows are packed each; an empty table gives an empty result; other columns are not read. The string of a special token
    in a text has that token's id, as the library gives it; with special_as_text it is ordinary text.
    """
    cut = checkpointed(pieces(docs, vocabulary, ranks, length, end_id, ids, id_col, text_col, special_as_text).withColumn("uid", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = sorted(pack(counts, length), key=lambda r: (r.size, r.first))
    size, first, start, per_bin, offset = (np.array([getattr(r, k) for r in runs], dtype="i8") for k in ("size", "first", "bin", "per_bin", "offset"))
    slots = np.array([r.size * (1 << 44) + r.first for r in runs], dtype="i8")
    numbered = ranked(cut, "length", "uid", ["uid"], "rank").drop("uid")
    names = [c for c in numbered.columns if c != "rank"]
    schema = ", ".join(f"`{c}` {numbered.schema[c].dataType.simpleString()}" for c in names) + ", sequence_id long, `offset` long"

    def place(batches):
        for batch in batches:
            rank = batch.column("rank").to_numpy().astype("i8")
            at = np.searchsorted(slots, batch.column("length").to_numpy() * (1 << 44) + rank, side="right") - 1
            nth = rank - first[at]
            sequence = start[at] + nth // per_bin[at]
            inside = offset[at] + nth % per_bin[at] * size[at]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(sequence), pa.array(inside)], names=[*names, "sequence_id", "offset"])

    return numbered.mapInArrow(place, schema).withColumnRenamed("id", id_col)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    packed = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


SQL: dict[str, str] = {}
