import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import ODD
from webloom.llm.packing import encode, op2_packing, pack_documents

VOCABULARY, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize(
    "text",
    ["", " ", "\n\n  x\t\ty \n", "don't we'll I'M 12,000.50%%% ###", "Éauxç ößü ñández ¿qué? “quoted” – dash… €5", "a b c", "日本語 text 😀", "x" * 3000, "<|endoftext|> \r\n\x0b\x0c", "naïve_snake__case  123abć ½²"],
)
def test_ids_are_those_of_the_library(text):
    same_ids(text)


def same_ids(text):
    plain = Tokenizer.from_file(VOCABULARY)
    assert encode(text, VOCABULARY, RANKS).tolist() == plain.encode(text, add_special_tokens=False).ids
    plain.encode_special_tokens = True
    assert encode(text, VOCABULARY, RANKS, special_as_text=True).tolist() == plain.encode(text, add_special_tokens=False).ids


#: Pieces of text that pre-tokenisers treat differently, and any characters.
PARTS = st.sampled_from(["'s", "'LL", " '", "<|endoftext|>", "<|", "\r\n", "  ", "\t", "\x0b\x0c\x1c\x85", "12", "½²", "ſ", "Å", "…", "\u2003", "—", "a", "B", "ß", "__", "日", "😀"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS | st.text(st.characters(max_codepoint=0x2100, exclude_categories=["Cs"]), max_size=4), max_size=12).map("".join))
def test_fuzzed_ids(text):
    same_ids(text)


def best_fit_decreasing(sizes, capacity):
    """Bins that item-by-item best-fit decreasing opens."""
    bins = []
    for size in sorted(sizes, reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= size]
        if fits:
            bins[min(fits, key=lambda b: bins[b])] -= size
        else:
            bins.append(capacity - size)
    return len(bins)


def test_whole_query(spark):
    """Every piece of the table against the library and item-by-item packing."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plain = Tokenizer.from_file(VOCABULARY)
    want, sizes = set(), []
    for d in docs.select("doc_id", "text").collect():
        found = [*plain.encode(d.text or "", add_special_tokens=False).ids, 2]
        start, piece = 0, 0
        while start < len(found):
            take = (len(found) - start) % 1024 or 1024
            want.add((d.doc_id, piece, start, take, zlib.crc32(np.array(found[start : start + take], "<u4").tobytes())))
            sizes.append(take)
            start, piece = start + take, piece + 1
    rows = op2_packing(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(want) and {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for items in sequences.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(sequences) == best_fit_decreasing(sizes, 1024)


def test_round_trip(odd, none):
    rows = pack_documents(odd, VOCABULARY, RANKS, length=64).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.length == len(r.ids) <= 64 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    for i, t, _ in ODD:
        if i not in (7, None):
            parts = sorted(docs[i], key=lambda r: r.piece)
            assert [p.start for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
            assert sum((p.ids for p in parts), []) == [*encode(t or "", VOCABULARY).tolist(), 2]
            assert all(p.length == 64 for p in parts[1:])
    for items in sequences.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= 64
    assert pack_documents(none, VOCABULARY, RANKS).count() == 0
