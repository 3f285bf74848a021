import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.llm import vec

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="aAbBé \t\n\x0b\x1f", max_size=30)), max_size=8)


def brute(text, k):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] * bool(w)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 5), st.integers(0, 3))
def test_sets_against_brute_force(texts, k, skip):
    seen = {}
    array = pa.array(texts, pa.string())[min(skip, len(texts)) :]
    got = list(vec.sets(array, k))
    assert len(got) == len(array)
    for t, values in zip(array.to_pylist(), got, strict=True):
        want = set(brute(t, k))
        assert len(want) == len(values) and np.all(values[1:] > values[:-1])
        key = frozenset(want)
        assert seen.setdefault(key, values.tolist()) == values.tolist()
    assert len({tuple(v) for v in seen.values()}) == len(seen)


def test_slices_split_between_texts(monkeypatch):
    texts = [f"t{i} " * (i % 50) for i in range(300)]
    whole = [v.tolist() for v in vec.sets(pa.array(texts), 3)]
    monkeypatch.setattr(vec, "SLICE_BYTES", 50)
    assert [v.tolist() for v in vec.sets(pa.array(texts), 3)] == whole


def test_powers_for_a_long_text_are_not_kept():
    import gc

    long = "word " * 400_000
    gc.collect()
    vec.give_back()
    before = resident()
    assert next(vec.words(pa.array([long])))[1].tolist() == next(vec.words(pa.array(["word"])))[1].tolist() * 400_000
    gc.collect()
    vec.give_back()
    assert resident() - before < 20_000_000


def resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_parts_copy_no_texts():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 20_000 + [None, ""])], names=["text"])
    pool, usual = pa.proxy_memory_pool(pa.default_memory_pool()), pa.default_memory_pool()
    pa.set_memory_pool(pool)
    try:
        got = list(vec.parts([batch], 0, 1_000_000))
    finally:
        pa.set_memory_pool(usual)
    assert sum(b.num_rows for b in got) == batch.num_rows and all(b.num_rows <= 1002 for b in got)
    assert pool.max_memory() < 1_000_000
