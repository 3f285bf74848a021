import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import ODD
from webloom.llm import lm
from webloom.llm.lm import _narrow, _pack, _unpack, _wide, score_documents


def brute(rows, order):
    """Scores by the counts of all other rows."""
    docs = [re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    own = [Counter(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)) for w in docs]
    whole = sum(own, Counter())
    size = sum(map(len, docs))
    out = []
    for (doc, _), w, mine in zip(rows, docs, own, strict=True):
        total = 0.0
        for i in range(len(w)):
            factor = 1.0
            for k in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - k + 1 : i + 1])
                n = whole[g] - mine[g]
                if k == 1:
                    total += math.log(factor * max(n, 1) / size)
                elif n > 0:
                    total += math.log(factor * n / (whole[g[:-1]] - mine[g[:-1]]))
                    break
                factor *= lm.BACKOFF
        out.append((doc, len(w), round(total, 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force(spark, order, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 900)
    rng = random.Random(order)
    rows = [(i, " ".join(f"w{min(int(rng.expovariate(0.1)), 60)}" for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(40)] + [(None, "w1 w2 w3"), (7, "w1 W2 w3"), (8, None)]
    for parts in (1, 6):
        got = score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), order).collect()
        assert sorted(((r.doc_id, r.n_words, round(r.log_score, 6)) for r in got), key=repr) == brute(rows, order)


def test_packing_of_keys():
    rng = np.random.default_rng(1)
    for n in (1, 5, 1000):
        keys = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64) + np.uint64(7 << 60))
        assert (_unpack(_pack(keys, 7 << 60), 7 << 60) == keys).all()


def test_packing_of_counts():
    for n in ([], [0, 1, 254], [255, 3, 256, 1 << 40, 0]):
        assert _wide(_narrow(np.array(n, "i8")), len(n)).tolist() == n


def test_odd_rows(spark, odd, none):
    rows = score_documents(odd).collect()
    assert sorted(((r.doc_id, r.n_words, round(r.log_score, 6)) for r in rows), key=repr) == brute([r[:2] for r in ODD], 3)
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in rows)
    assert score_documents(none).count() == 0


def test_packed_keys_come_back_and_take_less_than_whole_bytes():
    rng = np.random.default_rng(1)
    for n, bits in ((0, 9), (1, 9), (2000, 9), (100_000, 4)):
        base = 5 << (64 - bits)
        keys = np.unique(rng.integers(0, 1 << (64 - bits), n, dtype=np.uint64)) + np.uint64(base)
        data = lm._pack(keys, base)
        assert lm._unpack(data, base).tolist() == keys.tolist()
        if n > 1:
            assert len(data) < 0.96 * (1 + len(keys) * data[0])
