"""The packing's BM25 index as it is used: every shared term counts, however common."""

import math
from collections import Counter

import numpy as np
import pytest

from salvage.llm import packing


@pytest.mark.parametrize("size", [12, 40, 300])
def test_production_index_scores_are_bm25(size):
    rng = np.random.default_rng(size)
    # A few terms in nearly every document, some in many, most in few.
    docs = [rng.zipf(1.3, rng.integers(1, 80)).clip(max=500) for _ in range(size)]
    counts = np.array([len(d) for d in docs])
    index = packing.Index(np.concatenate(docs).astype(np.uint32), counts)
    mean = counts.mean()
    df = Counter(t for d in docs for t in set(d.tolist()))
    assert max(df.values()) > size / 2
    for seed in (0, 7):
        expected = [
            sum(
                math.log1p((size - df[t] + 0.5) / (df[t] + 0.5)) * (n := (d == t).sum()) * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(d) / mean))
                for t in set(docs[seed].tolist()) if df[t] > 1
            )
            for d in docs
        ]
        assert np.allclose(index.scores(seed), expected)
