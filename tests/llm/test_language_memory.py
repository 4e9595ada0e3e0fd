"""What a bucket of the language model takes beside its texts."""

import tracemalloc

import numpy as np
import pyarrow as pa

from salvage.llm import language


def peak(work):
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_bucket_is_turned_into_numbers_in_parts():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 500, 400)) for _ in range(2600)] + ["", "é x"]
    table = pa.table({"doc_id": np.arange(len(texts)), "text": texts, "held_out": [i % 5 == 1 for i in range(len(texts))]})
    size = sum(len(t.encode()) for t in texts)
    (codes, sizes), most = peak(lambda: language.grams(table.column("text").chunk(0)))
    assert most < 21 * size and sizes.tolist() == [len(t.encode()) + 1 for t in texts]
    (keys, counts, words, times), most = peak(lambda: language._bucket_counts(table, language.ORDER))
    assert most < 15 * size and size > 2 * language._AT_ONCE
    learnt = np.repeat(~table.column("held_out").to_numpy(), sizes)
    different, which = np.unique(codes, return_inverse=True)
    assert keys.tolist() == different.tolist() and counts.tolist() == np.bincount(which, learnt).tolist()
    said = dict(zip(words.to_pylist(), times))
    assert said[""] == (~table.column("held_out").to_numpy()).sum() and set(said) == {w for t in texts for w in t.split()} | {""}
