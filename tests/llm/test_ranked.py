"""Ranked search against plain loops, on odd tables, over many shards and blocks."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from salvage.llm import ranked, treap

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items, best=10):
    counts = [Counter(terms(t)) for _, t in docs]
    n = sum(bool(c) for c in counts)
    total = sum(c.total() for c in counts)
    df = Counter(t for c in counts for t in c)
    pooled = defaultdict(set)
    for i, t in items:
        pooled[i] |= set(terms(t))
    rows = set()
    for item, own in pooled.items():
        scored = []
        for (doc_id, _), c in zip(docs, counts):
            score = 0
            for t in own & c.keys():
                m = 100 - 90 + (90 * c.total() * n) // total
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        for rank, (score, _, doc_id) in enumerate(sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:best], 1):
            rows.add((item, rank, doc_id, -score))
    return rows


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("shard_bytes, block_bytes", [(16 << 20, 4 << 20), (30_000, 300)])
def test_documents_as_by_plain_loops(spark, sf, shard_bytes, block_bytes):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    result = ranked.ranked(docs.repartition(3), items, shard_bytes=shard_bytes, block_bytes=block_bytes)
    pairs = [[(r[0], r.text) for r in df.collect()] for df in (docs, items)]
    assert found(result) == expected(*pairs)


def test_odd_tables(spark):
    texts = [
        None, "", " \n", "alpha beta", "Alpha BETA", "alpha beta", "alpha " * 40_000 + "omega", "日本語 naïve ÉCOLE école", "a-b_c.d\x00e\x7ff",
        "x" * 200_000, "12 34 alpha", "ſ K é", "beta beta beta gamma", "...", "gamma",
    ]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "gamma delta"), (2**60, "gamma delta"), (-4, "gamma delta")]
    items = [(1, "alpha"), (1, "gamma"), (2, "École 日本語 A"), (3, None), (4, "..."), (None, "delta BETA"), (5, "nothing here"), (6, "x" * 200_000), (7, "e f 34")]
    table = spark.createDataFrame([(*d, 0.5, 3, "t") for d in docs], "doc_id long, text string, score double, rank int, item_id string")
    asked = spark.createDataFrame([(*i, 9, 1) for i in items], "item_id long, text string, doc_id long, shard int")
    assert found(ranked.ranked(table.repartition(4), asked)) == expected(docs, items)
    assert found(ranked.ranked(table.repartition(4), asked, best=2, shard_bytes=20, block_bytes=1)) == expected(docs, items, 2)
    for none in (ranked.ranked(table.where("false"), asked), ranked.ranked(table, asked.where("false")), ranked.ranked(table.where("doc_id between 0 and 2"), asked)):
        assert none.count() == 0


def test_repeated_rows_are_documents_of_their_own(spark):
    docs = [(7, "alpha beta")] * 3 + [(1, "alpha beta"), (2, "other words")]
    result = ranked.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "beta")], "item_id long, text string"))
    assert [(r.rank, r.doc_id) for r in result.orderBy("rank").collect()] == [(1, 1), (2, 7), (3, 7), (4, 7)]


@pytest.mark.parametrize("n_rows, n_columns, k", [(1, 1, 1), (3, 500, 10), (400, 3, 2), (200, 300, 10), (60, 5000, 5)])
def test_search_finds_the_best_columns(n_rows, n_columns, k):
    rng = np.random.default_rng(n_rows)
    cells = np.unique(rng.integers(0, n_rows * n_columns, max(1, n_rows * n_columns // 20)))
    rows, columns = np.divmod(cells, n_columns)
    # Few different impacts, so that many scores are equal.
    impacts = rng.integers(1, 5, len(cells)) ** 3
    tree = treap.Treap(*treap.build(rows, columns, impacts, n_rows, n_columns))
    grid = np.zeros((n_rows, n_columns), np.int64)
    grid[rows, columns] = impacts
    items = [(np.sort(rng.choice(n_rows, rng.integers(0, min(30, n_rows) + 1), replace=False)), None) for _ in range(40)]
    items = [(r, rng.integers(0, 4, len(r))) for r, _ in items]
    for (r, w), top in zip(items, treap.search(tree, items, k)):
        scores = (grid[r] * w[:, None]).sum(axis=0)
        assert top == sorted((-s, c) for c, s in enumerate(scores.tolist()) if s > 0)[:k]


def test_cells_hold_the_greatest_impact_inside_them():
    rng = np.random.default_rng(1)
    cells = np.unique(rng.integers(0, 64 * 64, 300))
    rows, columns = np.divmod(cells, 64)
    impacts = rng.integers(1, 1000, len(cells))
    levels, masks, differences = treap.build(rows, columns, impacts, 64, 64)
    tree = treap.Treap(levels, masks, differences)
    starts = np.cumsum([0, *levels])
    for level, (a, b) in enumerate(zip(starts, starts[1:])):
        side = tree.height - level
        inside = {}
        for r, c, i in zip((rows << treap.SPREAD) >> side, columns >> side, impacts):
            inside[r, c] = max(inside.get((r, c), 0), i)
        assert sorted(tree.maxima[a:b].tolist()) == sorted(inside.values())
