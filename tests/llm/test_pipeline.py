"""The pipeline's stages against brute force, and the registered queries."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import compare  # noqa: E402
import corpus_pipeline  # noqa: E402

from salvage.llm import quality, simhash, toxicity  # noqa: E402
from salvage.llm.queries import ORACLES, QUERIES  # noqa: E402


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_stages_keep_what_they_should(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        if name == "quality classifier":
            rejected = quality.scored(docs, quality.fitted(docs, labels)).where("predicted = 0")
            assert kept == set(before) - {r.doc_id for r in rejected.collect()}
        elif name == "toxicity":
            rejected = toxicity.scored(docs, toxicity.fitted(docs, labels)).where("predicted = 1")
            assert kept == set(before) - {r.doc_id for r in rejected.collect()}
        elif name == "exact dedup":
            best = {}
            for i, text in before.items():
                bare = re.sub(r"[\x20\x09-\x0D]", "", text)
                best[bare] = min(best.get(bare, (1, 0)), (-len(text), i))
            assert kept == {i for _, i in best.values()}
        elif name == "simhash near-dedup":
            marks = {i: simhash.fingerprint(t) & (2**64 - 1) for i, t in before.items()}
            assert kept == set(roots(marks, [(a, b) for a in marks for b in marks if a < b and (marks[a] ^ marks[b]).bit_count() <= 4]).values())
        else:
            assert kept == set(before)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == list(corpus_pipeline.COLUMNS)
        docs = after


def test_registered_queries(spark):
    import __spark_entry__ as entry

    assert entry.queries().keys() >= QUERIES.keys()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES} - {"pipeline"}
    assert ORACLES.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, sf, name, monkeypatch):
    monkeypatch.setattr(compare, "QUERIES", QUERIES)
    monkeypatch.setattr(compare, "ORACLES", ORACLES)
    assert compare.difference(spark, name, sf) is None


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
