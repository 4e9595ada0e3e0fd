"""The query of exact dedup on rows that an id does not tell apart."""

import hashlib

from salvage.llm.queries import QUERIES


def test_rows_without_id_and_repeated_ids_have_their_own_digest(spark, tmp_path):
    rows = [(None, "a b"), (None, "alone"), (1, "ab"), (2, "first text"), (2, "second"), (3, "third"), (3, "third one"), (4, "first text")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.doc_id, r.text_sha256) for r in QUERIES["op1_exact_dedup"](spark, str(tmp_path)).collect()]
    want = [(i, hashlib.sha256(t.replace(" ", "").encode()).hexdigest()) for i, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
