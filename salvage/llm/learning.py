"""Labelled rows for the classifiers: a bounded sample, split by a checksum of the id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salvage.llm.common import documents, fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, longest: int | None = None) -> DataFrame:
    """``doc_id, text, label`` of at most ``most`` labelled documents outside the held-out fold (remainder 0).

    Half of the places go to each label value, in the order of a hash of the id, so the choice is the same in every run. Null
    labels and ids teach nothing; an id with several labels has the largest. ``longest`` leaves texts of
    more characters to the scoring alone. The sample is joined from the side of its bounded list of ids.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    usable = usable.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc_id")) != 0))
    usable = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = documents(docs)
    if longest is not None:
        texts = texts.where(F.length("text") <= longest)
        usable = usable.join(texts.select("doc_id"), "doc_id", "left_semi")
    order = F.xxhash64("doc_id")
    chosen = [usable.where(F.col("label") == v).orderBy(order, "doc_id").limit(most // 2) for v in (0, 1)]
    # At most ``most`` rows of two numbers.
    return texts.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")


def label_share(labels: DataFrame, label: str) -> float:
    """The share of ones among all labels outside the held-out fold; one half without any."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    share = usable.agg(F.avg(F.col(label).cast("double"))).first()[0]
    return 0.5 if share is None else share
