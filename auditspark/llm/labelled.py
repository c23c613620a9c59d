"""Bounded samples of labelled documents to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import in_fold


def sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int) -> DataFrame:
    """(doc_id, label, text) of at most ``per_class`` documents of label 0 and of label 1, none of them held out.

    Which ones depends on the ids alone. The sample's ids and labels are few enough to be broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull()).where(~in_fold(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = [known.where(F.col("label") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    ids = F.broadcast(chosen[0].union(chosen[1]))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, "doc_id").select("doc_id", "label", "text")
