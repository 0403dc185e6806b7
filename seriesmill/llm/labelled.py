"""The bounded sample of labelled documents that classifiers learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a classifier learns from, at most.
MAX_TRAIN = 20_000


def fold_of(id_col: str | Column = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0 (held out)."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % folds, F.lit(0))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, label (0 or 1) of up to ``max_train`` labelled documents outside fold 0.

    Which ones is fixed by a hash of the id.  Only their ids and labels, at most ``max_train``, are broadcast;
    no text is shuffled.  Null labels and ids don't count; of several labels the largest does.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold_of("doc_id") != 0))
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    )
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")
