"""From raw documents to an encoded mix: drop toxic documents, exact and near copies, mix the sources, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seriesmill.llm import bpe, exact_dedup, jaccard, mixing, toxicity
from seriesmill.llm.common import table, written
from seriesmill.llm.queries import BPE_RANKS, PATTERN


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score as clean, with all columns; null and empty texts have no match and stay; repeated rows all stay or go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null equals empty) the row with the largest id; rows of null ids stay if all of the group have none."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the least id; texts without words and rows with a null id stay."""
    return jaccard.one_of_each(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it, 0 to 3 times; a null source is one of its own, texts without words go."""
    return mixing.repeat(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of digests per row; a null text has no tokens, repeated rows give repeated results."""
    return bpe.round_trip(docs, BPE_RANKS, PATTERN)


#: Each takes and returns documents, but for the last: doc_id, n_tokens, ids_sha256, decoded_sha256.
STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The toxicity model and the encoder can't be put in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again by the next.

    The jobs of all stages but the last run before this returns.  An empty table gives an empty result.  When the
    result is stored, ``seriesmill.llm.common.discard(spark)`` deletes what the stages have written.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
