"""A training-data pipeline over `documents`: quality, exact dedup, near dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir), with docs what the stage before it kept, and returns a DataFrame with the columns
of documents; the last one adds the encoding. Stages are cut from each other by Parquet in the shared folder.

Every stage: an empty table gives an empty table; a null text counts as empty; of rows with a null doc_id near dedup and
mixing keep each; repeated rows are separate rows until exact dedup leaves one of them, then as often as the mix takes
them; texts of any length are read whole; columns that documents have beside the usual ones are carried, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandweave.llm import bpe, exact_dedup, mixing, near_dedup, quality, vocab
from strandweave.session import cut, ship, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts (score of 0.7 or more)."""
    ship(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts: that of the largest doc_id."""
    return exact_dedup.exact_unique(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard similarity of 0.8 or more over five-word shingles)."""
    ship(spark)
    kept = near_dedup.near_duplicates(docs, percent=80).where("kept").select("doc_id").distinct()
    # Rows without an id have no links and stay.
    return docs.join(kept, docs["doc_id"] == kept["doc_id"], "left_semi").union(docs.where("doc_id is null"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.emit(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with n_tokens, ids and the digests of ids and of the decoded text."""
    return bpe.encode(docs, vocab.path_of(vocab.WORD_BPE))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe", encoding_stage),
]

#: Training, near links and encoding are beyond SQL; tests hold the stages against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents to encoded documents."""
    docs = table(ship(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
