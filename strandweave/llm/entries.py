"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandweave.session import ship, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandweave.llm.mixing import taken

    return taken(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandweave.llm import quality

    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandweave.llm import bpe, vocab

    return bpe.digests(table(spark, sf_dir, "documents"), vocab.path_of(vocab.WORD_BPE))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandweave.llm.exact_dedup import exact_classes

    return exact_classes(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandweave.llm import token_count, vocab

    return token_count.token_counts(table(spark, sf_dir, "documents"), vocab.path_of(vocab.WORD_BPE))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandweave.llm import lm_score, vocab

    return lm_score.lm_scores(table(spark, sf_dir, "documents"), vocab.path_of(vocab.PIECES))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandweave.llm.fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandweave.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandweave.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandweave.llm.passage_dedup import repeats

    return repeats(table(spark, sf_dir, "documents"))


def _shipped(query: Query) -> Query:
    return lambda spark, sf_dir: query(ship(spark), sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: _shipped(f) for f in (op1_mixing, op2_quality, op3_bpe, op4_exact_dedup, op5_token_counts, op6_lm_scores, op7_fingerprints, op8_html_extraction, op9_minhash_near_dedup, op10_passage_dedup)}


OP1 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, source::BLOB) - 1) % 3 + 1)::INT] AS w,
         source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM sources
), levelled AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source::BLOB ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(w) OVER (ORDER BY cap / w, source IS NULL, source::BLOB ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), free AS (
  SELECT arg_min(level, cap / w) AS level FROM levelled WHERE cap > level * w
), targets AS (
  SELECT source, source_size, CASE WHEN cap <= level * w THEN cap ELSE (SELECT level FROM free) * w END AS target FROM levelled
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0 END AS rate FROM targets
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source
"""

OP4 = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1, "op4_exact_dedup": OP4}
