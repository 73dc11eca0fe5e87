"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import oracles
from vecloom.session import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.substring import substring_dedup

    kept = substring_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.bpe import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.warc import dedup_archive

    return dedup_archive(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.lines import line_classes

    return line_classes(table(spark, sf_dir, "documents")).drop("row_key")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.katz import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings")).drop("query_row")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.bpe import encode_decode

    coded = encode_decode(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", "n_tokens", F.sha2(F.encode("ids_text", "UTF-8"), 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.decontam import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries():
    return {f.__name__: f for f in (op1_substring_dedup, op2_token_counts, op3_minhash_dedup, op4_quality, op5_warc, op6_line_dedup, op7_lm_score, op8_ann, op9_bpe, op10_decontam)}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": oracles.OP1, "op3_minhash_dedup": oracles.OP3, "op5_warc": oracles.OP5}
