"""Five stages from raw documents to token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each result as Parquet in the shared folder and rereads it as the next one's
docs. All but the last return the columns of documents.

1. quality: documents that the classifier rejects (score below 0.5) go.
2. line_dedup: lines kept elsewhere go; every document stays, if need be empty.
3. near_dedup: of each class of near copies the first document stays.
4. decontamination: documents in which a benchmark item is found go.
5. tokens: each document's ids and decoded text, as digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import bpe, decontam, lines, minhash, quality
from vecloom.llm.store import dropped, written
from vecloom.session import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.reject_low_quality(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.without_repeats(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(docs)
    return coded.select("doc_id", "n_tokens", F.sha2(F.encode("ids_text", "UTF-8"), 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("tokens", tokens_stage),
]

#: SQL expresses neither a trained classifier nor a vocabulary's merges; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        dropped(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
