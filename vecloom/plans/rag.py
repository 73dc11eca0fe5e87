"""From files to searchable chunks, from questions to answers, and from answers to verdicts.

Chat models and embedders are called on the executors, a batch at a time; what
they say is written to the run log by the caller, so a lost task asks again.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import text as T
from vecloom.functions.vectors import Metric
from vecloom.operators import retrieval
from vecloom.operators.codecs import Codec, fit_codec
from vecloom.sources.formats import read_documents

ANSWER_SYSTEM = "Use the numbered passages and nothing else. Name those you used as [n]. If none of them answers the question, say that."
JUDGE_SYSTEM = 'Grade the system answer. Reply with JSON: {"correct": true, false or null without gold answers, "faithful": true or false, "reason": "..."}.'


def chunked(documents: DataFrame, size: int, overlap: int) -> DataFrame:
    """vec_id, doc, source, ordinal, text of every chunk of documents(source, text)."""
    rows = documents.select("source", F.posexplode(T.chunks(F.col("text"), size, overlap)).alias("ordinal", "text"))
    return rows.select(F.xxhash64("source", "ordinal").alias("vec_id"), T.doc_id(F.col("source")).alias("doc"), "source", F.col("ordinal").cast("long").alias("ordinal"), "text")


def embedded(df: DataFrame, text_col: str, embed, out_col: str = "embedding") -> DataFrame:
    """df with a vector for each text, through embed(list of texts) -> list of vectors."""
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            vectors = embed([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float32()))], names=[*batch.schema.names, out_col])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out_col, ArrayType(FloatType()))]))


def ingest(spark: SparkSession, paths: list[str], extensions: list[str], embed, dim: int, codec: str = "f32", size: int = 200, overlap: int = 40, prefix: str = "") -> tuple[DataFrame, Codec]:
    """Files below paths as chunks with their vectors, and the codec fitted on all of them: what Catalog.insert_chunks takes."""
    from vecloom.sources.embedding import prefixed

    rows = chunked(read_documents(spark, paths, extensions), size, overlap).withColumn("sent", prefixed(F.col("text"), prefix))
    rows = embedded(rows, "sent", embed).drop("sent")
    return rows, fit_codec(codec, rows, dim)


def with_context(questions: DataFrame, chunks: DataFrame, k: int, metric: Metric, codec: Codec | None = None, payload=lambda passage, question: passage) -> DataFrame:
    """questions(qid, question, vector, exclude, ...) with hits, an array of (rank, vec_id, source, ordinal, text) best first, and their prompt.

    payload: what a passage becomes on its way into the prompt, as a Column of passage and question.
    """
    top = retrieval.top_k(chunks, questions.select("qid", "vector", "exclude"), k, metric, codec)
    found = retrieval.hits(top, chunks, ["source", "ordinal", "text"]).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "source", "ordinal", "text"))).alias("hits"))
    rows = questions.join(found, "qid", "left")
    hits = F.coalesce("hits", F.array().cast(found.schema["hits"].dataType))
    sent = F.transform(hits, lambda h: F.struct(h["source"].alias("source"), h["ordinal"].alias("ordinal"), payload(h["text"], F.col("question")).alias("text")))
    return rows.withColumn("hits", hits).withColumn("prompt", T.user_prompt(sent, F.col("question")))


def completed(rows: DataFrame, chat, system: str, prompt_col: str = "prompt") -> DataFrame:
    """rows with response, served_model, input_tokens, output_tokens and error (of which response or error is null)."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    at = rows.columns.index(prompt_col)
    added = [("response", StringType(), pa.string()), ("served_model", StringType(), pa.string()), ("input_tokens", LongType(), pa.int64()), ("output_tokens", LongType(), pa.int64()), ("error", StringType(), pa.string())]

    def one(prompt):
        try:
            r = chat.complete(system, prompt)
            return r["text"], r["model"], r["input_tokens"], r["output_tokens"], None
        except (OSError, ValueError, KeyError) as e:
            return None, None, 0, 0, f"{type(e).__name__}: {e}"

    def run(batches):
        for batch in batches:
            said = [one(p) for p in batch.column(at).to_pylist()]
            columns = zip(*said) if said else [[] for _ in added]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, kind) for c, (_, _, kind) in zip(columns, added)]], names=[*batch.schema.names, *[n for n, *_ in added]])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *[StructField(n, kind) for n, kind, _ in added]]))


def bench_rows(answered: DataFrame, batch: str, question_set: str, collection: str, embed_model: str, codec: str, chat_model: str, created_at: Column | None = None) -> DataFrame:
    """Run-log rows of answered questions(qid, question, answers, source, hits, and what completed() adds)."""
    exact, contains = T.score_answer(F.col("response"), F.col("answers"))
    sources = F.transform("hits", lambda h: h["source"])
    metadata = F.to_json(F.struct(F.lit(batch).alias("batch"), F.lit(question_set).alias("question_set"), F.col("qid").cast("string").alias("question_id"), "answers", F.col("served_model").alias("chat_model_served"), "error"))
    hit = F.when(F.col("source").isNotNull(), F.exists(sources, lambda s: F.contains(F.lower(s), F.lower(F.col("source")))))
    metrics = F.to_json(F.struct(exact.alias("exact"), contains.alias("contains"), hit.alias("source_hit"), "input_tokens", "output_tokens"))
    return answered.select(
        F.sha2(F.concat_ws("/", F.lit(batch), F.lit(codec), F.lit(chat_model), F.col("qid").cast("string")), 256).alias("id"), F.lit("bench").alias("kind"),
        (F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") if created_at is None else created_at).alias("created_at"), F.lit(None).cast("string").alias("session"),
        F.lit(collection).alias("collection"), F.lit(embed_model).alias("embed_model"), F.lit(codec).alias("codec"), F.lit(chat_model).alias("chat_model"), "prompt", "response", metadata.alias("metadata"), metrics.alias("metrics"),
    )


def judge_rows(targets: DataFrame, judge, batch: str, created_at: Column | None = None) -> DataFrame:
    """Run-log rows of verdicts on targets (rows of the log, whose prompt holds question and passages); unreadable replies give none."""
    gold = F.coalesce(F.from_json(F.get_json_object("metadata", "$.answers"), "array<string>"), F.array().cast("array<string>"))
    asked = targets.select(F.col("id").alias("run_id"), "collection", "embed_model", "codec", T.judge_prompt(F.regexp_extract("prompt", r"(?s)Question: (.*)$", 1), gold, F.array("prompt"), F.col("response")).alias("prompt"))
    said = completed(asked, judge, JUDGE_SYSTEM).withColumn("v", T.parse_verdict(F.col("response"))).where("v.valid")
    return said.select(
        F.sha2(F.concat_ws("/", F.lit("judge"), F.lit(batch), "run_id"), 256).alias("id"), F.lit("judge").alias("kind"),
        (F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") if created_at is None else created_at).alias("created_at"), F.lit(None).cast("string").alias("session"),
        "collection", "embed_model", "codec", F.col("served_model").alias("chat_model"), "prompt", "response",
        F.to_json(F.struct("run_id", F.lit(batch).alias("batch"))).alias("metadata"), F.to_json(F.struct("v.correct", "v.faithful", "v.reason")).alias("metrics"),
    )


class WordJudge:
    """A judge without a model: an answer is correct if it holds a gold answer, faithful if a passage holds it."""

    name = "words"

    def complete(self, system: str, user: str) -> dict:
        body, _, answer = user.rpartition("\n\nSystem answer: ")
        answer = answer.removesuffix("\n\nReply with the JSON object only.")
        golds = json.loads("[" + body.rpartition("\nGold answers: ")[2] + "]") if "(none; output null" not in body.rpartition("\nGold answers: ")[2] else []
        said = {"correct": any(g.lower() in answer.lower() for g in golds) if golds else None, "faithful": answer in body.rpartition("\nGold answers: ")[0], "reason": "words"}
        return {"text": json.dumps(said), "model": self.name, "input_tokens": len(user.split()), "output_tokens": 1}
