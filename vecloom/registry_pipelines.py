"""Queries that go through files and through whole pipelines: written in the shared folder, read back, and held against SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vecloom.functions import text as T
from vecloom.functions.vectors import Metric
from vecloom.operators import runs
from vecloom.plans import rag
from vecloom.registry import _E, _Q, collection, cosine_sql, query, self_queries
from vecloom.session import shared_folder, table
from vecloom.sources import formats
from vecloom.sources.embedding import MockChat, hash_embed

_W = "list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')"


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id::VARCHAR AS _id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS title, md5(text) AS text_md5 FROM documents")
def source_corpus(spark, d):
    """Documents as JSON lines, read back; a third of them without a title."""
    path = _place(spark, "corpus")
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("_id"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("title"), "text")
    rows.write.json(path)
    return formats.read_corpus(spark, path).select("_id", "title", F.md5("text").alias("text_md5"))


@query("SELECT lang AS query_id, list(doc_id::VARCHAR ORDER BY doc_id::VARCHAR) AS relevant FROM documents JOIN labels USING (doc_id) WHERE quality > 0 GROUP BY lang")
def source_qrels(spark, d):
    """Judgments as a TSV with a header line, read back."""
    path = _place(spark, "qrels")
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    rows.select(F.col("lang").alias("query-id"), F.col("doc_id").alias("corpus-id"), F.col("quality").alias("score")).write.csv(path, sep="\t", header=True)
    return formats.read_qrels(spark, path)


@query("SELECT item_id::VARCHAR AS id, text AS claim, CASE item_id % 4 WHEN 0 THEN 'SUPPORT' WHEN 2 THEN 'CONTRADICT' END AS label FROM benchmark")
def source_claims(spark, d):
    """Claims with evidence that agrees, disagrees or is missing, as JSON lines, read back."""
    path = _place(spark, "claims")
    label = [F.lit(x) for x in ("SUPPORT", "CONTRADICT")]
    agree = F.array(F.struct(F.when(F.col("item_id") % 4 == 0, label[0]).otherwise(label[1]).alias("label")))
    apart = F.create_map(F.lit("1"), F.array(F.struct(label[0].alias("label"))), F.lit("2"), F.array(F.struct(label[1].alias("label"))))
    evidence = F.when(F.col("item_id") % 4 == 3, apart).when(F.col("item_id") % 2 == 0, F.create_map(F.lit("7"), agree, F.lit("8"), agree))
    table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("claim"), evidence.alias("evidence")).write.option("ignoreNullFields", "true").json(path)
    return formats.read_claims(spark, path)


@query(
    "SELECT item_id::VARCHAR AS id, text AS question, CASE WHEN item_id % 2 = 0 THEN 'about ' || item_id ELSE text END AS searched, CASE WHEN item_id % 3 = 0 THEN ['yes', 'item ' || item_id] ELSE []::VARCHAR[] END AS answers, "
    "CASE WHEN item_id % 5 = 0 THEN ['d1', 'd2'] ELSE []::VARCHAR[] END AS relevant FROM benchmark"
)
def source_questions(spark, d):
    """A question set written, with its empty fields left out, and read back."""
    path, i, none = _place(spark, "questions"), F.col("item_id"), F.array().cast("array<string>")
    rows = table(spark, d, "benchmark").select(
        i.cast("string").alias("id"), F.col("text").alias("question"), F.when(i % 2 == 0, F.concat(F.lit("about "), i.cast("string"))).alias("query"),
        F.when(i % 3 == 0, F.array(F.lit("yes"), F.concat(F.lit("item "), i.cast("string")))).otherwise(none).alias("answers"), F.lit(None).cast("string").alias("source"), F.when(i % 5 == 0, F.array(F.lit("d1"), F.lit("d2"))).otherwise(none).alias("relevant"),
    )
    formats.write_questions(rows, path)
    return formats.read_questions(spark, path).select("id", "question", formats.retrieval_text().alias("searched"), "answers", "relevant")


@query("SELECT conv_id || '-' || turn AS id, CASE WHEN role = 'assistant' THEN text END AS write, CASE WHEN role <> 'assistant' THEN text END AS ask FROM conversations")
def source_memory_script(spark, d):
    """Conversations as the steps of a script, after a comment line, read back."""
    path = _place(spark, "script")
    c = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.when(F.col("role") == "assistant", F.col("text")).alias("write"), F.when(F.col("role") != "assistant", F.col("text")).alias("ask"))
    c.select(F.concat(F.lit("# a step\n\n"), F.to_json(F.struct("id", "write", "ask"))).alias("value")).write.text(path)
    return formats.read_memory_script(spark, path).select("id", "write", "ask")


@query("WITH l AS (SELECT unnest(string_split(text, chr(10))) AS l FROM benchmark) SELECT trim(l) AS query, count(*) AS n FROM l WHERE trim(l) <> '' GROUP BY 1")
def source_query_lines(spark, d):
    """Lines of texts as queries, with white space around them and blank lines between, read back."""
    path = _place(spark, "queries")
    table(spark, d, "benchmark").select(F.concat(F.lit(" \t"), "text", F.lit(" \n\n")).alias("value")).write.text(path)
    return formats.read_query_lines(spark, path).groupBy("query").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT 'corpus' AS part, doc_id::VARCHAR AS a, lang AS b FROM documents UNION ALL SELECT 'queries', item_id::VARCHAR, md5(text) FROM benchmark "
    "UNION ALL SELECT 'qrels', lang, array_to_string(list(doc_id::VARCHAR ORDER BY doc_id::VARCHAR), ',') FROM documents GROUP BY lang"
)
def source_converted_benchmark(spark, d):
    """Parquet tables of a retrieval benchmark as corpus and query lines and judgments, read back."""
    path, docs = _place(spark, "coir"), table(spark, d, "documents")
    corpus = docs.select(F.col("doc_id").alias("_id"), F.col("lang").alias("title"), "text")
    judged = docs.select(F.col("lang").alias("query-id"), F.col("doc_id").alias("corpus-id"), F.lit(1).alias("score"))
    formats.coir_to_beir(corpus, table(spark, d, "benchmark").select(F.col("item_id").alias("_id"), "text"), judged, path)
    rows = formats.read_corpus(spark, f"{path}/corpus").select(F.lit("corpus").alias("part"), F.col("_id").alias("a"), F.col("title").alias("b"))
    rows = rows.unionByName(formats.read_corpus(spark, f"{path}/queries").select(F.lit("queries").alias("part"), F.col("_id").alias("a"), F.md5("text").alias("b")))
    return rows.unionByName(formats.read_qrels(spark, f"{path}/qrels").select(F.lit("qrels").alias("part"), F.col("query_id").alias("a"), F.array_join("relevant", ",").alias("b")))


_B = _W.format("'item ' || item_id || ' ' || text")


@query(f"WITH b AS (SELECT item_id, {_B} AS w FROM benchmark), c AS (SELECT item_id, w, unnest(range(0, 1 + greatest(0, CAST(ceil((len(w) - 20) / 15.0) AS BIGINT)))) AS ordinal FROM b) SELECT item_id, ordinal, md5(array_to_string(w[ordinal * 15 + 1:ordinal * 15 + 20], ' ')) AS chunk_md5, true AS unit, 40::BIGINT AS code_bytes FROM c")
def ingest_files(spark, d):
    """A directory of files, chunked by 20 words with 5 in common, embedded, and coded with a codec fitted on all chunks."""
    path = _place(spark, "files")
    formats.write_corpus(table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("_id"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("title"), "text"), path)
    rows, codec = rag.ingest(spark, [path], [".txt"], lambda texts: [hash_embed(t, 32) for t in texts], 32, "int8", 20, 5, "passage: ")
    item = F.regexp_extract("source", r"id=(\d+)", 1).cast("bigint")
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return rows.select(item.alias("item_id"), "ordinal", F.md5("text").alias("chunk_md5"), (F.abs(norm - 1) < 1e-5).alias("unit"), F.lit(codec.size).cast("bigint").alias("code_bytes"))


_TOP3 = (
    f"WITH {_E}, {_Q}, p AS (SELECT qid, qdoc, vec_id, doc, {cosine_sql('qv', 'v')} AS s FROM q, e WHERE vec_id <> qid), t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, vec_id) AS rank FROM p), "
    "a AS (SELECT qid, string_agg('[' || rank || '] (source: ' || doc || ', chunk ' || vec_id || ')' || chr(10) || 'text of ' || vec_id || '.' || chr(10) || chr(10), '' ORDER BY rank) AS b, min(CASE WHEN rank = 1 THEN vec_id END) AS top, bool_or(doc = qdoc) AS hit FROM t WHERE rank <= 3 GROUP BY qid), "
    "g AS (SELECT qid, 'Context passages:' || chr(10) || chr(10) || b || 'Question: which is nearest to ' || qid || '?' AS prompt, 'text of ' || top AS answer, hit, top % 2 = 0 AS gold FROM a)"
)


def _answered(spark, d):
    chunks = collection(spark, d).select("vec_id", "embedding", F.col("doc").alias("source"), F.col("vec_id").alias("ordinal"), F.concat(F.lit("\ntext of "), F.col("vec_id").cast("string"), F.lit(".\n")).alias("text"))
    labels = collection(spark, d).select(F.col("vec_id").alias("qid"), F.col("doc").alias("source"))
    asked = self_queries(spark, d).select("qid", "vector", "exclude").join(labels, "qid").withColumn("question", F.concat(F.lit(" which is nearest to "), F.col("qid").cast("string"), F.lit("?\n")))
    rows = rag.with_context(asked, chunks, 3, Metric.COSINE)
    # Gold answers of every question whose nearest vector has an even id.
    top = F.get("hits", F.lit(0))["vec_id"]
    rows = rows.withColumn("answers", F.when(top % 2 == 0, F.array(F.concat(F.lit("Text of "), top.cast("string")))).otherwise(F.array().cast("array<string>")))
    return rag.completed(rows, MockChat(), rag.ANSWER_SYSTEM)


@query(f"{_TOP3} SELECT qid, md5(prompt) AS prompt_md5, answer, hit AS source_hit, gold AS exact FROM g")
def answered_questions(spark, d):
    """Question to answer: search, late lookup of passages, prompt, chat model, and its scores."""
    rows = rag.bench_rows(_answered(spark, d), "b1", "nearest", "vectors", "given", "f32", "mock", F.lit("2024"))
    read = lambda c, k, kind: F.get_json_object(c, f"$.{k}").cast(kind)
    return rows.select(read("metadata", "question_id", "bigint").alias("qid"), F.md5("prompt").alias("prompt_md5"), F.col("response").alias("answer"), read("metrics", "source_hit", "boolean").alias("source_hit"), read("metrics", "exact", "boolean").alias("exact"))


@query(f"{_TOP3} SELECT count(*) AS n, count(*) FILTER (WHERE gold) AS scored, 1.0::DOUBLE AS exact, count(*) AS judged, 1.0::DOUBLE AS judge_correct, 1.0::DOUBLE AS judge_faithful FROM g")
def judged_questions(spark, d):
    """A bench run in the log, its targets judged, and the report over both."""
    log = rag.bench_rows(_answered(spark, d), "b1", "nearest", "vectors", "given", "f32", "mock", F.lit("2024"))
    verdicts = rag.judge_rows(runs.judge_targets(log, "nearest"), rag.WordJudge(), "b1", F.lit("2025"))
    return runs.report_cells(log.unionByName(verdicts)).select("n", "scored", "exact", "judged", "judge_correct", "judge_faithful")
