"""File formats: question sets, retrieval benchmarks, claims, scripts, documents and code files."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.text import collapse_spaces, trimmed

QUESTION = "id string, question string, query string, answers array<string>, source string, relevant array<string>"
STEP = "id string, write string, ask string, answers array<string>, source string"
MAGIC = b"HVECODE1"  # fixed value: what a code file begins with


class FormatError(ValueError):
    """An input that breaks its format."""


def _json_lines(spark: SparkSession, path: str, schema: str, what: str) -> DataFrame:
    """Rows of a JSON-lines file, # comments and blank lines left out; a broken line or a repeated id is an error."""
    lines = spark.read.text(path).where((trimmed(F.col("value")) != "") & ~trimmed(F.col("value")).startswith("#"))
    rows = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), "value")
    bad = rows.where(F.col("r.id").isNull()).limit(1).collect()
    if bad:
        raise FormatError(f"{what}: not readable: {bad[0]['value'][:80]}")
    rows = rows.select("r.*")
    twice = rows.groupBy("id").count().where("count > 1").limit(1).collect()
    if twice:
        raise FormatError(f"{what}: id {twice[0]['id']} is used twice")
    if rows.isEmpty():
        raise FormatError(f"{what}: nothing in it")
    none = F.array().cast("array<string>")
    return rows.withColumns({c: F.coalesce(c, none) for c, kind in rows.dtypes if kind == "array<string>"})


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return _json_lines(spark, path, QUESTION, "question set")


def retrieval_text() -> Column:
    """What a question is searched with: its query if it has one."""
    return F.coalesce("query", "question")


def write_questions(questions: DataFrame, path: str) -> None:
    """One object a line, unset and empty fields left out."""
    def some(c):
        return F.when(F.size(c) > 0, F.col(c)).alias(c)

    row = F.struct("id", "question", "query", some("answers"), "source", some("relevant"))
    questions.select(F.to_json(row).alias("value")).write.text(path)


def read_memory_script(spark: SparkSession, path: str) -> DataFrame:
    """Steps in file order with step_index; each writes or asks, not both."""
    rows = _json_lines(spark, path, STEP, "memory script")
    if not rows.where(F.col("write").isNull() == F.col("ask").isNull()).isEmpty():
        raise FormatError("memory script: a step writes or asks, one of the two")
    return rows


def read_query_lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).select(trimmed(F.col("value")).alias("query")).where("query <> ''")
    if rows.isEmpty():
        raise FormatError("no query in the file")
    return rows


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """_id, title, text of a corpus or query file in JSON lines, missing fields empty."""
    return spark.read.schema("_id string, title string, text string").json(path).select("_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, relevant): judged relevant documents of each query; a header line is recognised by its score."""
    rows = spark.read.csv(path, sep="\t", schema="query_id string, doc_id string, score string")
    return qrels_of(rows.select("query_id", "doc_id", F.expr("try_cast(score as double)").alias("score")))


def qrels_of(judgments: DataFrame) -> DataFrame:
    """(query_id, relevant) of judgments(query_id, doc_id, score) with a positive score, each document once."""
    return judgments.where(F.col("score") > 0).groupBy("query_id").agg(F.sort_array(F.collect_set("doc_id")).alias("relevant"))


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """(id, claim, label): the label all evidence of a claim agrees on, else NULL."""
    rows = spark.read.schema("id long, claim string, evidence map<string,array<struct<label:string>>>").json(path)
    return rows.select(F.col("id").cast("string").alias("id"), "claim", claim_label(F.col("evidence")).alias("label"))


def claim_label(evidence: Column) -> Column:
    labels = F.array_distinct(F.transform(F.flatten(F.map_values(evidence)), lambda e: e["label"]))
    return F.when(F.size(labels) == 1, F.get(labels, F.lit(0)))


def beir_questions(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Judged queries as a question set."""
    none = F.array().cast("array<string>")
    return queries.join(qrels, queries["_id"] == qrels["query_id"]).select(F.col("_id").alias("id"), collapse_spaces(F.col("text")).alias("question"), F.lit(None).cast("string").alias("query"), none.alias("answers"), F.lit(None).cast("string").alias("source"), "relevant")


#: Gold answers of a verdict, by label, and the wording of a claim as a question.
SUPPORT_ANSWERS = ("supports",)
CONTRADICT_ANSWERS = ("refutes", "contradicts")
CLAIM_QUESTION = "Does the evidence support or refute this claim? Answer with one word, supports or refutes, then cite. Claim: "


def scifact_question(claim: Column) -> Column:
    return F.concat(F.lit(CLAIM_QUESTION), claim)


def verdict_answers(label: Column) -> Column:
    return F.when(label == "SUPPORT", F.lit(list(SUPPORT_ANSWERS))).when(label == "CONTRADICT", F.lit(list(CONTRADICT_ANSWERS))).otherwise(F.array().cast("array<string>"))


def corpus_body(title: Column, text: Column) -> Column:
    """title, blank line, text, each trimmed, and a line feed; an empty part leaves nothing."""
    t, x = trimmed(title), trimmed(text)
    return F.concat(F.when(t == "", x).when(x == "", t).otherwise(F.concat(t, F.lit("\n\n"), x)), F.lit("\n"))


def write_corpus(corpus: DataFrame, path: str) -> None:
    """A directory a document, holding its body."""
    corpus.select(F.col("_id").alias("id"), F.regexp_replace(corpus_body(F.col("title"), F.col("text")), r"\n$", "").alias("value")).write.partitionBy("id").text(path)


def read_documents(spark: SparkSession, paths: list[str], extensions: list[str]) -> DataFrame:
    """(source, text) of the files below paths with one of the extensions (any case), sorted, each once; a path that
    names a file is taken whatever its extension."""
    kept = F.lower(F.regexp_extract("source", r"\.([^./\\]+)$", 1)).isin(*[e.lower().lstrip(".") for e in extensions])
    named = F.lit(False)
    for p in paths:
        named = named | F.col("source").endswith(p.split("://")[-1])
    rows = spark.read.option("recursiveFileLookup", "true").text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))
    return rows.where(kept | named).dropDuplicates(["source"]).orderBy("source")


def code_file(ids: np.ndarray, codes: list[bytes]) -> bytes:
    """Header, ids and codes back to back (sources are not kept)."""
    size = len(codes[0]) if codes else 0
    if any(len(c) != size for c in codes) or len(ids) != len(codes):
        raise FormatError("codes differ in size")
    return MAGIC + struct.pack("<QQ", size, len(codes)) + np.asarray(ids, "<i8").tobytes() + b"".join(codes)


def parse_code_file(raw: bytes) -> tuple[np.ndarray, list[bytes]]:
    if raw[:8] != MAGIC or len(raw) < 24:
        raise FormatError("not a code file")
    size, n = struct.unpack("<QQ", raw[8:24])
    if len(raw) != 24 + n * (8 + size):
        raise FormatError("a code file of the wrong length")
    body = raw[24 + 8 * n :]
    return np.frombuffer(raw[24 : 24 + 8 * n], "<i8"), [body[i * size : (i + 1) * size] for i in range(n)]


def read_code_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, code) of every code file below path, a file a task."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for raw in batch.column(0):
                ids, codes = parse_code_file(raw.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(codes, pa.binary())], names=["id", "code"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "id long, code binary")


def coir_to_beir(corpus: DataFrame, queries: DataFrame, judgments: DataFrame, path: str) -> None:
    """Parquet tables of a code-retrieval benchmark as corpus and query JSON lines and a qrels TSV."""
    corpus.select(F.col("_id").cast("string"), F.coalesce("title", F.lit("")).alias("title"), "text").write.json(f"{path}/corpus")
    queries.select(F.col("_id").cast("string"), "text").write.json(f"{path}/queries")
    judgments.select("query-id", "corpus-id", "score").write.csv(f"{path}/qrels", sep="\t", header=True)
