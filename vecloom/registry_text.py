"""Queries over texts, run logs, scripts and analyses (the second half of the registry)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vecloom.functions import text as T
from vecloom.operators import memory, recall, runs
from vecloom.plans import analytics
from vecloom.registry import K, ORACLES, _per_query_sql, _ranked_sql, _traces, query, r6
from vecloom.session import table
from vecloom.sources import catalog, formats

_W = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"
_NORM = "list_filter(list_filter(string_split_regex(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+'), lambda w: w <> ''), lambda w: w NOT IN ('a', 'an', 'the'))"


def norm_sql(x: str) -> str:
    return f"array_to_string({_NORM.format(x)}, ' ')"


# -- F20 to F35: texts ----------------------------------------------------------------------------------------------


@query(f"WITH w AS (SELECT doc_id, {_W} AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE 1 + greatest(0, CAST(ceil((len(w) - 200) / 160.0) AS BIGINT)) END)) AS ordinal FROM w) SELECT doc_id, ordinal, md5(array_to_string(w[ordinal * 160 + 1:ordinal * 160 + 200], ' ')) AS chunk_md5, len(w[ordinal * 160 + 1:ordinal * 160 + 200]) AS words FROM c")
def chunk_documents(spark, d):
    """Windows of 200 words, 40 in common."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"), 200, 40)).alias("ordinal", "chunk"))
    return rows.select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.md5("chunk").alias("chunk_md5"), F.size(T.words(F.col("chunk"))).cast("bigint").alias("words"))


@query(f"SELECT doc_id, md5(array_to_string(({_W})[1:50], ' ')) AS truncated_md5 FROM documents")
def payload_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.truncate_words(F.col("text"), 50)).alias("truncated_md5"))


@query(f"SELECT lang, sum(length(text))::BIGINT AS chars_before, sum(length(array_to_string(({_W})[1:50], ' ')))::BIGINT AS chars_after, sum(len({_W}))::BIGINT AS words_before, sum(len(({_W})[1:50]))::BIGINT AS words_after FROM documents GROUP BY lang")
def payload_stats(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(*T.payload_stats(F.col("text"), T.truncate_words(F.col("text"), 50)))


@query(f"SELECT doc_id, md5({norm_sql('text')}) AS normalized_md5 FROM documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalize_answer(F.col("text"))).alias("normalized_md5"))


@query(f"SELECT doc_id, array_to_string({_W}, ' ') = text AS already, length(array_to_string({_W}, ' '))::BIGINT AS chars FROM documents")
def collapse_spaces(spark, d):
    x = T.collapse_spaces(F.col("text"))
    return table(spark, d, "documents").select("doc_id", (x == F.col("text")).alias("already"), F.length(x).cast("bigint").alias("chars"))


_ANSWERS = f"a AS (SELECT item_id, text AS answer, array_to_string(({_W})[1:4], ' ') AS g1, array_to_string(({_W})[3:5], '-') AS g2 FROM benchmark)"


@query(f"WITH {_ANSWERS}, n AS (SELECT item_id, {norm_sql('CASE WHEN item_id % 3 = 0 THEN g1 ELSE answer END')} AS a, {norm_sql('g1')} AS x, {norm_sql('g2')} AS y FROM a) SELECT item_id, (x <> '' AND x = a) OR (y <> '' AND y = a) AS exact, a <> '' AND ((x <> '' AND contains(a, x)) OR (y <> '' AND contains(a, y))) AS contains FROM n")
def score_answers(spark, d):
    w = T.words(F.col("text"))
    gold = F.array(F.array_join(F.slice(w, 1, 4), " "), F.array_join(F.slice(w, 3, 3), "-"), F.lit("?!"))
    answer = F.when(F.col("item_id") % 3 == 0, F.get(gold, F.lit(0))).otherwise(F.col("text"))
    exact, contains = T.score_answer(answer, gold)
    return table(spark, d, "benchmark").select("item_id", exact.alias("exact"), contains.alias("contains"))


_SOURCE_OF = "CASE doc_id % 6 WHEN 0 THEN '/data/corpus/' || doc_id || '.txt' WHEN 1 THEN source || '\\' || doc_id || '.tar.gz' WHEN 2 THEN '.hidden' || doc_id WHEN 3 THEN 'dir.d/name' || doc_id WHEN 4 THEN source || '/' ELSE '.a.b' || doc_id END"


@query(f"WITH s AS (SELECT doc_id, {_SOURCE_OF} AS source FROM documents) SELECT source, CASE doc_id % 6 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN doc_id || '.tar' WHEN 2 THEN '.hidden' || doc_id WHEN 3 THEN 'name' || doc_id WHEN 4 THEN '' ELSE '.a' END AS doc FROM s")
def doc_id(spark, d):
    rows = table(spark, d, "documents").select(F.expr(_SOURCE_OF.replace("'\\'", "'\\\\'")).alias("source"))
    return rows.select("source", T.doc_id(F.col("source")).alias("doc"))


@query("WITH s AS (SELECT page_id, url, regexp_extract(url, '([^/\\\\]*)$', 1) AS n FROM pages) SELECT page_id, CASE WHEN regexp_extract(n, '^(.+)\\.[^.]*$', 1) <> '' THEN regexp_extract(n, '^(.+)\\.[^.]*$', 1) ELSE n END AS doc FROM s")
def doc_id_pages(spark, d):
    return table(spark, d, "pages").select("page_id", T.doc_id(F.col("url")).alias("doc"))


_PASSAGES = "SELECT conv_id, list({x} ORDER BY turn) AS p FROM conversations WHERE role = 'assistant' GROUP BY conv_id"


@query(
    "WITH h AS (SELECT conv_id, string_agg('[' || i || '] (source: conv' || conv_id || ', chunk ' || turn || ')' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10), '' ORDER BY turn) AS b FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'assistant') GROUP BY conv_id), "
    "q AS (SELECT conv_id, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id) "
    "SELECT conv_id, md5(CASE WHEN b IS NULL THEN 'No context passages were retrieved.' || chr(10) || chr(10) ELSE 'Context passages:' || chr(10) || chr(10) || b END || 'Question: ' || regexp_replace(question, '^\\s+|\\s+$', '', 'g')) AS prompt_md5 FROM q LEFT JOIN h USING (conv_id)"
)
def build_prompt(spark, d):
    c = table(spark, d, "conversations")
    hits = c.where("role = 'assistant'").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: F.struct(x["turn"].alias("ordinal"), F.concat(F.lit("\n\t "), x["text"], F.lit(" \n\n")).alias("text"))).alias("h"))
    asked = c.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    rows = asked.join(hits, "conv_id", "left")
    full = F.transform(F.coalesce("h", F.array().cast("array<struct<ordinal:bigint,text:string>>")), lambda x: F.struct(F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("source"), x["ordinal"].alias("ordinal"), x["text"].alias("text")))
    return rows.select("conv_id", F.md5(T.user_prompt(full, F.concat(F.lit("\n"), F.col("question"), F.lit("\r\n")))).alias("prompt_md5"))


@query(
    "SELECT item_id, md5('Question: ' || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10) || 'Retrieved passages:' || chr(10) || CASE WHEN item_id % 2 = 0 THEN '(none)' || chr(10) ELSE '[1] ' || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10) || '[2] second' || chr(10) END || chr(10) || 'Gold answers: ' "
    "|| CASE WHEN item_id % 3 = 0 THEN '(none; output null for correct)' ELSE '\"yes\", \"no\"' END || chr(10) || chr(10) || 'System answer: ' || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10) || 'Reply with the JSON object only.') AS prompt_md5 FROM benchmark"
)
def build_judge_prompt(spark, d):
    none, x = F.array().cast("array<string>"), F.concat(F.lit(" \n"), F.col("text"), F.lit("\n"))
    passages = F.when(F.col("item_id") % 2 == 0, none).otherwise(F.array(x, F.lit(" second\n")))
    gold = F.when(F.col("item_id") % 3 == 0, none).otherwise(F.array(F.lit("yes"), F.lit("no")))
    return table(spark, d, "benchmark").select("item_id", F.md5(T.judge_prompt(x, gold, passages, x)).alias("prompt_md5"))


_REPLIES = [
    ('{"correct": true, "faithful": false, "reason": "r"}', True, True, False, "r"),
    ('```json\n{"correct": null, "faithful": true}\n```', True, None, True, ""),
    ("no json here", False, None, None, None),
    ('{"correct": "yes", "faithful": true}', False, None, None, None),
    ('{"faithful": "true"}', False, None, None, None),
    ("} {", False, None, None, None),
    ('text {"faithful": true, "reason": "a } b"} tail', True, None, True, "a } b"),
    ('{"correct": false}', False, None, None, None),
]


def _lit(x) -> str:
    return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'"


def _by_reply(values: list[str], of: str = "n") -> str:
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


@query(
    f"WITH n AS (SELECT doc_id, doc_id % {len(_REPLIES)} AS n FROM documents) SELECT doc_id, {_by_reply([_lit(r[1]) for r in _REPLIES])} AS valid, CAST({_by_reply([_lit(r[2]) for r in _REPLIES])} AS BOOLEAN) AS correct, "
    f"CAST({_by_reply([_lit(r[3]) for r in _REPLIES])} AS BOOLEAN) AS faithful, CAST({_by_reply([_lit(r[4]) for r in _REPLIES])} AS VARCHAR) AS reason FROM n"
)
def parse_verdict(spark, d):
    """A judge's reply about each document, after the document's own words where those hold no brace."""
    replies = F.array(*[F.lit(r[0]) for r in _REPLIES])
    said = F.concat(F.translate(F.substring("text", 1, 80), "{}", "  "), F.lit("\n"), F.get(replies, (F.col("doc_id") % len(_REPLIES)).cast("int")))
    return table(spark, d, "documents").select("doc_id", T.parse_verdict(said).alias("v")).select("doc_id", "v.*")


@query("SELECT doc_id, md5('query: ' || text) AS query_md5, md5('passage: ' || text) AS passage_md5 FROM documents")
def embedding_prefixes(spark, d):
    from vecloom.sources.embedding import prefixed

    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(prefixed(text, "query: ")).alias("query_md5"), F.md5(prefixed(text, "passage: ")).alias("passage_md5"))


@query(f"SELECT item_id, '{formats.CLAIM_QUESTION}' || text AS question FROM benchmark")
def scifact_question(spark, d):
    return table(spark, d, "benchmark").select("item_id", formats.scifact_question(F.col("text")).alias("question"))


@query("SELECT item_id, CASE WHEN item_id % 4 = 0 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') WHEN item_id % 4 = 1 THEN 'item ' || item_id ELSE 'item ' || item_id || chr(10) || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') END || chr(10) AS body FROM benchmark")
def corpus_bodies(spark, d):
    n = F.col("item_id") % 4
    title = F.when(n == 0, "").otherwise(F.concat(F.lit(" item "), F.col("item_id").cast("string")))
    return table(spark, d, "benchmark").select("item_id", formats.corpus_body(title, F.when(n == 1, " \n ").otherwise(F.concat(F.lit("\n"), F.col("text"), F.lit("\n\n")))).alias("body"))


@query()
def payload_extractive(spark, d):
    """Each document's sentences nearest to the first benchmark item, in 60 words."""
    question = table(spark, d, "benchmark").agg(F.min_by("text", "item_id").alias("q"))
    return table(spark, d, "documents").crossJoin(question).select("doc_id", T.compress_extractive(F.col("text"), F.col("q"), 60).alias("passage"))  # one row on the right


_FNV = "list_reduce(list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::UHUGEINT), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT)"


@query(
    "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS t FROM documents), c AS (SELECT doc_id, lower(t) AS w, count(*) AS n FROM t GROUP BY ALL), "
    f"h AS (SELECT w, {_FNV} AS h FROM (SELECT DISTINCT w FROM c)), p AS (SELECT doc_id, (h % 64)::BIGINT AS slot, sum(CASE WHEN h >= 9223372036854775808::UHUGEINT THEN -n ELSE n END)::DOUBLE AS x FROM c JOIN h USING (w) GROUP BY ALL), "
    "l AS (SELECT doc_id, sqrt(sum(x * x))::FLOAT AS l FROM p GROUP BY doc_id) SELECT doc_id, slot, round((x::FLOAT / l)::FLOAT::DOUBLE, 5) + 0.0 AS value FROM p JOIN l USING (doc_id) WHERE x <> 0"
)
def hash_embeddings(spark, d):
    """The components that are not zero."""
    from vecloom.sources.embedding import hash_embeddings as embed

    rows = embed(table(spark, d, "documents"), "doc_id", "text", 64).select(F.col("id").alias("doc_id"), F.posexplode("vector").alias("slot", "value"))
    return rows.where("value <> 0").select("doc_id", F.col("slot").cast("bigint").alias("slot"), (F.round(F.col("value").cast("double"), 5) + 0.0).alias("value"))


# -- judgments, questions, catalog ----------------------------------------------------------------------------------


@query("SELECT d.source AS query_id, list(CAST(l.doc_id AS VARCHAR) ORDER BY CAST(l.doc_id AS VARCHAR)) AS relevant FROM labels l JOIN documents d USING (doc_id) WHERE l.quality > 0 GROUP BY d.source")
def qrels(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return formats.qrels_of(rows.select(F.col("source").alias("query_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("quality").alias("score")))


@query("WITH r AS (SELECT doc_id % 40 AS item_id, list(CAST(doc_id AS VARCHAR) ORDER BY CAST(doc_id AS VARCHAR)) AS relevant FROM labels WHERE quality > 0 GROUP BY 1) SELECT item_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''), ' ') AS question, relevant FROM benchmark JOIN r USING (item_id)")
def questions_with_qrels(spark, d):
    judged = formats.qrels_of(table(spark, d, "labels").select((F.col("doc_id") % 40).cast("string").alias("query_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("quality").alias("score")))
    asked = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("_id"), "text")
    return formats.beir_questions(asked, judged).select(F.col("id").cast("bigint").alias("item_id"), "question", "relevant")


@query("SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'SUPPORT' WHEN 1 THEN NULL WHEN 2 THEN 'CONTRADICT' END AS label FROM benchmark")
def claim_labels(spark, d):
    def ev(*labels):
        return F.array(*[F.struct(F.lit(x).alias("label")) for x in labels])

    n = F.col("item_id") % 4
    evidence = F.when(n == 0, F.create_map(F.lit("1"), ev("SUPPORT"), F.lit("2"), ev("SUPPORT", "SUPPORT"))).when(n == 1, F.create_map(F.lit("1"), ev("SUPPORT"), F.lit("2"), ev("CONTRADICT"))).when(n == 2, F.create_map(F.lit("1"), ev("CONTRADICT")))
    empty = F.from_json(F.lit("{}"), "map<string,array<struct<label:string>>>")
    return table(spark, d, "benchmark").select("item_id", formats.claim_label(F.coalesce(evidence, empty)).alias("label"))


@query("SELECT count(*) AS questions, count(*) FILTER (WHERE item_id % 2 = 0) AS with_answers, count(*) FILTER (WHERE item_id % 3 = 0) AS with_query, count(*) FILTER (WHERE item_id % 5 = 0) AS with_source, count(*) FILTER (WHERE item_id % 7 = 0) AS judged, 2 * count(*) FILTER (WHERE item_id % 7 = 0) AS judgments FROM benchmark")
def describe_questions(spark, d):
    i, none = F.col("item_id"), F.array().cast("array<string>")
    q = table(spark, d, "benchmark").select(F.when(i % 2 == 0, F.array(F.lit("x"))).otherwise(none).alias("answers"), F.when(i % 3 == 0, "q").alias("query"), F.when(i % 5 == 0, "s").alias("source"), F.when(i % 7 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(none).alias("relevant"))
    return catalog.describe_questions(q)


@query("SELECT lang AS name, count(*) AS chunk_count FROM documents GROUP BY lang UNION ALL SELECT 'empty', 0")
def collections_list(spark, d):
    chunks = table(spark, d, "documents").select(F.col("lang").alias("collection"))
    named = chunks.select(F.col("collection").alias("name")).distinct().unionByName(spark.createDataFrame([("empty",)], "name string"))
    return catalog.with_counts(named, chunks, "name", "collection", "chunk_count")


@query("SELECT conv_id, count(*) AS message_count, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations WHERE role IN ('user', 'assistant', 'system') GROUP BY conv_id")
def sessions_list(spark, d):
    c = table(spark, d, "conversations").where(F.col("role").isin("user", "assistant", "system"))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("message_count"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query("SELECT l.label AS collection, c.chat, b.item_id FROM (SELECT DISTINCT label FROM embeddings) l, (VALUES ('a'), ('b')) c(chat), benchmark b")
def bench_matrix(spark, d):
    return runs.matrix_product(table(spark, d, "embeddings").select(F.col("label").alias("collection")).distinct(), spark.createDataFrame([("a",), ("b",)], "chat string"), table(spark, d, "benchmark").select("item_id"))


@query("SELECT b.item_id, p.pos::BIGINT AS pos, d.doc_id AS id FROM benchmark b, (SELECT unnest([7, 3, -1, 12]) AS id, unnest([0, 1, 2, 3]) AS pos) p JOIN documents d ON d.doc_id = p.id WHERE b.item_id = 0")
def chunk_text_lookup(spark, d):
    from vecloom.operators.retrieval import texts_in_order

    found = texts_in_order(spark, [7, 3, -1, 12], table(spark, d, "documents"), "doc_id", "text")
    return found.select(F.lit(0).cast("bigint").alias("item_id"), F.col("pos").cast("bigint").alias("pos"), "id")


# -- the run log ----------------------------------------------------------------------------------------------------

#: Runs made of events; plain enough for both engines.
RUNS_SQL = """SELECT 'r' || lpad(CAST(event_id AS STRING), 8, '0') AS id,
 CASE event_id % 5 WHEN 3 THEN 'judge' WHEN 4 THEN 'memory' ELSE 'bench' END AS kind,
 lpad(CAST(event_id AS STRING), 12, '0') AS created_at,
 CASE WHEN user_id % 7 = 0 THEN NULL ELSE 'col' || CAST(user_id % 3 AS STRING) END AS collection,
 'em' || CAST(user_id % 2 AS STRING) AS embed_model,
 CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'int8' WHEN 2 THEN 'binary' ELSE 'f32' END AS codec,
 'chat' || CAST(user_id % 2 AS STRING) AS chat_model,
 CASE event_id % 5
  WHEN 3 THEN '{"run_id":"r' || lpad(CAST(event_id - 3 + user_id % 3 - 5 * (user_id % 2) AS STRING), 8, '0') || '","batch":"b1"}'
  ELSE '{"batch":"b' || CAST(event_id % 3 AS STRING) || '","question_set":"s' || CAST(user_id % 2 AS STRING) || '","answers":' || CASE WHEN event_id % 2 = 0 THEN '["x"]' ELSE '[]' END
   || ',"step":"' || CASE WHEN event_id % 2 = 0 THEN 'write' ELSE 'ask' END || '"' || CASE WHEN event_id % 11 = 0 THEN ',"error":"boom"' ELSE '' END
   || CASE WHEN event_id % 6 = 0 THEN ',"payload":"truncate:50"' ELSE '' END || ',"chat_model_served":"chat' || CAST(event_id % 2 AS STRING) || '"}' END AS metadata,
 CASE event_id % 5
  WHEN 3 THEN '{"correct":' || CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'null' END || ',"faithful":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || '}'
  ELSE '{"exact":' || CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END || ',"contains":' || CASE WHEN event_id % 4 < 2 THEN 'true' ELSE 'false' END
   || CASE WHEN event_id % 7 < 3 THEN ',"source_hit":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END ELSE '' END
   || CASE WHEN event_id % 9 < 4 THEN ',"ndcg":0.' || CAST(event_id % 10 AS STRING) || ',"doc_recall":0.5' ELSE '' END
   || ',"retrieval_ms":' || CAST(event_id % 50 AS STRING) || ',"generation_ms":' || CAST(user_id AS STRING) || ',"input_tokens":' || CAST(event_id % 900 AS STRING)
   || ',"output_tokens":' || CAST(event_id % 90 AS STRING) || ',"write_ms":' || CAST(event_id % 5 AS STRING) || ',"cumulative_bytes":' || CAST(event_id * 8 AS STRING) || ',"cumulative_chunks":' || CAST(event_id AS STRING) || '}' END AS metrics
FROM events"""
_RUNS = f"WITH runs AS ({RUNS_SQL.replace('STRING', 'VARCHAR')})"
_J = "json_extract_string({0}, '$.{1}')"


def _m(key, of="metadata"):
    return _J.format(of, key)


_V = f"v AS (SELECT run_id, v_metrics FROM (SELECT {_m('run_id')} AS run_id, metrics AS v_metrics, row_number() OVER (PARTITION BY {_m('run_id')} ORDER BY created_at DESC, id DESC) AS n FROM runs WHERE kind = 'judge') WHERE n = 1)"


def run_log(spark, d):
    table(spark, d, "events").createOrReplaceTempView("_vecloom_events")
    return spark.sql(RUNS_SQL.replace("FROM events", "FROM _vecloom_events"))


@query(f"{_RUNS} SELECT id, kind, created_at FROM runs ORDER BY created_at DESC, id DESC LIMIT 50")
def runs_latest(spark, d):
    return runs.latest(run_log(spark, d), 50).select("id", "kind", "created_at")


@query(f"{_RUNS} SELECT id FROM runs WHERE kind IN ('bench', 'memory') AND {_m('batch')} LIKE 'b1%'")
def runs_by_kind_and_batch(spark, d):
    return runs.by_kinds(run_log(spark, d), "bench", "memory", batch_prefix="b1").select("id")


@query(f"{_RUNS} SELECT id, created_at FROM runs WHERE id LIKE 'r0000012%' ORDER BY created_at DESC LIMIT 1")
def run_by_prefix(spark, d):
    return runs.by_id_prefix(run_log(spark, d), "r0000012").select("id", "created_at")


@query(f"{_RUNS} SELECT id FROM runs WHERE kind = 'bench' AND {_m('error')} IS NULL AND {_m('question_set')} = 's1' AND id NOT IN (SELECT {_m('run_id')} FROM runs WHERE kind = 'judge')")
def judge_targets(spark, d):
    return runs.judge_targets(run_log(spark, d), "s1").select("id")


def _avg_true(cond, x):
    return f"round(avg(CASE WHEN {cond} THEN CASE WHEN {x} = 'true' THEN 1.0 ELSE 0.0 END END), 6) + 0.0"


def _avg_num(cond, key):
    return f"round(avg(CASE WHEN {cond} THEN coalesce(TRY_CAST({_m(key, 'metrics')} AS DOUBLE), 0.0) END), 6) + 0.0"


_OK, _GOLD = f"{_m('error')} IS NULL", f"coalesce(json_array_length(metadata, '$.answers') > 0, false)"


@query(
    f"{_RUNS}, {_V} SELECT coalesce({_m('question_set')}, '-') AS question_set, coalesce(collection, '-') AS collection, coalesce(embed_model, '-') AS embed_model, coalesce(codec, '-') AS codec, coalesce(chat_model, '-') AS chat_model, coalesce({_m('payload')}, 'none') AS payload, "
    f"count(*) AS n, count(*) FILTER (WHERE {_OK} AND {_GOLD}) AS scored, coalesce({_avg_true(f'{_OK} AND {_GOLD}', _m('exact', 'metrics'))}, 0.0) AS exact, coalesce({_avg_true(f'{_OK} AND {_GOLD}', _m('contains', 'metrics'))}, 0.0) AS contains, "
    f"{_avg_true(_OK + ' AND ' + _m('source_hit', 'metrics') + ' IS NOT NULL', _m('source_hit', 'metrics'))} AS source_hit, {_avg_num(_OK + ' AND ' + _m('ndcg', 'metrics') + ' IS NOT NULL', 'doc_recall')} AS doc_recall, {_avg_num(_OK + ' AND ' + _m('ndcg', 'metrics') + ' IS NOT NULL', 'ndcg')} AS ndcg, "
    + ", ".join(f"coalesce({_avg_num(_OK, k)}, 0.0) AS mean_{k}" for k in ("retrieval_ms", "generation_ms", "input_tokens", "output_tokens"))
    + f", count(*) FILTER (WHERE NOT ({_OK})) AS errors, count(*) FILTER (WHERE {_OK} AND {_m('chat_model_served')} IS DISTINCT FROM chat_model AND {_m('chat_model_served')} IS NOT NULL) AS served_other, count(*) FILTER (WHERE {_OK} AND run_id IS NOT NULL) AS judged, "
    f"{_avg_true(f'{_OK} AND run_id IS NOT NULL AND {_GOLD}', _m('correct', 'v_metrics'))} AS judge_correct, {_avg_true(f'{_OK} AND run_id IS NOT NULL', _m('faithful', 'v_metrics'))} AS judge_faithful FROM runs LEFT JOIN v ON id = run_id WHERE kind = 'bench' GROUP BY ALL"
)
def report_cells(spark, d):
    out = runs.report_cells(run_log(spark, d))
    doubles = [c for c, t in out.dtypes if t == "double"]
    return out.select(*[r6(c).alias(c) if c in doubles else F.col(c) for c in out.columns])


@query(
    f"{_RUNS}, {_V}, j AS (SELECT {_m('correct', 'v_metrics')} = 'true' AS j, coalesce({_m('exact', 'metrics')} = 'true', false) AS e, coalesce({_m('contains', 'metrics')} = 'true', false) AS c FROM runs JOIN v ON id = run_id WHERE kind = 'bench' AND {_m('correct', 'v_metrics')} IN ('true', 'false')) "
    "SELECT count(*) AS n, count(*) FILTER (WHERE j) AS judge_true, count(*) FILTER (WHERE e) AS exact_true, count(*) FILTER (WHERE c) AS contains_true, round(coalesce(avg(CASE WHEN j = e THEN 1.0 ELSE 0.0 END), 0.0), 6) + 0.0 AS agree_exact, round(coalesce(avg(CASE WHEN j = c THEN 1.0 ELSE 0.0 END), 0.0), 6) + 0.0 AS agree_contains, count(*) FILTER (WHERE j AND NOT c) AS judge_only, count(*) FILTER (WHERE c AND NOT j) AS contains_only FROM j"
)
def judge_agreement(spark, d):
    return runs.judge_agreement(run_log(spark, d)).withColumns({c: r6(c) for c in ("agree_exact", "agree_contains")})


def _mem(cond, key):
    return f"coalesce({_avg_num(cond, key)}, 0.0) AS mean_{key}"


_MOK = f"codec IS NOT NULL AND {_OK}"
_MW, _MA = f"{_MOK} AND {_m('step')} = 'write'", f"{_MOK} AND {_m('step')} = 'ask'"


@query(
    f"{_RUNS} SELECT coalesce(codec, '-') AS codec, count(*) FILTER (WHERE {_MW}) AS writes, count(*) FILTER (WHERE {_MA}) AS asks, count(*) FILTER (WHERE codec IS NOT NULL AND NOT ({_OK})) AS errors, "
    f"coalesce(arg_max(CAST({_m('cumulative_bytes', 'metrics')} AS BIGINT), created_at) FILTER (WHERE {_MOK}), 0) AS total_bytes, coalesce(arg_max(CAST({_m('cumulative_chunks', 'metrics')} AS BIGINT), created_at) FILTER (WHERE {_MOK}), 0) AS total_chunks, "
    f"{_mem(_MW, 'write_ms')}, {_mem(_MA, 'retrieval_ms')}, {_mem(_MA, 'generation_ms')}, {_mem(_MA, 'input_tokens')}, count(*) FILTER (WHERE {_MA} AND {_GOLD}) AS scored, "
    f"coalesce({_avg_true(f'{_MA} AND {_GOLD}', _m('exact', 'metrics'))}, 0.0) AS exact, coalesce({_avg_true(f'{_MA} AND {_GOLD}', _m('contains', 'metrics'))}, 0.0) AS contains, {_avg_true(_MA + ' AND ' + _m('source_hit', 'metrics') + ' IS NOT NULL', _m('source_hit', 'metrics'))} AS source_hit, "
    "row_number() OVER (ORDER BY min(created_at)) AS place FROM runs WHERE kind = 'memory' GROUP BY coalesce(codec, '-')"
)
def memory_summary(spark, d):
    out = runs.memory_summary(run_log(spark, d)).withColumn("place", F.col("place").cast("bigint"))
    doubles = [c for c, t in out.dtypes if t == "double"]
    return out.select(*[r6(c).alias(c) if c in doubles else F.col(c) for c in out.columns])


# -- memory scripts -------------------------------------------------------------------------------------------------

_STEPS = "st AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, CASE WHEN role = 'assistant' THEN 'write' ELSE 'ask' END AS step, text FROM conversations WHERE role IN ('user', 'assistant'))"
_SET = "list_distinct({0})"


@query(
    f"WITH {_STEPS}, w AS (SELECT conv_id, i, step, list_distinct({_NORM.format('text')}) AS w FROM st), "
    "p AS (SELECT a.conv_id, a.i AS ask, b.i AS wr, CASE WHEN len(a.w) * len(b.w) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / sqrt(len(a.w)::DOUBLE * len(b.w)) END AS s FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.i < a.i WHERE a.step = 'ask' AND b.step = 'write') "
    "SELECT conv_id, ask AS ask_step, wr AS write_step, round(s, 6) + 0.0 AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, ask ORDER BY s DESC, wr) AS rank FROM p) WHERE rank <= 3"
)
def memory_asof_topk(spark, d):
    """Each ask with the three earlier writes of its script that share most words."""
    s = memory.steps(table(spark, d, "conversations")).withColumn("w", F.array_distinct(T.words(T.normalize_answer(F.col("text"))))).drop("text")
    n = F.sqrt(F.size("ask_w").cast("double") * F.size("write_w"))
    score = F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect("ask_w", "write_w")) / F.nullif(n, F.lit(0.0)))
    top = memory.as_of_top_k(s.where("step = 'ask'").drop("step"), s.where("step = 'write'").drop("step"), score, 3, ["conv_id"])
    return top.select("conv_id", F.col("ask_step_index").alias("ask_step"), F.col("write_step_index").alias("write_step"), r6("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_STEPS} SELECT conv_id, i AS step_index, step, CASE WHEN step = 'write' THEN 8 * len(string_split(text, ' ')) ELSE 0 END::BIGINT AS bytes, sum(CASE WHEN step = 'write' THEN 8 * len(string_split(text, ' ')) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i)::BIGINT AS cumulative_bytes, sum(CASE WHEN step = 'write' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i)::BIGINT AS cumulative_chunks FROM st")
def memory_written_totals(spark, d):
    return memory.written_totals(memory.steps(table(spark, d, "conversations")), 8 * F.size(F.split("text", " ")), ["conv_id"])


# -- analyses -------------------------------------------------------------------------------------------------------


@query(
    "WITH r AS (SELECT lang, n_chars::DOUBLE AS x, length(text) - length(replace(text, ' ', ''))::DOUBLE AS y FROM documents), "
    "k AS (SELECT lang, x, y, rank() OVER (PARTITION BY lang ORDER BY x) + (count(*) OVER (PARTITION BY lang, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY lang ORDER BY y) + (count(*) OVER (PARTITION BY lang, y) - 1) / 2.0 AS ry FROM r) "
    "SELECT lang, count(*) AS n, round(corr(rx, ry), 6) + 0.0 AS spearman, round(corr(x, y), 6) + 0.0 AS pearson FROM k GROUP BY lang"
)
def spearman(spark, d):
    rows = table(spark, d, "documents").select("lang", F.col("n_chars").cast("double").alias("x"), (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).cast("double").alias("y"))
    return analytics.spearman(rows, "x", "y", ["lang"]).select("lang", "n", r6("spearman").alias("spearman"), r6("pearson").alias("pearson"))


@query(
    "WITH p AS (SELECT lang, (n_chars + 1)::DOUBLE AS x, (length(text) - length(replace(text, ' ', '')) + 1)::DOUBLE AS y FROM documents), g AS (SELECT DISTINCT lang AS held FROM p), "
    "f AS (SELECT held, regr_slope(ln(y), ln(x)) AS beta, regr_intercept(ln(y), ln(x)) AS a FROM g JOIN p ON lang <> held GROUP BY held) "
    "SELECT lang, count(*) AS n, round(exp(max(a)), 6) + 0.0 AS alpha, round(max(beta), 6) + 0.0 AS beta, round(exp(avg(abs(a + beta * ln(x) - ln(y)))), 6) + 0.0 AS geometric_error FROM p JOIN f ON lang = held GROUP BY lang"
)
def loco_fit(spark, d):
    rows = table(spark, d, "documents").select("lang", (F.col("n_chars") + 1).cast("double").alias("x"), (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1).cast("double").alias("y"))
    out = analytics.leave_one_out_fit(rows, "lang", "x", "y")
    return out.select("lang", "n", *[r6(c).alias(c) for c in ("alpha", "beta", "geometric_error")])


_RANKS = f"WITH {_ranked_sql('binary')}, {_per_query_sql()}, k AS (SELECT qid, ra FROM r WHERE re <= {K})"


@query(f"{_RANKS}, z AS (SELECT dd, qid, sum(CASE WHEN ra <= dd THEN 1 ELSE 0 END) / {float(K)} AS recall FROM k, (VALUES (10), (20), (50), (100)) t(dd) GROUP BY dd, qid) SELECT 'fixed:' || dd AS policy, count(*) AS queries, dd::DOUBLE AS mean_depth, round(avg(recall), 6) + 0.0 AS recall, round(quantile_disc(recall, 0.1), 6) + 0.0 AS p10, dd::BIGINT AS p90_depth FROM z GROUP BY dd")
def policy_replay(spark, d):
    out = analytics.fixed_curve(_traces(spark, d).persist(), [10, 20, 50, 100], K)
    return out.select("policy", "queries", "mean_depth", r6("recall").alias("recall"), r6("p10").alias("p10"), "p90_depth")


_RATIO_DEPTH = f"least(200, greatest({K}, round_even({{a}} * {K} * power(CASE WHEN band_hat > 0 THEN 0.05 / band_hat ELSE 50.0 END, 1.29), 0)))"


@query(f"{_RANKS}, dep AS (SELECT qid, a, {_RATIO_DEPTH.format(a='a')}::BIGINT AS depth FROM pq, (VALUES (0.5), (1.0), (2.0)) t(a)), z AS (SELECT a, qid, depth, sum(CASE WHEN ra <= depth THEN 1 ELSE 0 END) / {float(K)} AS recall FROM k JOIN dep USING (qid) GROUP BY a, qid, depth) SELECT 'ratio:' || format('{{:.6f}}', a::DOUBLE) AS policy, count(*) AS queries, round(avg(depth), 6) + 0.0 AS mean_depth, round(avg(recall), 6) + 0.0 AS recall, round(quantile_disc(recall, 0.1), 6) + 0.0 AS p10, quantile_disc(depth, 0.9)::BIGINT AS p90_depth FROM z GROUP BY a")
def ratio_router(spark, d):
    out = analytics.ratio_curve(_traces(spark, d).persist(), 0.05, 1.29, K, 200, [0.5, 1.0, 2.0])
    return out.select("policy", "queries", r6("mean_depth").alias("mean_depth"), r6("recall").alias("recall"), r6("p10").alias("p10"), "p90_depth")


@query(f"{_RANKS}, op AS (SELECT DISTINCT qid, {K} AS depth FROM k UNION SELECT qid, ra FROM k WHERE ra > {K} AND ra <= 200), w AS (SELECT op.qid, op.depth, sum(CASE WHEN ra <= op.depth THEN 1 ELSE 0 END) / {float(K)} AS recall FROM op JOIN k USING (qid) GROUP BY op.qid, op.depth), b AS (SELECT l, qid, recall, depth, row_number() OVER (PARTITION BY l, qid ORDER BY recall - l * depth DESC, depth) AS n FROM w, (VALUES (0.0::DOUBLE), (0.001::DOUBLE), (0.01::DOUBLE)) t(l)) SELECT 'oracle:' || CAST(l AS VARCHAR) AS policy, count(*) AS queries, round(avg(depth), 6) + 0.0 AS mean_depth, round(avg(recall), 6) + 0.0 AS recall, round(quantile_disc(recall, 0.1), 6) + 0.0 AS p10, quantile_disc(depth, 0.9)::BIGINT AS p90_depth FROM b WHERE n = 1 GROUP BY l")
def oracle_router(spark, d):
    out = analytics.oracle_curve(_traces(spark, d).persist(), K, 200, [0.0, 0.001, 0.01])
    return out.select("policy", "queries", r6("mean_depth").alias("mean_depth"), r6("recall").alias("recall"), r6("p10").alias("p10"), "p90_depth")


_CURVE = "c AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS x, n_chars::DOUBLE AS y FROM documents), q AS (SELECT source, x AS x0, lead(x) OVER w AS x1, y AS y0, lead(y) OVER w AS y1 FROM c WINDOW w AS (PARTITION BY source ORDER BY x))"


def _interp_sql(t: str) -> str:
    return f"WITH {_CURVE} SELECT source, b AS budget, round(y0 + {t} * (y1 - y0), 6) + 0.0 AS y FROM (SELECT *, row_number() OVER (PARTITION BY source, b ORDER BY x0) AS n FROM q, (VALUES (1.5::DOUBLE), (7.25::DOUBLE), (30.0::DOUBLE)) t(b) WHERE b BETWEEN x0 AND x1) WHERE n = 1"


def _curve(spark, d):
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("double")
    return table(spark, d, "documents").select("source", place.alias("x"), F.col("n_chars").cast("double").alias("y"))


@query(_interp_sql("(b - x0) / (x1 - x0)"))
def interp_at_budget(spark, d):
    return analytics.interpolate(_curve(spark, d), [1.5, 7.25, 30.0], "x", ["y"], ["source"]).withColumn("y", r6("y"))


@query(_interp_sql("(ln(b) - ln(x0)) / (ln(x1) - ln(x0))"))
def interp_log_depth(spark, d):
    return analytics.interpolate(_curve(spark, d), [1.5, 7.25, 30.0], "x", ["y"], ["source"], log=True).withColumn("y", r6("y"))


@query("SELECT lang, source, count(*) AS n, round(avg(n_chars), 6) + 0.0 AS n_chars FROM documents GROUP BY lang, source")
def mean_matrix(spark, d):
    return analytics.mean_matrix(table(spark, d, "documents"), ["lang", "source"], ["n_chars"]).withColumn("n_chars", r6("n_chars"))


@query("SELECT lang AS family, n_chars, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id DESC) AS n FROM documents) WHERE n = 1")
def family_best(spark, d):
    return analytics.family_best(table(spark, d, "documents"), F.col("lang"), "n_chars", ["doc_id"])


@query("SELECT item_id, round(0.718 + item_id * 207 / 1e6, 6) + 0.0 AS ms FROM benchmark")
def hybrid_time(spark, d):
    return table(spark, d, "benchmark").select("item_id", r6(analytics.hybrid_time(F.lit(0.718), F.col("item_id"), F.lit(207))).alias("ms"))


_CELLS = "x AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 AND source NOT LIKE '%1' THEN 'f32' ELSE 'int8' END AS codec, n_chars FROM documents)"


@query(f"WITH {_CELLS} SELECT a.*, b.ceiling FROM x a LEFT JOIN (SELECT source, max(n_chars) AS ceiling FROM x WHERE codec = 'f32' GROUP BY source) b USING (source)")
def cells_with_ceiling(spark, d):
    """Sources that end in 1 have no f32 cell, so no ceiling."""
    rows = table(spark, d, "documents").select("doc_id", "source", F.when((F.col("doc_id") % 3 == 0) & ~F.col("source").endswith("1"), "f32").otherwise("int8").alias("codec"), "n_chars")
    return analytics.with_ceiling(rows, "source", "codec", "n_chars")


@query("SELECT source, cost, first_bytes, first, depth FROM (SELECT source, 1000 * (doc_id % 5 + 1) * 8 + (10 + doc_id % 13) * 1536 AS cost, (doc_id % 5 + 1) * 8 AS first_bytes, lang AS first, 10 + doc_id % 13 AS depth, row_number() OVER (PARTITION BY source ORDER BY 1000 * (doc_id % 5 + 1) * 8 + (10 + doc_id % 13) * 1536, (doc_id % 5 + 1) * 8, lang, 10 + doc_id % 13) AS n FROM documents) WHERE n = 1")
def cheapest_choice(spark, d):
    rows = table(spark, d, "documents").select("source", F.lit(1000).cast("bigint").alias("vectors"), ((F.col("doc_id") % 5 + 1) * 8).alias("first_bytes"), F.col("lang").alias("first"), (F.col("doc_id") % 13 + 10).alias("depth"))
    return analytics.cheapest_choice(rows, "source", "vectors", "first_bytes", "depth", 1536)


@query(f"{_RANKS} SELECT greatest({K}, quantile_disc(ra, 0.9))::BIGINT AS depth, 'binary' AS first FROM k")
def needed_depth(spark, d):
    from vecloom.operators.codecs import codec_by_name
    from vecloom.functions.vectors import Metric
    from vecloom.registry import DIM, collection, self_queries

    ranks = recall.first_stage_ranks(collection(spark, d), self_queries(spark, d), codec_by_name("binary", DIM), Metric.COSINE, K)
    return analytics.needed_depth(ranks.withColumn("first", F.lit("binary")), ["first"], 0.9, K)


@query("WITH k AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS judged, url FROM pages) SELECT page_id, coalesce(judged, contains(url, 'example.com')) AS hit FROM k")
def source_hit(spark, d):
    judged = F.when(F.col("page_id") % 3 == 0, True).when(F.col("page_id") % 3 == 1, False)
    return table(spark, d, "pages").select("page_id", recall.source_hit(judged, F.array("url"), F.lit("example.com")).alias("hit"))


@query(ORACLES["memory_asof_topk"])
def memory_stream(spark, d):
    """The script as a stream: writes append to a store, asks are answered from what came before."""
    from vecloom.streaming.memory import replay_conversations

    return replay_conversations(spark, d).select("conv_id", "ask_step", "write_step", r6("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))
