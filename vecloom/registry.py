"""One query for each operator that mirrors the reference, with DuckDB SQL where SQL can express it.

Collections are the embeddings table (documents c0..c9 by label); the run log is
made of events, scripts of conversations, judgments of labels and benchmark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import text as T
from vecloom.functions import vectors as V
from vecloom.functions.vectors import Metric
from vecloom.operators import memory, recall, rescore, retrieval, runs
from vecloom.operators.codecs import codec_by_name, fit_codec
from vecloom.plans import analytics
from vecloom.session import table
from vecloom.sources import formats

FLAGSHIP = "recall_report"
DIM, K, N_QUERIES = 64, 10, 100
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def queries():
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def r6(c) -> Column:
    """Six decimals, minus zero as zero."""
    return F.round(c, 6) + 0.0


def collection(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, embedding and doc of every vector."""
    return table(spark, d, "embeddings").select("vec_id", "embedding", F.concat(F.lit("c"), F.col("label").cast("string")).alias("doc"))


def self_queries(spark: SparkSession, d: str, n: int = N_QUERIES) -> DataFrame:
    return retrieval.self_queries(table(spark, d, "embeddings").select("vec_id", "embedding"), n)


def relevant(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.array(F.concat(F.lit("c"), F.col("label").cast("string"))).alias("relevant"))


# -- SQL pieces shared by the oracles -------------------------------------------------------------------------------

_E = "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, 'c' || label AS doc FROM embeddings)"
_Q = (
    f"n AS (SELECT count(*) AS n, least({N_QUERIES}, count(*)) AS m FROM embeddings), "
    "o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings), "
    "s AS (SELECT DISTINCT (j * n.n) // n.m AS i FROM n, range(n.m) t(j)), "
    "q AS (SELECT e.vec_id AS qid, e.v AS qv, e.doc AS qdoc FROM e JOIN o USING (vec_id) JOIN s USING (i))"
)


def dot_sql(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def cosine_sql(a: str, b: str) -> str:
    return f"(CASE WHEN {dot_sql(a, a)} * {dot_sql(b, b)} = 0 THEN 0.0 ELSE {dot_sql(a, b)} / sqrt({dot_sql(a, a)} * {dot_sql(b, b)}) END)"


def l2_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"


METRIC_SQL = {"dot": dot_sql, "cosine": cosine_sql, "l2": l2_sql}
INT8_SQL = (
    "lo AS (SELECT vec_id, list_min(embedding)::FLOAT AS lo, ((list_max(embedding)::FLOAT - list_min(embedding)::FLOAT) / 255::FLOAT)::FLOAT AS st, embedding FROM embeddings), "
    "ls AS (SELECT vec_id, lo, CASE WHEN st = 0 THEN 1::FLOAT ELSE st END AS sc, embedding FROM lo), "
    "i8 AS (SELECT vec_id, lo, sc, list_transform(embedding, lambda x: greatest(0, least(255, floor((((x - lo)::FLOAT / sc)::FLOAT + 0.5::FLOAT)::FLOAT)::INT))) AS q FROM ls), "
    "dec AS (SELECT vec_id, list_transform(q, lambda c: lo::DOUBLE + c * sc::DOUBLE) AS w FROM i8)"
)
BINARY_SQL = "dec AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN x > 0 THEN 0.125 ELSE -0.125 END::DOUBLE) AS w FROM e)"
CENTRED_SQL = (
    "mu AS (SELECT i, avg(x)::FLOAT::DOUBLE AS m FROM (SELECT unnest(v) AS x, unnest(range(1, 65)) AS i FROM e) GROUP BY i), "
    "mv AS (SELECT list(m ORDER BY i) AS m FROM mu), "
    "al AS (SELECT (avg(abs(x - m)))::FLOAT::DOUBLE AS a FROM (SELECT unnest(v) AS x, unnest(range(1, 65)) AS i FROM e) JOIN mu USING (i)), "
    "dec AS (SELECT vec_id, list_transform(range(1, 65), lambda i: m[i] + CASE WHEN v[i] > m[i] THEN a ELSE -a END) AS w FROM e, mv, al)"
)
MRL_SQL = "dec AS (SELECT vec_id, v[1:16] AS w FROM e)"
DECODED = {"f32": "dec AS (SELECT vec_id, v AS w FROM e)", "int8": INT8_SQL, "binary": BINARY_SQL, "binary-centred": CENTRED_SQL, "mrl16": MRL_SQL}


def top_sql(metric: str, prep: str = "", score: str | None = None, k: int = K) -> str:
    order = "ASC" if metric == "l2" else "DESC"
    score = score or METRIC_SQL[metric]("qv", "w")
    prep = prep or DECODED["f32"]
    return (
        f"WITH {_E}, {_Q}, {prep}, p AS (SELECT qid, dec.vec_id, {score} AS s FROM q, dec WHERE dec.vec_id <> qid), "
        f"t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s {order}, vec_id) AS rank FROM p) "
        f"SELECT qid, rank, vec_id, round(s, 6) + 0.0 AS score FROM t WHERE rank <= {k}"
    )


# -- J1, T1: exact top-k and top-k on codes -------------------------------------------------------------------------


def _top(spark, d, metric: str, codec: str | None = None) -> DataFrame:
    c = collection(spark, d)
    used = None if codec is None else fit_codec(codec, c, DIM)
    return retrieval.top_k(c, self_queries(spark, d), K, Metric(metric), used).select("qid", F.col("rank").cast("bigint").alias("rank"), "vec_id", r6("score").alias("score"))


def _register_tops():
    for metric in ("cosine", "dot", "l2"):
        QUERIES[f"exact_topk_{metric}"] = lambda s, d, m=metric: _top(s, d, m)
        ORACLES[f"exact_topk_{metric}"] = top_sql(metric)
    for codec, metric in (("int8", "cosine"), ("int8", "l2"), ("binary", "cosine"), ("binary", "dot"), ("binary-centred", "cosine"), ("mrl16", "cosine")):
        name = f"{codec.replace('-', '_')}_topk_{metric}"
        QUERIES[name] = lambda s, d, m=metric, c=codec: _top(s, d, m, c)
        score = METRIC_SQL[metric]("qv[1:16]" if codec == "mrl16" else "qv", "w")
        ORACLES[name] = top_sql(metric, DECODED[codec], score)
    for codec in ("pq8", "mixed8-pca", "mixed8-pca-w", "mrl32+int8", "mrl32+binary-centred"):
        QUERIES[f"{codec.replace('-', '_').replace('+', '_')}_topk_cosine"] = lambda s, d, c=codec: _top(s, d, "cosine", c)
    ORACLES["mrl32_int8_topk_cosine"] = top_sql("cosine", INT8_SQL.replace("FROM embeddings", "FROM (SELECT vec_id, embedding[1:32] AS embedding FROM embeddings)"), cosine_sql("qv[1:32]", "w"))
    ORACLES["mrl32_binary_centred_topk_cosine"] = top_sql("cosine", CENTRED_SQL.replace("FROM e)", "FROM e32)").replace("FROM e, mv", "FROM e32, mv").replace("range(1, 65)", "range(1, 33)").replace("mu AS", "e32 AS (SELECT vec_id, v[1:32] AS v FROM e), mu AS", 1), cosine_sql("qv[1:32]", "w"))


_register_tops()


@query(top_sql("cosine"))
def exact_topk_cosine_native(spark, d):
    """The same ranking by built-in expressions alone."""
    return retrieval.top_k_sql(collection(spark, d), self_queries(spark, d), K, Metric.COSINE).select("qid", F.col("rank").cast("bigint").alias("rank"), "vec_id", r6("score").alias("score"))


@query(top_sql("cosine", "dec AS (SELECT vec_id, v AS w FROM e)", "cos(pi() * len(list_filter(range(1, 65), lambda i: (qv[i] > 0) <> (w[i] > 0))) / 64)"))
def hamming_topk(spark, d):
    c = codec_by_name("binary-hamming", DIM)
    return retrieval.hamming_top_k(table(spark, d, "embeddings"), self_queries(spark, d), K, Metric.COSINE, c).select("qid", F.col("rank").cast("bigint").alias("rank"), "vec_id", r6("score").alias("score"))


# -- codes, parameters and vector functions -------------------------------------------------------------------------


@query("SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / sqrt(list_dot_product(list_transform(embedding, lambda y: y::DOUBLE), list_transform(embedding, lambda y: y::DOUBLE))), 6) + 0.0) AS unit FROM embeddings")
def normalize_vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(V.normalize(F.col("embedding")), lambda x: r6(x)).alias("unit"))


@query(f"WITH {INT8_SQL} SELECT vec_id, round(lo::DOUBLE, 6) + 0.0 AS low, round(sc::DOUBLE, 9) + 0.0 AS scale, list_sum(q)::BIGINT AS code_sum, q[1]::BIGINT AS first_code, q[64]::BIGINT AS last_code FROM i8")
def int8_codes(spark, d):
    code = codec_by_name("int8", DIM).encode_col(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", code.alias("c")).select("vec_id", r6(F.col("c.low").cast("double")).alias("low"), (F.round(F.col("c.scale").cast("double"), 9) + 0.0).alias("scale"), F.aggregate("c.q", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("code_sum"), F.get("c.q", F.lit(0)).cast("bigint").alias("first_code"), F.get("c.q", F.lit(63)).cast("bigint").alias("last_code"))


@query(f"WITH {_E}, {INT8_SQL} SELECT vec_id, round(list_max(list_transform(range(1, 65), lambda i: abs(w[i] - v[i]))), 6) + 0.0 AS worst, round(sqrt({l2_sql('v', 'w')}), 6) + 0.0 AS distance FROM e JOIN dec USING (vec_id)")
def int8_round_trip(spark, d):
    c = codec_by_name("int8", DIM)
    back = c.decode_col(c.encode_col(F.col("embedding")))
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", back.alias("w"))
    return rows.select("vec_id", r6(F.array_max(F.zip_with("embedding", "w", lambda x, y: F.abs(y - x.cast("double"))))).alias("worst"), r6(F.sqrt(V.l2_squared(F.col("embedding"), F.col("w")))).alias("distance"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x > 0))::BIGINT AS ones, list_sum(list_transform(range(0, 32), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::BIGINT << i) ELSE 0 END))::BIGINT AS low_word FROM embeddings")
def binary_codes(spark, d):
    word = F.get(codec_by_name("binary", DIM).encode_col(F.col("embedding")), F.lit(0))
    return table(spark, d, "embeddings").select("vec_id", F.bit_count(word).cast("bigint").alias("ones"), word.bitwiseAND(F.lit((1 << 32) - 1)).alias("low_word"))


@query(f"WITH {_E}, {CENTRED_SQL} SELECT i::BIGINT AS dim, round(m, 6) + 0.0 AS mean, round(a, 6) + 0.0 AS alpha FROM mu, al")
def binary_centred_params(spark, d):
    c = fit_codec("binary-centred", collection(spark, d), DIM)
    return spark.createDataFrame([(i + 1, float(m)) for i, m in enumerate(c.mean)], "dim bigint, mean double").select("dim", r6("mean").alias("mean"), r6(F.lit(float(c.alpha))).alias("alpha"))


_MOMENTS = "mo AS (SELECT i, avg(x) AS mean, var_pop(x) AS var FROM (SELECT unnest(v) AS x, unnest(range(1, 65)) AS i FROM e) GROUP BY i)"
_MIXED = (
    "gains AS (SELECT i, l, {worth} / power(4, l) AS g FROM mo, range(8) t(l)), "
    "top AS (SELECT i FROM (SELECT i, row_number() OVER (ORDER BY g DESC, i, l) AS r FROM gains) WHERE r <= 64), "
    "bits AS (SELECT mo.i, mean, var, count(top.i) AS b FROM mo LEFT JOIN top ON mo.i = top.i GROUP BY mo.i, mean, var), "
    "par AS (SELECT list(mean::FLOAT::DOUBLE ORDER BY i) AS m, list(b ORDER BY i) AS b, list(CASE WHEN b = 0 THEN 0 ELSE ([1.596, 0.9957, 0.5860, 0.3352, 0.1881, 0.1041, 0.0569, 0.0308][b] * sqrt(var))::FLOAT::DOUBLE END ORDER BY i) AS st FROM bits), "
    "dec AS (SELECT vec_id, list_transform(range(1, 65), lambda i: m[i] + CASE WHEN b[i] = 0 THEN 0 ELSE (greatest(0, least(power(2, b[i]) - 1, sign((v[i] - m[i]) / st[i] + (power(2, b[i]) - 1) / 2) * floor(abs((v[i] - m[i]) / st[i] + (power(2, b[i]) - 1) / 2) + 0.5))) - (power(2, b[i]) - 1) / 2) * st[i] END) AS w FROM e, par)"
)


@query(f"WITH {_E}, {_MOMENTS}, {_MIXED.format(worth='var').split(', par AS')[0]} SELECT i::BIGINT AS dim, b::BIGINT AS bits, round(mean, 6) + 0.0 AS mean, round(var, 6) + 0.0 AS variance FROM bits")
def mixed_bit_allocation(spark, d):
    """Moments as aggregates, and the largest gains of all (dimension, level) pairs."""
    rows = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.var_pop(F.col("x").cast("double")).alias("variance"))
    from pyspark.sql import Window

    gains = rows.select("i", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("l"), "variance").withColumn("g", F.col("variance") / F.pow(F.lit(4.0), F.col("l")))
    top = gains.withColumn("r", F.row_number().over(Window.orderBy(F.desc("g"), "i", "l"))).where("r <= 64").groupBy("i").agg(F.count(F.lit(1)).alias("bits"))
    return rows.join(top, "i", "left").select((F.col("i") + 1).cast("bigint").alias("dim"), F.coalesce("bits", F.lit(0)).cast("bigint").alias("bits"), r6("mean").alias("mean"), r6("variance").alias("variance"))


def _register_mixed():
    for name, worth in (("mixed8", "var"), ("mixed8-w", "(var * (var + mean * mean))")):
        key = f"{name.replace('-', '_')}_topk_cosine"
        QUERIES[key] = lambda s, d, c=name: _top(s, d, "cosine", c)
        ORACLES[key] = top_sql("cosine", f"{_MOMENTS}, {_MIXED.format(worth=worth)}")


_register_mixed()


@query("SELECT codec, bytes, ratio::DOUBLE AS ratio FROM (VALUES ('f32', 256, 1.0), ('int8', 72, 3.555556), ('binary', 8, 32.0), ('binary-centred', 8, 32.0), ('binary-hamming', 8, 32.0), ('pq8', 8, 32.0), ('mrl16', 64, 4.0), ('mrl32+int8', 40, 6.4), ('mixed8', 8, 32.0)) t(codec, bytes, ratio)")
def compression_table(spark, d):
    rows = [(c.name, c.size, float(c.compression_ratio)) for c in (codec_by_name(n, DIM) for n in ("f32", "int8", "binary", "binary-centred", "binary-hamming", "pq8", "mrl16", "mrl32+int8", "mixed8"))]
    return spark.createDataFrame(rows, "codec string, bytes int, ratio double").select("codec", "bytes", r6("ratio").alias("ratio"))


@query(f"WITH {_E}, {_Q} SELECT qid FROM q")
def even_subsample(spark, d):
    return self_queries(spark, d).select("qid")


# -- recall and its parts -------------------------------------------------------------------------------------------

_CODECS = ("int8", "binary", "binary-centred", "mrl16")


def _ranked_sql(codec: str, metric: str = "cosine") -> str:
    ap = METRIC_SQL[metric]("qv[1:16]" if codec == "mrl16" else "qv", "w")
    return (
        f"{_E}, {_Q}, {DECODED[codec]}, p AS (SELECT qid, qdoc, e.vec_id, doc, {METRIC_SQL[metric]('qv', 'v')} AS ex, {ap} AS ap FROM q, e JOIN dec USING (vec_id) WHERE e.vec_id <> qid), "
        f"r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ex DESC, vec_id) AS re, row_number() OVER (PARTITION BY qid ORDER BY ap DESC, vec_id) AS ra FROM p)"
    )


def _per_query_sql(k: int = K) -> str:
    return (
        f"pq AS (SELECT qid, sum(CASE WHEN re <= {k} AND ra <= {k} THEN 1 ELSE 0 END) / {float(k)} AS recall, max(CASE WHEN re = 1 AND ra = 1 THEN 1 ELSE 0 END) AS top1, "
        f"sum(abs(ap - ex)) AS err, max(abs(ap - ex)) AS worst, count(*) AS n, "
        f"abs(max(CASE WHEN re = {k} THEN ex END) - max(CASE WHEN re = {k + 1} THEN ex END)) AS gap, abs(max(CASE WHEN re = {k} THEN ex END) - max(CASE WHEN re = {2 * k} THEN ex END)) AS band, "
        f"abs(max(CASE WHEN ra = {k} THEN ap END) - max(CASE WHEN ra = {2 * k} THEN ap END)) AS band_hat, stddev_pop(CASE WHEN re <= {2 * k} THEN ap - ex END) AS noise FROM r GROUP BY qid)"
    )


_LABEL_SQL = (
    f"fd AS (SELECT qid, doc, min(ra) AS first, max(doc = qdoc) AS rel FROM r WHERE ra <= {K} GROUP BY qid, doc), "
    "po AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first) AS pos FROM fd), "
    "nd AS (SELECT qid, coalesce(sum(CASE WHEN rel THEN 1 / log2(pos + 1) END), 0.0) AS ndcg, max(CASE WHEN rel THEN 1.0 ELSE 0.0 END) AS docrec FROM po GROUP BY qid)"
)


def _report_sql(codec: str) -> str:
    size = {"int8": 72, "binary": 8, "binary-centred": 8, "mrl16": 64}[codec]
    return (
        f"(WITH {_ranked_sql(codec)}, {_per_query_sql()}, {_LABEL_SQL} SELECT '{codec}' AS codec, (SELECT count(*) FROM e) AS vectors, (SELECT count(*) FROM q) AS queries, "
        f"round(avg(recall), 6) + 0.0 AS recall_at_k, round(avg(top1), 6) + 0.0 AS top1_agreement, round(sum(err) / sum(n), 6) + 0.0 AS mean_abs_score_error, round(max(worst), 6) + 0.0 AS max_abs_score_error, "
        f"{size} AS bytes_per_vector, round(256.0 / {size}, 6) + 0.0 AS compression_ratio, count(*) AS labelled_queries, round(avg(ndcg), 6) + 0.0 AS ndcg_at_k, round(avg(docrec), 6) + 0.0 AS doc_recall_at_k, "
        f"round(median(gap), 6) + 0.0 AS boundary_gap, round(median(band), 6) + 0.0 AS neighbour_band, round(avg(noise), 6) + 0.0 AS rank_noise FROM pq JOIN nd USING (qid))"
    )


@query(" UNION ALL ".join(_report_sql(c) for c in _CODECS))
def recall_report(spark, d):
    c = collection(spark, d)
    out = recall.recall_report(c, self_queries(spark, d), [fit_codec(n, c, DIM) for n in _CODECS], Metric.COSINE, K, self_queries(spark, d).join(relevant(spark, d), "qid").select("qid", "relevant"), "doc")
    exact = ("codec", "vectors", "queries", "bytes_per_vector", "labelled_queries")
    return out.select(*[F.col(x) if x in exact else r6(x).alias(x) for x in out.columns if x not in ("metric", "k")])


def _scored(spark, d, codec: str, keep: int = K):
    c = collection(spark, d)
    return recall.ranked(recall.scored(c, self_queries(spark, d), fit_codec(codec, c, DIM), Metric.COSINE, K, keep, doc_col="doc"), Metric.COSINE, K, keep)


@query(f"WITH {_ranked_sql('binary')}, {_per_query_sql()} SELECT qid, round(recall, 6) + 0.0 AS recall, top1, round(gap, 6) + 0.0 AS gap, round(band, 6) + 0.0 AS band, round(noise, 6) + 0.0 AS noise FROM pq")
def spacing_by_query(spark, d):
    return recall.per_query(*_scored(spark, d, "binary"), K).select("qid", r6("recall").alias("recall"), "top1", r6("gap").alias("gap"), r6("band").alias("band"), r6("noise").alias("noise"))


@query(f"WITH {_ranked_sql('binary')}, {_LABEL_SQL} SELECT qid, docrec > 0 AS hit, docrec::DOUBLE AS doc_recall, round(ndcg, 6) + 0.0 AS ndcg FROM nd")
def ndcg_at_k(spark, d):
    _, approx = _scored(spark, d, "binary")
    labels = self_queries(spark, d).join(relevant(spark, d), "qid").select("qid", "relevant")
    return recall.relevance(approx.select("qid", F.col("ra").alias("rank"), "doc"), labels).select("qid", "hit", "doc_recall", r6("ndcg").alias("ndcg"))


@query(f"WITH {_ranked_sql('binary')} SELECT qid, vec_id, re, ra AS rank FROM r WHERE re <= {K}")
def first_stage_ranks(spark, d):
    c = collection(spark, d)
    return recall.first_stage_ranks(c, self_queries(spark, d), codec_by_name("binary", DIM), Metric.COSINE, K).withColumn("re", F.col("re").cast("bigint"))


@query(f"WITH {_ranked_sql('binary')}, {_per_query_sql()} SELECT qid, round(band, 6) + 0.0 AS band, round(band_hat, 6) + 0.0 AS band_hat FROM pq")
def trace_bands(spark, d):
    t = _traces(spark, d)
    return t.select("qid", r6("band").alias("band"), r6("band_hat").alias("band_hat"))


NOISE, CAP, MARGINS = 0.05, 200, [0.5, 1.0, 2.0]


def _traces(spark, d):
    return rescore.traces(collection(spark, d), self_queries(spark, d), codec_by_name("binary", DIM), Metric.COSINE, K, CAP, MARGINS, NOISE)


_QUANTILES = ", ".join(f"quantile_disc(ra, {t})::BIGINT AS depth_{round(t * 100)}" for t in rescore.TARGETS)


@query(f"WITH {_ranked_sql('binary')}, f AS (SELECT qid, max(ra) AS full_d FROM r WHERE re <= {K} GROUP BY qid) SELECT round(avg(CASE WHEN ra <= {K} THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS recall_at_k, {_QUANTILES}, (SELECT median(full_d) FROM f) AS median_full_depth FROM r WHERE re <= {K}")
def depth_for_recall(spark, d):
    c = collection(spark, d)
    out = rescore.depth_profile(recall.first_stage_ranks(c, self_queries(spark, d), codec_by_name("binary", DIM), Metric.COSINE, K), K)
    return out.withColumn("recall_at_k", r6("recall_at_k"))


_MARGIN_SQL = f"kt AS (SELECT qid, ap AS kth FROM r WHERE ra = {K}), md AS (SELECT qid, sg, greatest({K}, least({CAP}, sum(CASE WHEN ap >= kth - sg * {NOISE} AND ra <= {CAP} THEN 1 ELSE 0 END)))::BIGINT AS depth FROM r JOIN kt USING (qid), (VALUES (0.5), (1.0), (2.0)) t(sg) GROUP BY qid, sg)"


@query(f"WITH {_ranked_sql('binary')}, {_MARGIN_SQL} SELECT qid, sg::DOUBLE AS sigmas, depth FROM md")
def margin_depth(spark, d):
    _, approx = _scored(spark, d, "binary", CAP)
    return rescore.margin_depths(approx, K, CAP, MARGINS, NOISE, Metric.COSINE)


_CELL = "round(avg(recall), 6) + 0.0 AS recall_at_k, round(quantile_disc(recall, 0.1), 6) + 0.0 AS p10_recall_at_k, round(avg(top1), 6) + 0.0 AS top1_agreement, round(avg(depth), 6) + 0.0 AS mean_depth, quantile_disc(depth, 0.9)::BIGINT AS p90_depth"


def _cells_sql() -> str:
    # With an exact second stage, recall at a depth is the share of true neighbours ranked within it.
    each = "SELECT pol, second, qid, depth, sum(CASE WHEN ra <= d2 THEN 1 ELSE 0 END) / 10.0 AS recall, max(CASE WHEN re = 1 AND ra <= d2 AND ({first}) THEN 1 ELSE 0 END) AS top1 FROM ({src}) JOIN r USING (qid) WHERE re <= 10 GROUP BY pol, second, qid, depth"
    plain = each.format(first="ra = 1", src="SELECT qid, 'none' AS pol, 'none' AS second, 0 AS depth, 10 AS d2 FROM q")
    fixed = each.format(first="TRUE", src="SELECT qid, 'fixed:' || dd AS pol, 'f32' AS second, dd AS depth, dd AS d2 FROM q, (VALUES (10), (20), (50)) t(dd)")
    margin = each.format(first="TRUE", src="SELECT qid, 'margin:' || CASE WHEN sg = 0.5 THEN '0.5' WHEN sg = 1 THEN '1' ELSE '2' END AS pol, 'f32' AS second, depth, depth AS d2 FROM md")
    return f"WITH {_ranked_sql('binary')}, {_MARGIN_SQL}, x AS ({plain} UNION ALL {fixed} UNION ALL {margin}) SELECT 'binary' AS first, second, pol AS policy, {_CELL}, round((SELECT count(*) FROM e) * 8.0 + avg(depth) * CASE WHEN second = 'none' THEN 0 ELSE 256 END, 6) + 0.0 AS bytes_read_per_query FROM x GROUP BY pol, second"


@query(_cells_sql())
def rescore_cells(spark, d):
    out = rescore.rescore_cells(collection(spark, d), self_queries(spark, d), codec_by_name("binary", DIM), [codec_by_name("f32", DIM)], Metric.COSINE, K, [5, 10, 20, 50], MARGINS, NOISE, CAP)
    return out.select("first", "second", "policy", *[r6(c).alias(c) for c in ("recall_at_k", "p10_recall_at_k", "top1_agreement", "mean_depth")], "p90_depth", r6("bytes_read_per_query").alias("bytes_read_per_query"))


@query()
def rescore_calibrated(spark, d):
    """Noise calibrated on other even self-queries; labels and an int8 second stage too."""
    c = collection(spark, d)
    first = codec_by_name("binary", DIM)
    tests = self_queries(spark, d)
    noise = rescore.calibrate(c, retrieval.self_queries(c.join(tests.select(F.col("qid").alias("vec_id")), "vec_id", "left_anti").select("vec_id", "embedding"), N_QUERIES), first, Metric.COSINE, K)
    labels = tests.join(relevant(spark, d), "qid").select("qid", "relevant")
    return rescore.rescore_cells(c, tests, first, [codec_by_name("int8", DIM), codec_by_name("f32", DIM)], Metric.COSINE, K, [20, 50], [1.0, 2.0], noise, CAP, labels, "doc")


from vecloom import registry_text  # noqa: E402,F401  registers the rest
from vecloom import registry_pipelines  # noqa: E402,F401
