"""Brute-force retrieval over a collection: sampling, scoring, top-k and ranks.

The corpus is scanned once in Arrow blocks against a block of queries sent to
every task; a block keeps its best per query, so what is shuffled is the queries
times k a batch, not the pairs. Queries beyond QUERY_BLOCK are taken block by
block, so what is sent stays bounded whatever their number.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.functions.vectors import Metric, cosine_of, matrix, norm, score, score_blocks
from vecloom.operators.codecs import Codec

QUERY_BLOCK = 2048


def with_index(df: DataFrame, id_col: str) -> DataFrame:
    """df with index: each row's place from 0 in the order of an integer id.

    Ranks within ranges of ids plus the rows of earlier ranges; only one row a
    range (10,000 at most) is ordered in one place.
    """
    span = df.agg(F.min(id_col).alias("a"), F.max(id_col).alias("b")).first()
    if span["a"] is None:
        return df.withColumn("index", F.lit(0).cast("long"))
    width = max(1, (span["b"] - span["a"]) // 10_000 + 1)
    ranged = df.withColumn("_range", F.floor((F.col(id_col) - span["a"]) / width))
    sizes = ranged.groupBy("_range").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(id_col))
    return ranged.join(F.broadcast(sizes), "_range").withColumn("index", (inside - 1 + F.col("_before")).cast("long")).drop("_range", "_before")


def even_sample(df: DataFrame, m: int, id_col: str) -> DataFrame:
    """min(m, n) rows at the places floor(i * n / m)."""
    n = df.count()
    m = min(m, n)
    if m == n:
        return df
    at = F.col("index")
    # floor(i n / m) = at for some i: the least such i is ceil(at m / n).
    i = F.expr(f"(index * {m}L + {n - 1}L) div {n}L")
    return with_index(df, id_col).where((i < m) & (F.expr(f"((index * {m}L + {n - 1}L) div {n}L) * {n}L div {m}L") == at)).drop("index")


def self_queries(collection: DataFrame, m: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(qid, vector, exclude): m vectors of the collection as queries that leave themselves out."""
    return even_sample(collection.select(id_col, vector_col), m, id_col).select(F.col(id_col).alias("qid"), F.col(vector_col).alias("vector"), F.col(id_col).alias("exclude"))


@dataclass
class Queries:
    """A block of queries on the driver, QUERY_BLOCK at most."""

    ids: np.ndarray
    vectors: np.ndarray
    exclude: np.ndarray
    extra: dict = field(default_factory=dict)


def query_blocks(queries: DataFrame) -> list[Queries]:
    """The queries on the driver, QUERY_BLOCK at most in a block; a few queries take one job."""
    rows = queries.select("qid", "vector", F.coalesce("exclude", F.lit(np.iinfo(np.int64).min).cast("long")).alias("exclude"))
    first = rows.limit(QUERY_BLOCK + 1).toArrow()
    if first.num_rows <= QUERY_BLOCK:
        return [_block(first)]
    blocks = -(-queries.count() // QUERY_BLOCK)
    return [_block(rows.where(F.pmod(F.xxhash64("qid"), F.lit(2 * blocks)).isin(2 * b, 2 * b + 1)).toArrow()) for b in range(blocks)]


def _block(t: pa.Table) -> Queries:
    t = t.sort_by("qid")
    return Queries(t.column("qid").to_numpy(), matrix(t.column("vector")), t.column("exclude").to_numpy())


def best(scores: np.ndarray, ids: np.ndarray, k: int, metric: Metric) -> np.ndarray:
    """Places of the k best of one row of scores, best first, ties to the lower id; infinite worst scores left out."""
    s = -scores if metric.higher_is_better else scores
    live = np.flatnonzero(s < np.inf)
    if len(live) > k:
        edge = np.partition(s[live], k - 1)[k - 1]
        live = live[s[live] <= edge]
    return live[np.lexsort((ids[live], s[live]))][:k]


def masked(scores: np.ndarray, q: Queries, ids: np.ndarray, metric: Metric) -> np.ndarray:
    """Excluded ids get the worst score."""
    worst = -np.inf if metric.higher_is_better else np.inf
    return np.where(q.exclude[:, None] == ids[None, :], worst, scores)


def order_by_score(metric: Metric, score_col: str = "score", id_col: str = "vec_id") -> list[Column]:
    return [F.desc(score_col) if metric.higher_is_better else F.asc(score_col), F.asc(id_col)]


def top_k(collection: DataFrame, queries: DataFrame, k: int, metric: Metric, codec: Codec | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(qid, rank, vec_id, score) of the k best vectors, scored exactly or through a codec. k = 0 gives none."""
    spark = collection.sparkSession
    schema = "qid long, vec_id long, score double"
    out = None
    for q in query_blocks(queries):
        if not len(q.ids) or k < 1:
            continue

        def run(batches, q=q):
            for batch in batches:
                ids, x = batch.column(0).to_numpy(), matrix(batch.column(1))
                if not len(ids):
                    continue
                s = score_blocks(q.vectors, x, metric) if codec is None else codec.scores(q.vectors, codec.encode(x), metric)
                s = masked(s, q, ids, metric)
                at = [best(row, ids, k, metric) for row in s]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q.ids, [len(a) for a in at])), pa.array(ids[np.concatenate(at)]), pa.array(np.concatenate([r[a] for r, a in zip(s, at)]))], names=["qid", "vec_id", "score"])

        part = collection.select(F.col(id_col).cast("long").alias("vec_id"), vector_col).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    out = spark.createDataFrame([], schema) if out is None else out
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order_by_score(metric))))
    return ranked.where(F.col("rank") <= k).select("qid", "rank", "vec_id", "score")


def top_k_sql(collection: DataFrame, queries: DataFrame, k: int, metric: Metric, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The same by built-in expressions alone; a block of queries at a time is sent to the collection."""
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    corpus, out = collection.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")), None
    value = score(F.col("vector"), F.col("v"), metric)
    if metric is Metric.COSINE:  # a vector's length is taken once, not for each pair
        corpus, queries = corpus.withColumn("v_norm", norm(F.col("v"))), queries.withColumn("q_norm", norm(F.col("vector")))
        value = cosine_of(F.col("vector"), F.col("v"), F.col("q_norm") * F.col("v_norm"))
    for b in range(n):
        block = queries if n == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == b)
        pairs = corpus.crossJoin(F.broadcast(block)).where(~F.col("vec_id").eqNullSafe(F.col("exclude")))
        part = pairs.select("qid", "vec_id", value.alias("score"))
        out = part if out is None else out.unionByName(part)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order_by_score(metric))))
    return ranked.where(F.col("rank") <= k).select("qid", "rank", "vec_id", "score")


def hamming_top_k(collection: DataFrame, queries: DataFrame, k: int, metric: Metric, codec, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Top-k by differing sign bits, in 64-bit words with bit_count and no Python."""
    corpus = collection.select(F.col(id_col).alias("vec_id"), codec.encode_col(F.col(vector_col)).alias("code"))
    n, out = max(1, -(-queries.count() // QUERY_BLOCK)), None
    asked = queries.select("qid", "exclude", codec.encode_col(F.col("vector")).alias("query_code"))
    for b in range(n):
        block = asked if n == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == b)
        part = corpus.crossJoin(F.broadcast(block)).where(~F.col("vec_id").eqNullSafe(F.col("exclude"))).select("qid", "vec_id", codec.score_col(F.col("query_code"), F.col("code"), metric).alias("score"))
        out = part if out is None else out.unionByName(part)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order_by_score(metric))))
    return ranked.where(F.col("rank") <= k).select("qid", "rank", "vec_id", "score")


def hits(top: DataFrame, chunks: DataFrame, columns: list[str], id_col: str = "vec_id") -> DataFrame:
    """Late lookup: text and other columns for the k rows found."""
    return top.join(chunks.select(F.col(id_col).alias("vec_id"), *columns), "vec_id")


def texts_in_order(spark: SparkSession, ids: list[int], chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(pos, id, text) for asked ids, in their order; unknown ones are left out."""
    asked = spark.createDataFrame([(list(ids),)], "ids array<long>").select(F.posexplode("ids").alias("pos", "id"))
    return chunks.join(F.broadcast(asked), chunks[id_col] == asked["id"]).select("pos", "id", text_col).orderBy("pos")
