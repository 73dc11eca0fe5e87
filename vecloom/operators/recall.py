"""What a codec's ranking loses against the exact one: the recall report and its parts.

One scan of the collection gives, for each query, the 2k exactly nearest and the
best by the codec, each with both scores, and sums of the score error over all
pairs; everything after works on those few rows. first_stage_ranks() takes a
second scan that counts what the codec ranks before each true neighbour.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.vectors import Metric, matrix, score_blocks
from vecloom.operators.codecs import Codec
from vecloom.operators.retrieval import best, masked, order_by_score, query_blocks

_SCHEMA = "kind string, qid long, vec_id long, doc string, ex double, ap double"


def scored(collection: DataFrame, queries: DataFrame, codec: Codec, metric: Metric, k: int, keep: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", doc_col: str | None = None) -> DataFrame:
    """Rows of three kinds: 'e' the exact 2k best, 'a' the codec's best `keep` (k if None), 's' a batch's number of
    pairs (vec_id), summed (ex) and largest (ap) score error."""
    keep = max(keep or k, 1)
    columns = [F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col), (F.col(doc_col) if doc_col else F.lit(None)).cast("string").alias("doc")]
    out = None
    for q in query_blocks(queries):

        def run(batches, q=q):
            for batch in batches:
                ids, x, doc = batch.column(0).to_numpy(), matrix(batch.column(1)), batch.column(2)
                if not len(ids) or not len(q.ids):
                    continue
                ex = score_blocks(q.vectors, x, metric)
                ap = codec.scores(q.vectors, codec.encode(x), metric)
                own = q.exclude[:, None] == ids[None, :]
                err = np.where(own, 0, np.abs(ap - ex))
                n = len(q.ids)
                yield _rows("s", q.ids, (~own).sum(1), pa.nulls(n, pa.string()), err.sum(1), err.max(1))
                for kind, s, m in (("e", ex, 2 * k + 1), ("a", ap, keep)):
                    at = [best(row, ids, m, metric) for row in masked(s, q, ids, metric)]
                    which, all_ = np.repeat(np.arange(n), [len(a) for a in at]), np.concatenate(at)
                    yield _rows(kind, q.ids[which], ids[all_], doc.take(pa.array(all_)), ex[which, all_], ap[which, all_])

        part = collection.select(*columns).mapInArrow(run, _SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def _rows(kind, qid, vec_id, doc, ex, ap):
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(qid), pa.string()), pa.array(qid, pa.int64()), pa.array(vec_id, pa.int64()), doc, pa.array(ex, pa.float64()), pa.array(ap, pa.float64())], names=["kind", "qid", "vec_id", "doc", "ex", "ap"])


def ranked(rows: DataFrame, metric: Metric, k: int, keep: int) -> tuple[DataFrame, DataFrame]:
    """The exact 2k + 1 best with rank re, and the codec's `keep` best with rank ra."""
    exact = rows.where("kind = 'e'").withColumn("re", F.row_number().over(Window.partitionBy("qid").orderBy(*order_by_score(metric, "ex")))).where(F.col("re") <= 2 * k + 1)
    approx = rows.where("kind = 'a'").withColumn("ra", F.row_number().over(Window.partitionBy("qid").orderBy(*order_by_score(metric, "ap")))).where(F.col("ra") <= keep)
    return exact.drop("kind"), approx.drop("kind")


def relevance(retrieved: DataFrame, relevant: DataFrame) -> DataFrame:
    """(qid, hit, doc_recall, ndcg) for labelled queries.

    retrieved(qid, rank, doc) are chunks, relevant(qid, relevant ARRAY<STRING>) the documents that matter. A document
    counts once, at the place of its first chunk among documents; the ideal list is as long as the relevant documents
    or the retrieved chunks, whichever are fewer (one at least).
    """
    labelled = relevant.select("qid", F.array_distinct("relevant").alias("relevant")).where(F.size("relevant") > 0)
    chunks = retrieved.groupBy("qid").agg(F.count(F.lit(1)).alias("n_chunks"))
    docs = retrieved.groupBy("qid", "doc").agg(F.min("rank").alias("first")).withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("first")))
    gain = docs.join(labelled, "qid").where(F.array_contains("relevant", F.col("doc"))).groupBy("qid").agg(F.count(F.lit(1)).alias("found"), F.sum(1 / F.log2(F.col("pos") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.size("relevant"), F.greatest(F.coalesce("n_chunks", F.lit(0)), F.lit(1))).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return labelled.join(chunks, "qid", "left").join(gain, "qid", "left").select(
        "qid",
        (F.coalesce("found", F.lit(0)) > 0).alias("hit"),
        (F.coalesce("found", F.lit(0)) / F.size("relevant")).alias("doc_recall"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
    )


def source_hit(judged_hit: Column, sources: Column, hint: Column) -> Column:
    """The judged hit if there is one, else whether any source contains the hint, else NULL."""
    return F.coalesce(judged_hit, F.when(hint.isNotNull(), F.exists(sources, lambda s: F.contains(s, hint))))


def per_query(exact: DataFrame, approx: DataFrame, k: int) -> DataFrame:
    """qid, recall, top1, gap, band, noise."""
    truth = exact.where(F.col("re") <= k).select("qid", "vec_id", "re")
    met = truth.join(approx.where(F.col("ra") <= k).select("qid", "vec_id", "ra"), ["qid", "vec_id"], "left")
    found = met.groupBy("qid").agg((F.count("ra") / F.count(F.lit(1))).alias("recall"), F.max(((F.col("re") == 1) & (F.col("ra") == 1)).cast("int")).alias("top1"))

    def at(r):
        return F.max(F.when(F.col("re") == r, F.col("ex")))

    # As two populations of 2k at most; spread of the codec's error over the exact neighbourhood.
    space = exact.groupBy("qid").agg(F.abs(at(k) - at(k + 1)).alias("gap"), F.abs(at(k) - at(2 * k)).alias("band"), F.coalesce(F.stddev_pop(F.when(F.col("re") <= 2 * k, F.col("ap") - F.col("ex"))), F.lit(0.0)).alias("noise"))
    return space.join(found, "qid", "left")


def recall_report(collection: DataFrame, queries: DataFrame, codecs: list[Codec], metric: Metric, k: int, relevant: DataFrame | None = None, doc_col: str | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a codec."""
    vectors, out = collection.agg(F.count(F.lit(1)).alias("vectors")), None
    queries = queries.persist()
    for codec in codecs:
        rows = scored(collection, queries, codec, metric, k, k, id_col, vector_col, doc_col).persist()
        exact, approx = ranked(rows, metric, k, k)
        queried = queries.agg(F.count(F.lit(1)).alias("queries"))
        each = per_query(exact, approx, k).agg(
            F.sum("recall").alias("recall"), F.sum("top1").alias("top1"),
            F.coalesce(F.median("gap"), F.lit(0.0)).alias("boundary_gap"), F.coalesce(F.median("band"), F.lit(0.0)).alias("neighbour_band"), F.sum("noise").alias("noise"),
        )
        errors = rows.where("kind = 's'").agg(F.coalesce(F.sum("ex") / F.sum("vec_id"), F.lit(0.0)).alias("mean_abs_score_error"), F.coalesce(F.max("ap"), F.lit(0.0)).alias("max_abs_score_error"))
        if relevant is None:
            labels = queries.limit(0).agg(F.count(F.lit(1)).alias("labelled_queries")).select("labelled_queries", F.lit(None).cast("double").alias("ndcg_at_k"), F.lit(None).cast("double").alias("doc_recall_at_k"))
        else:
            labels = relevance(approx.select("qid", F.col("ra").alias("rank"), "doc"), relevant).agg(F.count(F.lit(1)).alias("labelled_queries"), F.avg("ndcg").alias("ndcg_at_k"), F.avg("doc_recall").alias("doc_recall_at_k"))
        nq = F.greatest(F.col("queries"), F.lit(1))
        one = each.crossJoin(errors).crossJoin(labels).crossJoin(queried).crossJoin(vectors).select(  # single rows all
            F.lit(codec.name).alias("codec"), F.lit(metric.value).alias("metric"), F.lit(k).alias("k"), "vectors", "queries",
            (F.col("recall") / nq).alias("recall_at_k"), (F.col("top1") / nq).alias("top1_agreement"),
            "mean_abs_score_error", "max_abs_score_error", F.lit(codec.size).alias("bytes_per_vector"), F.lit(float(codec.compression_ratio)).alias("compression_ratio"),
            "labelled_queries", "ndcg_at_k", "doc_recall_at_k", "boundary_gap", "neighbour_band", (F.col("noise") / nq).alias("rank_noise"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def first_stage_ranks(collection: DataFrame, queries: DataFrame, codec: Codec, metric: Metric, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(qid, vec_id, re, rank): the codec's rank of every true neighbour, over the whole collection."""
    queries = queries.persist()
    rows = scored(collection, queries, codec, metric, k, 1, id_col, vector_col)
    truth = ranked(rows, metric, k, 1)[0].where(F.col("re") <= k).select("qid", "vec_id", "re", "ap").persist()
    out = None
    for q in query_blocks(queries):
        own = truth.where(F.col("qid").isin(*q.ids.tolist())).orderBy("qid", "re").toArrow() if len(q.ids) else None  # QUERY_BLOCK * k rows at most
        if own is None or not own.num_rows:
            continue
        place = np.searchsorted(q.ids, own.column("qid").to_numpy())
        sought, at = own.column("vec_id").to_numpy(), own.column("ap").to_numpy()

        def run(batches, q=q, place=place, sought=sought, at=at):
            total = np.zeros(len(place), np.int64)
            for batch in batches:
                ids, x = batch.column(0).to_numpy(), matrix(batch.column(1))
                if len(ids):
                    s = masked(codec.scores(q.vectors, codec.encode(x), metric), q, ids, metric)
                    s = s if metric.higher_is_better else -s
                    level = at if metric.higher_is_better else -at
                    for j in range(len(place)):
                        row = s[place[j]]
                        total[j] += ((row > level[j]) | (row == level[j]) & (ids < sought[j])).sum()
            yield pa.RecordBatch.from_arrays([pa.array(q.ids[place]), pa.array(sought), pa.array(total)], names=["qid", "vec_id", "before"])

        part = collection.select(F.col(id_col).cast("long").alias("vec_id"), vector_col).mapInArrow(run, "qid long, vec_id long, before long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return truth.select("qid", "vec_id", "re", F.lit(0).cast("long").alias("rank"))
    ranks = out.groupBy("qid", "vec_id").agg((F.sum("before") + 1).alias("rank"))
    return truth.select("qid", "vec_id", "re").join(ranks, ["qid", "vec_id"])
