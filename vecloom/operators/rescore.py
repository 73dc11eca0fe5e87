"""Two-stage search: a cheap codec picks candidates, a better one re-scores them.

Depths are fixed, or as deep as the first stage's scores stay within a margin of
its k-th (in multiples of a calibrated noise). Excluded ids never enter; with an
exact second stage the recall at a depth is the share of true neighbours that
the first stage ranks within it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.vectors import Metric, matrix
from vecloom.operators.codecs import Codec
from vecloom.operators.recall import first_stage_ranks, per_query, ranked, relevance, scored
from vecloom.operators.retrieval import order_by_score, query_blocks

TARGETS = (0.90, 0.95, 0.99, 1.0)


@dataclass(frozen=True)
class Policy:
    """none, fixed (depth) or margin (sigmas)."""

    kind: str
    depth: int = 0
    sigmas: float = 0.0

    @property
    def name(self) -> str:
        return {"none": "none", "fixed": f"fixed:{self.depth}", "margin": f"margin:{self.sigmas:g}"}[self.kind]


def policies(depths: list[int], margins: list[float], k: int, cap: int) -> list[Policy]:
    """Fixed depths are raised to k, cut to the cap, sorted and told once."""
    return [Policy("fixed", d) for d in sorted({min(max(d, k), cap) for d in depths})] + [Policy("margin", sigmas=s) for s in margins]


def calibrate(collection: DataFrame, queries: DataFrame, codec: Codec, metric: Metric, k: int) -> float:
    """The first stage's rank noise on calibration queries, which are never test queries."""
    exact, approx = ranked(scored(collection, queries, codec, metric, k, k), metric, k, k)
    return per_query(exact, approx, k).agg(F.coalesce(F.avg("noise"), F.lit(0.0)).alias("n")).first()["n"]


def depth_profile(ranks: DataFrame, k: int) -> DataFrame:
    """One row: first-stage recall, the depths that reach TARGETS over pooled ranks, and the median depth for all."""
    full = ranks.groupBy("qid").agg(F.max("rank").alias("full")).agg(F.median("full").alias("median_full_depth"))
    pooled = ranks.agg(
        (F.sum((F.col("rank") <= k).cast("int")) / k / F.count_distinct("qid")).alias("recall_at_k"),
        *[F.expr(f"cast(percentile_disc({t}) within group (order by rank) as bigint)").alias(f"depth_{round(t * 100)}") for t in TARGETS],
    )
    return pooled.crossJoin(full)  # single rows


def margin_depths(approx: DataFrame, k: int, cap: int, margins: list[float], noise: float, metric: Metric) -> DataFrame:
    """(qid, sigmas, depth): candidates within sigmas * noise of the k-th first-stage score, from k to cap."""
    kth = F.max(F.when(F.col("ra") == F.least(F.lit(k), F.col("n")), F.col("ap"))).over(Window.partitionBy("qid"))
    rows = approx.where(F.col("ra") <= cap).withColumn("n", F.max("ra").over(Window.partitionBy("qid"))).withColumn("kth", kth)
    sigmas = F.explode(F.array(*[F.lit(float(s)) for s in margins])).alias("sigmas")
    near = (F.col("ap") >= F.col("kth") - F.col("sigmas") * noise) if metric.higher_is_better else (F.col("ap") <= F.col("kth") + F.col("sigmas") * noise)
    found = rows.select("qid", "ap", "kth", "n", sigmas).groupBy("qid", "sigmas").agg(F.sum(near.cast("long")).alias("inside"), F.max("n").alias("n"))
    return found.select("qid", "sigmas", F.least(F.greatest("inside", F.lit(k)), F.col("n")).cast("long").alias("depth"))


def second_scores(approx: DataFrame, collection: DataFrame, queries: DataFrame, second: Codec, metric: Metric, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """approx with second: the second codec's score of every candidate, joined to its vector by id."""
    vectors = collection.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    out = None
    for q in query_blocks(queries):
        place = {int(i): n for n, i in enumerate(q.ids)}

        def run(batches, q=q, place=place):
            for batch in batches:
                if not batch.num_rows:
                    continue
                codes = second.encode(matrix(batch.column(2)))
                at = [place[i] for i in batch.column(0).to_pylist()]
                s, order = np.empty(len(at)), np.argsort(at, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(np.take(at, order))) + 1):  # a query's candidates at once
                    s[own] = second.scores(q.vectors[at[own[0]]][None, :], codes[own], metric)[0]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=["qid", "vec_id", "second"])

        pairs = approx.where(F.col("qid").isin(*q.ids.tolist())).select("qid", "vec_id").join(vectors, "vec_id").select("qid", "vec_id", "v")
        part = pairs.mapInArrow(run, "qid long, vec_id long, second double")
        out = part if out is None else out.unionByName(part)
    return approx.join(out, ["qid", "vec_id"])


def rescore_cells(collection: DataFrame, queries: DataFrame, first: Codec, seconds: list[Codec], metric: Metric, k: int, depths: list[int], margins: list[float], noise: float, max_depth: int, relevant: DataFrame | None = None, doc_col: str | None = None) -> DataFrame:
    """One row for each (second, policy): mean and p90 depth, recall, p10 recall, top-1 agreement, labels, bytes read."""
    n = collection.count()
    cap = min(max(max_depth, k), n)
    queries = queries.persist()
    rows = scored(collection, queries, first, metric, k, cap, doc_col=doc_col).persist()
    exact, approx = (x.persist() for x in ranked(rows, metric, k, cap))
    truth = exact.where(F.col("re") <= k).select("qid", "vec_id", "re")
    live = approx.groupBy("qid").agg(F.max("ra").alias("n"))
    cells = [(None, Policy("none"), approx.where(F.col("ra") <= k).withColumn("rank", F.col("ra")), live.select("qid", F.lit(0).cast("long").alias("depth")))]
    deep = margin_depths(approx, k, cap, margins, noise, metric).persist() if margins else None
    for second in seconds:
        again = second_scores(approx, collection, queries, second, metric).persist()
        for p in policies(depths, margins, k, cap):
            depth = live.select("qid", F.least(F.lit(p.depth), F.col("n")).cast("long").alias("depth")) if p.kind == "fixed" else deep.where(F.col("sigmas") == p.sigmas).select("qid", "depth")
            kept = again.join(depth, "qid").where(F.col("ra") <= F.col("depth"))
            # Equal second scores keep the first stage's order.
            order = [order_by_score(metric, "second")[0], F.asc("ra")]
            kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= k)
            cells.append((second, p, kept, depth))
    out = None
    for second, p, kept, depth in cells:
        met = truth.join(kept.select("qid", "vec_id", "rank"), ["qid", "vec_id"], "left").groupBy("qid").agg((F.count("rank") / F.count(F.lit(1))).alias("recall"), F.max(((F.col("re") == 1) & (F.col("rank") == 1)).cast("int")).alias("top1"))
        size = second.size if second else 0
        agg = met.join(depth, "qid").agg(
            F.avg("depth").alias("mean_depth"), F.expr("cast(percentile_disc(0.9) within group (order by depth) as bigint)").alias("p90_depth"),
            F.avg("recall").alias("recall_at_k"), F.expr("percentile_disc(0.1) within group (order by recall)").alias("p10_recall_at_k"), F.avg("top1").alias("top1_agreement"),
        )
        if relevant is not None:
            agg = agg.crossJoin(relevance(kept.select("qid", "rank", "doc"), relevant).agg(F.avg("ndcg").alias("ndcg_at_k"), F.avg("doc_recall").alias("doc_recall_at_k")))
        one = agg.withColumns({"first": F.lit(first.name), "second": F.lit(second.name if second else "none"), "policy": F.lit(p.name), "bytes_read_per_query": F.lit(float(n * first.size)) + F.col("mean_depth") * size})
        out = one if out is None else out.unionByName(one)
    return out


def traces(collection: DataFrame, queries: DataFrame, codec: Codec, metric: Metric, k: int, cap: int, margins: list[float], noise: float) -> DataFrame:
    """(qid, ranks, band, band_hat, margin_depths): all that replaying a policy needs."""
    queries = queries.persist()
    rows = scored(collection, queries, codec, metric, k, cap).persist()
    exact, approx = ranked(rows, metric, k, cap)
    ranks = first_stage_ranks(collection, queries, codec, metric, k).groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("re", "rank"))), lambda x: x["rank"]).alias("ranks"))

    def gap(rank, s):
        return F.abs(F.max(F.when(F.col(rank) == k, F.col(s))) - F.max(F.when(F.col(rank) == 2 * k, F.col(s))))

    bands = exact.groupBy("qid").agg(F.coalesce(gap("re", "ex"), F.lit(0.0)).alias("band"))
    hats = approx.groupBy("qid").agg(F.coalesce(gap("ra", "ap"), F.lit(0.0)).alias("band_hat"))
    deep = margin_depths(approx, k, cap, margins, noise, metric).groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("sigmas", "depth"))), lambda x: x["depth"]).alias("margin_depths"))
    return ranks.join(bands, "qid").join(hats, "qid").join(deep, "qid")
