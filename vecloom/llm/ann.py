"""Approximate nearest neighbours by learned partitions.

Fit (documented bound): of the SAMPLE_ROWS rows with the smallest hash two
thirds are linked to their nearest neighbours, the graph is cut into parts of
near equal size by neighbour votes under a capacity, and a small network learns
to predict the parts of a vector's neighbours. The last third, which the
network never saw, sets the number of parts to probe: the least that finds
TARGET of those rows' neighbours among themselves. There is a part for every
PART_ROWS rows, PARTITIONS at least and MOST_PARTITIONS at most.

Index: every vector goes to its most probable part; parts are split by hash
into blocks of about BLOCK_VALUES components, so a vector that a third of all
rows share fills many blocks. Search: queries are packed by part in the same
way and meet the blocks of their most probable parts in a join, so a vector
moves once and a query once for each part and lane; a block ranks its vectors
exactly, and the best of all blocks are merged.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part; nor do null ids. Inner products need equal lengths:
each length is searched by itself, and lengths too rare in the sample for a
router of their own are searched in full. Every row is a candidate of every
other, so rows sharing a vec_id count each, and each such query row has a
ranking of its own (query_row tells them apart). Equal scores rank by vec_id.
With no vector or no query the result is empty. Other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.store import written

SAMPLE_ROWS = 6144
ROUTER_ROWS = 64
PARTITIONS, MOST_PARTITIONS = 32, 128
PART_ROWS = 1 << 17
LINKS = 10
TARGET = 0.96
BLOCK_VALUES = 1 << 18
LANES = 32
HIDDEN, EPOCHS, BATCH, RATE, SEED = 64, 40, 128, 3e-3, 11


def _balanced(gain: np.ndarray, capacity: int) -> np.ndarray:
    """Each row's best part with room left, rows with the most to lose first."""
    n, m = gain.shape
    if m == 1:
        return np.zeros(n, np.int64)
    top = np.partition(gain, m - 2, axis=1)
    choice, left, out = np.argsort(-gain, 1, kind="stable"), np.full(m, capacity), np.empty(n, np.int64)
    for i in np.argsort(top[:, -2] - top[:, -1], kind="stable"):
        out[i] = p = next(p for p in choice[i] if left[p])
        left[p] -= 1
    return out


def _links(unit: np.ndarray, at: int) -> np.ndarray:
    """The nearest others of 512 rows."""
    near = unit[at : at + 512] @ unit.T
    near[np.arange(len(near)), np.arange(at, at + len(near))] = -2
    return np.argsort(-near, 1, kind="stable")[:, : min(LINKS, len(unit) - 1)]


class Router:
    """Part probabilities of a vector, and how many parts a query should visit."""

    def __init__(self, sample: np.ndarray, parts: int = PARTITIONS, k: int = 20, target: float = TARGET):
        rng = np.random.default_rng(SEED)
        held = np.arange(len(sample)) % 3 == 2
        sample, unseen = sample[~held], sample[held]
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        n, self.parts = len(unit), max(1, min(parts, len(unit) // 8))
        links = np.concatenate([_links(unit, at) for at in range(0, n, 512)])
        capacity, m = int(np.ceil(n / self.parts * 1.05)), self.parts
        centre = unit[rng.choice(n, m, False)]
        for _ in range(12):
            part = _balanced(unit @ centre.T, capacity)
            centre = np.stack([unit[part == p].sum(0) if (part == p).any() else unit[rng.integers(n)] for p in range(m)])
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
        for _ in range(8):  # cut fewer links of the graph
            votes = np.zeros((n, m))
            np.add.at(votes, (np.repeat(np.arange(n), links.shape[1]), part[links.ravel()]), 1)
            np.add.at(votes, (links.ravel(), np.repeat(part, links.shape[1])), 1)
            part = _balanced(votes + 0.5 * np.eye(m)[part] + 1e-3 * (unit @ centre.T), capacity)
        aim = 2 * np.eye(m)[part]
        np.add.at(aim, (np.repeat(np.arange(n), links.shape[1]), part[links.ravel()]), 1)
        aim /= aim.sum(1, keepdims=True)
        d = unit.shape[1]
        self.w = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, m)), np.zeros(m)]
        self._learn(unit, aim, rng)
        probe = np.arange(0, len(unseen), max(1, len(unseen) // 500))
        dots = unseen[probe] @ unseen.T
        dots[np.arange(len(probe)), probe] = -np.inf
        wanted = np.argsort(-dots, 1)[:, : min(k, len(unseen) - 1)]
        logits = self.logits(unseen)
        rank = np.argsort(np.argsort(-logits[probe], 1, kind="stable"), 1)
        need = np.take_along_axis(rank, logits.argmax(1)[wanted], 1)
        found = np.cumsum(np.bincount(need.ravel(), minlength=m)) / need.size
        self.probes = m if target >= 1 else int(np.searchsorted(found, target - 1e-12) + 1)

    def _learn(self, x: np.ndarray, aim: np.ndarray, rng) -> None:
        first, second = [np.zeros_like(v) for v in self.w], [np.zeros_like(v) for v in self.w]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(order), BATCH):
                own = x[order[at : at + BATCH]]
                h = np.maximum(own @ self.w[0] + self.w[1], 0)
                z = h @ self.w[2] + self.w[3]
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                d = (p - aim[order[at : at + BATCH]]) / len(own)
                dh = d @ self.w[2].T * (h > 0)
                step += 1
                for k, g in enumerate((own.T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                    g = g + 1e-4 * self.w[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]


def _by_length(column: pa.ListArray):
    """(length, places, matrix) of the vectors of each length in a batch."""
    sizes = np.diff(column.offsets.to_numpy())
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield int(d), at, np.asarray(column.take(pa.array(at)).flatten(), np.float64).reshape(len(at), -1)


def best_of_block(asked, queries, rows, ids, vectors, k: int, best):
    """For each query the k best of best (score, vec_id) and of a block; the row asked is left out, ties to smaller ids."""
    for a in range(0, len(asked), 256):
        dots = queries[a : a + 256] @ vectors.T
        dots[asked[a : a + 256, None] == rows[None, :]] = -np.inf
        for i, row in enumerate(dots, a):
            scores, known = best[i]
            last = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
            if len(scores) == k:
                last = max(last, scores[-1])
            near = np.flatnonzero((row > -np.inf) & (row >= last - 1e-9 * (1 + abs(last)) if np.isfinite(last) else True))
            scores = np.concatenate([scores, (queries[i] * vectors[near]).sum(1)])  # one order of summation, whatever the block
            known = np.concatenate([known, ids[near]])
            order = np.lexsort((known, -scores))[:k]
            best[i] = scores[order], known[order]


def _pack(group: pa.Table) -> pa.Table:
    """The rows of one block as one row of buffers, in the order of their numbers."""
    group = group.sort_by("row")
    vectors = group.column("v").combine_chunks()
    buffers = [group.column("row").to_numpy(), group.column("vec_id").to_numpy(), np.asarray(vectors.flatten(), np.float64)]
    keys = {c: group.column(c)[:1] for c in ("d", "part", "block")}
    return pa.table({**keys, **{c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("rows", "ids", "vectors"), buffers)}})


def _ranker(k: int):
    """Ranks the joined blocks of a task; blocks that follow one another for the same queries are merged before they are sent on."""

    def flush(asked, query_ids, best):
        take = [len(s) for s, _ in best]
        columns = [np.repeat(asked, take), np.repeat(query_ids, take), np.concatenate([i for _, i in best]), np.concatenate([s for s, _ in best])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_row", "query_id", "vec_id", "score"])

    def run(batches):
        held = None
        for batch in batches:
            for own, rows, ids, vectors, q_rows, q_ids, q_vectors in zip(*batch.columns):
                own = own.as_py()
                if held is None or held[0] != own:
                    if held is not None:
                        yield flush(*held[1:3], held[4])
                    asked = np.frombuffer(q_rows.as_buffer(), np.int64)
                    none = (np.empty(0), np.empty(0, np.int64))
                    held = own, asked.copy(), np.frombuffer(q_ids.as_buffer(), np.int64).copy(), np.frombuffer(q_vectors.as_buffer()).reshape(len(asked), -1).copy(), [none] * len(asked)
                rows = np.frombuffer(rows.as_buffer(), np.int64)
                best_of_block(held[1], held[3], rows, np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(vectors.as_buffer()).reshape(len(rows), -1), k, held[4])
        if held is not None:
            yield flush(*held[1:3], held[4])

    return run


def nearest(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score, query_row of the k nearest found of each query (ids divisible by every), by inner product."""
    spark = df.sparkSession
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    rows = written(rows, "ann-vectors")
    sample = rows.orderBy(F.xxhash64("row", "vec_id"), "row").limit(SAMPLE_ROWS).select("v").toArrow().column("v").combine_chunks()
    total = rows.agg(F.count("*").alias("n"), F.sum(F.when(F.col("vec_id") % every == 0, F.size("v"))).alias("asked")).first()
    parts = min(max(total["n"] // PART_ROWS, PARTITIONS), MOST_PARTITIONS)
    routers = {d: Router(x, parts, k, target) for d, _, x in _by_length(sample) if len(x) >= ROUTER_ROWS}

    def assign(batches):
        for batch in batches:
            part = np.zeros(batch.num_rows, np.int32)
            for d, at, x in _by_length(batch.column(2)):
                if d in routers:
                    part[at] = routers[d].logits(x).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names=["row", "vec_id", "v", "part"])

    def route(batches):
        for batch in batches:
            parts = [[0]] * batch.num_rows
            for d, at, x in _by_length(batch.column(2)):
                if d in routers:
                    for i, order in zip(at, np.argsort(-routers[d].logits(x), 1, kind="stable")[:, : routers[d].probes]):
                        parts[i] = order.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.int32()))], names=["row", "vec_id", "v", "parts"])

    packed = "d int, part int, block int, rows binary, ids binary, vectors binary"
    index = written(rows.mapInArrow(assign, "row long, vec_id long, v array<double>, part int").withColumn("d", F.size("v")), "ann-index")
    sizes = index.groupBy("d", "part").agg(F.ceil(F.count("*") * F.col("d") / BLOCK_VALUES).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block")
    stored = index.join(sizes, ["d", "part"]).select("d", "part", block, "row", "vec_id", "v").groupBy("d", "part", "block").applyInArrow(_pack, packed)
    share = F.pmod(F.xxhash64("row"), F.lit(-(-(total["asked"] or 1) // BLOCK_VALUES))).cast("int").alias("block")
    asked = rows.where(F.col("vec_id") % every == 0).mapInArrow(route, "row long, vec_id long, v array<double>, parts array<int>").select(F.size("v").alias("d"), share, "row", "vec_id", "v", F.explode("parts").alias("part"))
    asked = asked.groupBy("d", "part", "block").applyInArrow(_pack, packed).join(sizes, ["d", "part"])
    lanes = F.explode(F.sequence(F.lit(0), F.least(F.col("blocks"), F.lit(LANES)) - 1)).alias("lane")
    asked = asked.select("d", "part", lanes, F.col("block").alias("share"), *[F.col(c).alias(f"q_{c}") for c in ("rows", "ids", "vectors")])
    stored = stored.withColumn("lane", F.col("block") % LANES)
    keys, n = ["d", "part", "lane"], int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = asked.repartition(n, *keys).join(stored.repartition(n, *keys).hint("merge"), keys)
    met = met.select(F.struct(*keys, "share").alias("own"), "rows", "ids", "vectors", "q_rows", "q_ids", "q_vectors")
    found = met.mapInArrow(_ranker(k), "query_row long, query_id long, vec_id long, score double")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_row")
