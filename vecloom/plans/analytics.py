"""Analyses over reports and traces: rank correlation, fits across corpora, policy replay, routing and interpolation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(df: DataFrame, col: str, keys: list[str], name: str) -> DataFrame:
    """Ranks from 1 with ties at their average."""
    w = Window.partitionBy(*keys)
    ties = F.count(F.lit(1)).over(w.partitionBy(*keys, col))
    return df.withColumn(name, F.rank().over(w.orderBy(col)) + (ties - 1) / 2)


def spearman(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    rows = average_rank(average_rank(df, x, keys, "_rx"), y, keys, "_ry")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("spearman"), F.corr(x, y).alias("pearson"))


def leave_one_out_fit(points: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """For each group, a log-log line y = a x^b through all other groups' points, and its geometric mean error on the
    group's own. Sums a group, so the points themselves are never joined with each other."""
    lx, ly = F.ln(x), F.ln(y)
    sums = points.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(lx).alias("sx"), F.sum(ly).alias("sy"), F.sum(lx * lx).alias("sxx"), F.sum(lx * ly).alias("sxy"))
    total = sums.agg(*[F.sum(c).alias(f"t_{c}") for c in ("n", "sx", "sy", "sxx", "sxy")])
    o = {c: F.col(f"t_{c}") - F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy")}
    slope = (o["n"] * o["sxy"] - o["sx"] * o["sy"]) / F.nullif(o["n"] * o["sxx"] - o["sx"] * o["sx"], F.lit(0.0))
    fits = sums.crossJoin(total).select(group, slope.alias("beta"), o["n"].alias("_n"), o["sx"].alias("_sx"), o["sy"].alias("_sy"))
    fits = fits.withColumn("alpha", F.exp((F.col("_sy") - F.col("beta") * F.col("_sx")) / F.col("_n")))
    off = F.abs(F.ln(F.col("alpha")) + F.col("beta") * lx - ly)
    return points.join(fits, group).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.max("alpha").alias("alpha"), F.max("beta").alias("beta"), F.exp(F.avg(off)).alias("geometric_error"))


def recall_at(ranks: Column, depth: Column, k: int) -> Column:
    return F.size(F.filter(ranks, lambda r: r <= depth)) / F.lit(k)


def replay(traces: DataFrame, depth: Column, k: int, policy: Column) -> DataFrame:
    """One row a policy: mean depth, recall, and their tenth and ninetieth percentiles (nearest rank)."""
    rows = traces.select(policy.alias("policy"), depth.cast("long").alias("depth"), "ranks").withColumn("recall", recall_at(F.col("ranks"), F.col("depth"), k))
    return rows.groupBy("policy").agg(
        F.count(F.lit(1)).alias("queries"), F.avg("depth").alias("mean_depth"), F.avg("recall").alias("recall"),
        F.expr("percentile_disc(0.1) within group (order by recall)").alias("p10"), F.expr("cast(percentile_disc(0.9) within group (order by depth) as bigint)").alias("p90_depth"),
    )


def fixed_curve(traces: DataFrame, depths: list[int], k: int) -> DataFrame:
    """Traces with every depth of a grid (an explode, as the grid is a literal)."""
    return replay(traces.withColumn("_d", F.explode(F.array(*[F.lit(d) for d in sorted(set(depths))]))), F.col("_d"), k, F.concat(F.lit("fixed:"), F.col("_d").cast("string")))


def ratio_depth(noise: float, scale: Column, beta: float, k: int, cap: int) -> Column:
    """a k (noise / band_hat)^beta, between k and cap; a vanishing band counts as a ratio of 50."""
    ratio = F.when(F.col("band_hat") > 0, F.lit(noise) / F.nullif(F.col("band_hat"), F.lit(0.0))).otherwise(F.lit(50.0))
    return F.least(F.lit(cap), F.greatest(F.lit(k), F.rint(scale * k * F.pow(ratio, F.lit(beta))))).cast("long")


def ratio_curve(traces: DataFrame, noise: float, beta: float, k: int, cap: int, scales: list[float] | None = None) -> DataFrame:
    scales = scales or [0.25 * 1.25**i for i in range(30)]
    rows = traces.withColumn("_a", F.explode(F.array(*[F.lit(float(a)) for a in scales])))
    return replay(rows, ratio_depth(noise, F.col("_a"), beta, k, cap), k, F.concat(F.lit("ratio:"), F.format_number("_a", 6)))


def oracle_curve(traces: DataFrame, k: int, cap: int, multipliers: list[float]) -> DataFrame:
    """For each multiplier, the depth of each query with the most recall - multiplier * depth, ties to the smaller."""
    options = F.array_distinct(F.concat(F.array(F.lit(k).cast("long")), F.filter(F.transform("ranks", lambda r: r.cast("long")), lambda r: (r > k) & (r <= cap))))
    rows = traces.withColumn("_l", F.explode(F.array(*[F.lit(float(m)) for m in multipliers])))
    rated = F.transform(options, lambda d: F.struct((recall_at(F.col("ranks"), d, k) - F.col("_l") * d).alias("worth"), (-d).alias("less"), d.alias("depth")))
    return replay(rows.withColumn("_best", F.array_max(rated)), F.col("_best.depth"), k, F.concat(F.lit("oracle:"), F.col("_l").cast("string")))


def interpolate(curve: DataFrame, budgets: list[float], x: str, ys: list[str], keys: list[str], log: bool = False) -> DataFrame:
    """Each y of a curve at each budget, on the line (in log x if asked) between neighbouring points; none outside."""
    after = Window.partitionBy(*keys).orderBy(x)
    pairs = curve.select(*keys, F.col(x).alias("_x0"), F.lead(x).over(after).alias("_x1"), *[c for y in ys for c in (F.col(y).alias(f"_{y}0"), F.lead(y).over(after).alias(f"_{y}1"))])
    rows = pairs.withColumn("budget", F.explode(F.array(*[F.lit(float(b)) for b in budgets]))).where(F.col("budget").between(F.col("_x0"), F.col("_x1")))
    g = F.ln if log else (lambda c: F.col(c) if isinstance(c, str) else c)
    span = g("_x1") - g("_x0")
    t = F.when(span == 0, F.lit(0.0)).otherwise((g("budget") - g("_x0")) / F.nullif(span, F.lit(0.0)))
    rows = rows.withColumn("_t", t).withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "budget").orderBy("_x0"))).where("_n = 1")
    return rows.select(*keys, "budget", *[(F.col(f"_{y}0") + F.col("_t") * (F.col(f"_{y}1") - F.col(f"_{y}0"))).alias(y) for y in ys])


def mean_matrix(cells: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in values])


def family_best(cells: DataFrame, family: Column, value: str, keep: list[str]) -> DataFrame:
    """The row with the largest value of each family, ties by the kept columns."""
    return cells.withColumn("family", family).groupBy("family").agg(F.max(F.struct(value, *keep)).alias("_b")).select("family", f"_b.{value}", *[f"_b.{c}" for c in keep])


def hybrid_time(scan_ms: Column, depth: Column, ns_each: Column) -> Column:
    """A scan and the re-scoring of depth vectors, in ms: an estimate, not a timing."""
    return scan_ms + depth * ns_each / 1e6


def with_ceiling(cells: DataFrame, key: str, codec_col: str, value: str) -> DataFrame:
    """Cells beside the f32 value of their key, where there is one."""
    top = cells.where(F.col(codec_col) == "f32").groupBy(F.col(key).alias("_key")).agg(F.max(value).alias("ceiling"))
    return cells.join(top, cells[key] == F.col("_key"), "left").drop("_key")


def cheapest_choice(choices: DataFrame, key: str, vectors: str, first_bytes: str, depth: str, second_bytes: int) -> DataFrame:
    """Of each key, the (codec, depth) with the fewest bytes read a query, ties to the smaller scan."""
    cost = F.col(vectors) * F.col(first_bytes) + F.col(depth) * second_bytes
    return choices.withColumn("cost", cost).groupBy(key).agg(F.min(F.struct("cost", first_bytes, "first", depth)).alias("_b")).select(key, "_b.*")


def needed_depth(ranks: DataFrame, keys: list[str], target: float, k: int) -> DataFrame:
    """The least fixed depth whose mean recall reaches target: the nearest-rank quantile of pooled ranks, k at least."""
    return ranks.groupBy(*keys).agg(F.greatest(F.lit(k), F.expr(f"cast(percentile_disc({target}) within group (order by rank) as bigint)")).alias("depth"))


def expected_depth(ratio: Column, alpha: float, beta: float, k: int, cap: int) -> Column:
    return F.least(F.lit(cap), F.greatest(F.lit(k), F.rint(F.lit(k) * F.exp(F.lit(math.log(alpha)) + F.lit(beta) * F.ln(ratio))))).cast("long")
