"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so the work is spread whatever the
degrees; the driver sees a count and a checksum only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.store import dropped, written


def _star(edges: DataFrame, large: bool, name: str) -> DataFrame:
    """edges(u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return written(out.where("u > v").distinct(), f"{name}-star")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node that is not the smallest of its component; edges(u, v) in any order."""
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), f"{name}-edges")

    def state(df):
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    before = state(edges)
    while before[0]:
        large = _star(edges, True, name)
        small = _star(large, False, name)
        dropped(edges, large)
        edges, after = small, state(small)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
