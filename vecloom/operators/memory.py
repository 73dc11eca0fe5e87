"""Agent memory: an append-then-ask script, answered from what was written before each ask.

The as-of join (writes with a smaller step_index) is scored like any retrieval:
a block of asks is sent to the writes, and each keeps its best k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.operators.retrieval import QUERY_BLOCK


def steps(conversations: DataFrame) -> DataFrame:
    """(conv_id, step_index, step, text): a script for each conversation; assistant turns write, user turns ask."""
    kept = conversations.where(F.col("role").isin("user", "assistant"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
    return kept.select("conv_id", place.alias("step_index"), F.when(F.col("role") == "assistant", "write").otherwise("ask").alias("step"), "text")


def as_of_top_k(asks: DataFrame, writes: DataFrame, score: Column, k: int, keys: list[str]) -> DataFrame:
    """The k best earlier writes of each ask within the same keys; score reads ask_* and write_* columns.

    An equi-join on keys with a bound on the order of steps: a script never leaves its partition.
    """
    a = asks.select(*keys, *[F.col(c).alias(f"ask_{c}") for c in asks.columns if c not in keys])
    w = writes.select(*keys, *[F.col(c).alias(f"write_{c}") for c in writes.columns if c not in keys])
    pairs = a.join(w, keys).where(F.col("write_step_index") < F.col("ask_step_index")).withColumn("score", score)
    best = Window.partitionBy(*keys, "ask_step_index").orderBy(F.desc("score"), "write_step_index")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def as_of_top_k_global(asks: DataFrame, writes: DataFrame, score: Column, k: int) -> DataFrame:
    """The same over one script without keys: asks are sent to the writes block by block."""
    a = asks.select(*[F.col(c).alias(f"ask_{c}") for c in asks.columns])
    w = writes.select(*[F.col(c).alias(f"write_{c}") for c in writes.columns])
    blocks, out = max(1, -(-a.count() // QUERY_BLOCK)), None
    for b in range(blocks):
        part = a if blocks == 1 else a.where(F.pmod(F.xxhash64("ask_step_index"), F.lit(blocks)) == b)
        pairs = w.crossJoin(F.broadcast(part)).where(F.col("write_step_index") < F.col("ask_step_index")).withColumn("score", score)
        out = pairs if out is None else out.unionByName(pairs)
    best = Window.partitionBy("ask_step_index").orderBy(F.desc("score"), "write_step_index")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def written_totals(steps_: DataFrame, size: Column, keys: list[str]) -> DataFrame:
    """Bytes and chunks written so far after each step."""
    so_far = Window.partitionBy(*keys).orderBy("step_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.when(F.col("step") == "write", size).otherwise(F.lit(0))
    return steps_.select(*keys, "step_index", "step", own.cast("long").alias("bytes"), F.sum(own).over(so_far).cast("long").alias("cumulative_bytes"), F.sum((F.col("step") == "write").cast("long")).over(so_far).alias("cumulative_chunks"))


def word_overlap(a: Column, b: Column) -> Column:
    """Distinct words in common over the square root of both numbers: a score without a model."""
    from vecloom.functions.text import normalize_answer, words

    x, y = F.array_distinct(words(normalize_answer(a))), F.array_distinct(words(normalize_answer(b)))
    n = F.sqrt(F.size(x).cast("double") * F.size(y))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.nullif(n, F.lit(0.0)))
