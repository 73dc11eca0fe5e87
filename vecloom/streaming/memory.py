"""The memory script as a stream: each micro-batch appends its writes to a store and answers its asks.

An ask sees every write of an earlier batch and the earlier writes of its own,
by step_index; a script's steps keep their order as files arrive in order. The
result equals the batch as-of join.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.text import normalize_answer, words
from vecloom.operators.memory import as_of_top_k, steps
from vecloom.session import shared_folder

STEP = "conv_id long, step_index long, step string, w array<string>"
ANSWER = "conv_id long, ask_step long, write_step long, score double, rank int"


def prepared(conversations: DataFrame) -> DataFrame:
    return steps(conversations).select("conv_id", "step_index", "step", F.array_distinct(words(normalize_answer(F.col("text")))).alias("w"))


def answers(asks: DataFrame, writes: DataFrame, k: int = 3) -> DataFrame:
    n = F.sqrt(F.size("ask_w").cast("double") * F.size("write_w"))
    score = F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect("ask_w", "write_w")) / F.nullif(n, F.lit(0.0)))
    top = as_of_top_k(asks.drop("step"), writes.drop("step"), score, k, ["conv_id"])
    return top.select("conv_id", F.col("ask_step_index").alias("ask_step"), F.col("write_step_index").alias("write_step"), "score", F.col("rank").cast("int").alias("rank"))


def run_stream(spark: SparkSession, source: str, store: str, out: str, checkpoint: str, k: int = 3):
    """Starts the query over Parquet step files in source; stops by itself when all are read."""

    def each(batch: DataFrame, epoch: int) -> None:
        # Overwriting a batch's own folder makes a replayed batch harmless.
        batch.where("step = 'write'").write.mode("overwrite").parquet(f"{store}/epoch={epoch}")
        before = batch.sparkSession.read.schema(f"{STEP}, epoch long").parquet(store).where(F.col("epoch") <= epoch).drop("epoch")
        answers(batch.where("step = 'ask'"), before, k).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    stream = spark.readStream.schema(STEP).option("maxFilesPerTrigger", 1).parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as two files of steps, streamed: (conv_id, ask_step, write_step, score, rank)."""
    base = f"{shared_folder(spark)}/memory-{uuid.uuid4().hex}"
    rows = prepared(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    half = F.col("step_index") <= 3
    rows.where(half).coalesce(1).write.parquet(f"{base}/steps")
    rows.where(~half).coalesce(1).write.mode("append").parquet(f"{base}/steps")
    query = run_stream(spark, f"{base}/steps", f"{base}/store", f"{base}/out", f"{base}/checkpoint")
    query.awaitTermination()
    return spark.read.schema(f"{ANSWER}, epoch long").parquet(f"{base}/out").drop("epoch")


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Runs by kind and hour of a stream (or table) of events, late ones dropped after the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
