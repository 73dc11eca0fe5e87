"""The run log: rows (id, kind, created_at, collection, embed_model, codec, chat_model, metadata, metrics) whose last
two columns are JSON text, and the reports that are drawn from it.

A judge row attaches to the run named in its metadata.run_id; of several, the
latest counts (by created_at, then id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = "id string, kind string, created_at string, session string, collection string, embed_model string, codec string, chat_model string, prompt string, response string, metadata string, metrics string"


def meta(key: str, prefix: str = "") -> Column:
    return F.get_json_object(F.col(f"{prefix}metadata"), f"$.{key}")


def metric(key: str, prefix: str = "") -> Column:
    return F.get_json_object(F.col(f"{prefix}metrics"), f"$.{key}")


def is_true(x: Column) -> Column:
    return F.coalesce(x == "true", F.lit(False))


def number(x: Column) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def has_gold(prefix: str = "") -> Column:
    return F.coalesce(F.size(F.from_json(meta("answers", prefix), "array<string>")) > 0, F.lit(False))


def latest(runs: DataFrame, limit: int) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def by_kinds(runs: DataFrame, *kinds: str, batch_prefix: str | None = None) -> DataFrame:
    """Rows of some kinds, oldest first; batch_prefix as in LIKE 'prefix%' (wildcards in it work)."""
    found = runs.where(F.col("kind").isin(*kinds))
    if batch_prefix is not None:
        found = found.where(meta("batch").like(f"{batch_prefix}%"))
    return found.orderBy("created_at", "id")


def by_id_prefix(runs: DataFrame, prefix: str) -> DataFrame:
    """The newest run whose id begins so; others are not told apart."""
    return runs.where(F.col("id").like(f"{prefix}%")).orderBy(F.desc("created_at"), F.desc("id")).limit(1)


def verdicts(runs: DataFrame) -> DataFrame:
    """(run_id, v_metrics): the latest verdict on each run."""
    last = Window.partitionBy("run_id").orderBy(F.desc("created_at"), F.desc("id"))
    rows = runs.where("kind = 'judge'").withColumn("run_id", meta("run_id")).where("run_id is not null")
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("run_id", F.col("metrics").alias("v_metrics"))


def judge_targets(runs: DataFrame, question_set: str | None = None, limit: int | None = None) -> DataFrame:
    """Bench runs without an error that no verdict names yet."""
    done = runs.where("kind = 'judge'").select(meta("run_id").alias("id"))
    found = runs.where("kind = 'bench'").where(meta("error").isNull()).join(done, "id", "left_anti")
    if question_set is not None:
        found = found.where(meta("question_set") == question_set)
    return found if limit is None else found.orderBy("created_at", "id").limit(limit)


KEY = ["question_set", "collection", "embed_model", "codec", "chat_model", "payload"]


def report_cells(runs: DataFrame) -> DataFrame:
    """Bench runs by KEY; each mean over the rows it applies to, NULL (0 for exact and contains) if there are none."""
    rows = runs.where("kind = 'bench'").select(
        "id", "chat_model", "metadata", "metrics",
        F.coalesce(meta("question_set"), F.lit("-")).alias("question_set"),
        *[F.coalesce(c, F.lit("-")).alias(c if c != "chat_model" else "_chat") for c in ("collection", "embed_model", "codec", "chat_model")],
        F.coalesce(meta("payload"), F.lit("none")).alias("payload"),
    ).join(verdicts(runs), F.col("id") == F.col("run_id"), "left")
    ok, gold = meta("error").isNull(), has_gold()
    judged = ok & F.col("run_id").isNotNull()

    def share(over: Column, x: Column) -> Column:
        return F.avg(F.when(over, is_true(x).cast("double")))

    def mean(over: Column, key: str) -> Column:
        return F.avg(F.when(over, number(metric(key))))

    def count(over: Column) -> Column:
        return F.count_if(over)

    ndcg, hit = metric("ndcg"), metric("source_hit")
    keys = [F.col(k) if k != "chat_model" else F.col("_chat").alias("chat_model") for k in KEY]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), count(ok & gold).alias("scored"),
        F.coalesce(share(ok & gold, metric("exact")), F.lit(0.0)).alias("exact"), F.coalesce(share(ok & gold, metric("contains")), F.lit(0.0)).alias("contains"),
        share(ok & hit.isNotNull(), hit).alias("source_hit"), mean(ok & ndcg.isNotNull(), "doc_recall").alias("doc_recall"), mean(ok & ndcg.isNotNull(), "ndcg").alias("ndcg"),
        *[F.coalesce(mean(ok, k), F.lit(0.0)).alias(f"mean_{k}") for k in ("retrieval_ms", "generation_ms", "input_tokens", "output_tokens")],
        count(~ok).alias("errors"), count(ok & meta("chat_model_served").isNotNull() & ~meta("chat_model_served").eqNullSafe(F.col("chat_model"))).alias("served_other"),
        count(judged).alias("judged"),
        share(judged & gold, F.get_json_object("v_metrics", "$.correct")).alias("judge_correct"), share(judged, F.get_json_object("v_metrics", "$.faithful")).alias("judge_faithful"),
    )


def judge_agreement(runs: DataFrame) -> DataFrame:
    """One row: how verdicts agree with the exact and contains rules, over bench runs with a verdict on correctness."""
    rows = runs.where("kind = 'bench'").join(verdicts(runs), F.col("id") == F.col("run_id")).where(F.get_json_object("v_metrics", "$.correct").isin("true", "false"))
    judge, exact, contains = is_true(F.get_json_object("v_metrics", "$.correct")), is_true(metric("exact")), is_true(metric("contains"))
    share = lambda x: F.coalesce(F.avg(x.cast("double")), F.lit(0.0))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(judge).alias("judge_true"), F.count_if(exact).alias("exact_true"), F.count_if(contains).alias("contains_true"),
        share(judge == exact).alias("agree_exact"), share(judge == contains).alias("agree_contains"),
        F.count_if(judge & ~contains).alias("judge_only"), F.count_if(contains & ~judge).alias("contains_only"),
    )


def memory_summary(runs: DataFrame) -> DataFrame:
    """Memory rows by codec, in the order in which codecs first appear; totals from the last row without an error.

    Rows without a codec are listed as '-' and counted nowhere.
    """
    rows = runs.where("kind = 'memory'")
    named = rows.withColumn("name", F.coalesce("codec", F.lit("-")))
    mine = F.col("codec").isNotNull()
    ok = mine & meta("error").isNull()
    write, ask = ok & (meta("step") == "write"), ok & (meta("step") == "ask")
    gold, hinted = ask & has_gold(), ask & metric("source_hit").isNotNull()

    def mean(over, key):
        return F.coalesce(F.avg(F.when(over, number(metric(key)))), F.lit(0.0)).alias(f"mean_{key}")

    def last(key):
        when = F.struct("created_at", "id")
        return F.coalesce(F.max_by(F.when(ok, F.coalesce(metric(key).try_cast("long"), F.lit(0))), F.when(ok, when)), F.lit(0)).cast("long")

    found = named.groupBy(F.col("name").alias("codec")).agg(
        F.min(F.struct("created_at", "id")).alias("_first"),
        F.count_if(write).alias("writes"), F.count_if(ask).alias("asks"), F.count_if(mine & ~ok).alias("errors"),
        last("cumulative_bytes").alias("total_bytes"), last("cumulative_chunks").alias("total_chunks"),
        mean(write, "write_ms"), mean(ask, "retrieval_ms"), mean(ask, "generation_ms"), mean(ask, "input_tokens"),
        F.count_if(gold).alias("scored"),
        F.coalesce(F.avg(F.when(gold, is_true(metric("exact")).cast("double"))), F.lit(0.0)).alias("exact"),
        F.coalesce(F.avg(F.when(gold, is_true(metric("contains")).cast("double"))), F.lit(0.0)).alias("contains"),
        F.avg(F.when(hinted, is_true(metric("source_hit")).cast("double"))).alias("source_hit"),
    )
    return found.withColumn("place", F.row_number().over(Window.orderBy("_first"))).drop("_first")  # a row a codec


def run_id_short(id_col: Column) -> Column:
    return F.substring(id_col, 1, 8)


def now_text() -> Column:
    """The moment, as RFC 3339 text in UTC with milliseconds, which sorts as it passes."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def matrix_product(collections: DataFrame, chats: DataFrame, questions: DataFrame) -> DataFrame:
    """Every collection with every chat model and question: the plan of a bench. The two short lists are broadcast
    where Spark finds them small."""
    return questions.crossJoin(collections).crossJoin(chats)
