"""Tables of the store: collections, chunks, sessions, messages and runs, as Parquet datasets below one folder.

Appends only add files; a version counts them so that a cached scan knows when
it is stale. Chunks are partitioned by collection, so reading or dropping one
touches no other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.operators.runs import COLUMNS as RUN_COLUMNS

SCHEMAS = {
    "collections": "name string, embed_profile string, embed_model string, dimension int, codec string, metric string, created_at string, codec_params binary",
    "chunks": "id long, source string, ordinal int, text string, vector binary, collection string",
    "sessions": "id string, created_at string",
    "messages": "session string, seq long, role string, content string, created_at string",
    "runs": RUN_COLUMNS,
}
PARTITIONED = {"chunks": ["collection"], "messages": ["session"]}


class CatalogError(ValueError):
    """A collection exists already, is missing, or does not fit."""


def with_counts(named: DataFrame, rows: DataFrame, key: str, foreign: str, name: str) -> DataFrame:
    """named with the number of rows that refer to each, 0 where none does."""
    counts = rows.groupBy(F.col(foreign).alias("_key")).agg(F.count(F.lit(1)).alias(name))
    return named.join(counts, named[key] == F.col("_key"), "left").drop("_key").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def describe_questions(questions: DataFrame) -> DataFrame:
    some = lambda c: F.size(c) > 0
    return questions.agg(
        F.count(F.lit(1)).alias("questions"), F.count_if(some("answers")).alias("with_answers"), F.count_if(F.col("query").isNotNull()).alias("with_query"),
        F.count_if(F.col("source").isNotNull()).alias("with_source"), F.count_if(some("relevant")).alias("judged"), F.coalesce(F.sum(F.size("relevant")), F.lit(0)).alias("judgments"),
    )


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.version = 0
        self._cached: dict[str, tuple[int, DataFrame]] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(self._path(name)) if self._exists(name) else self.spark.createDataFrame([], SCHEMAS[name])

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def append(self, name: str, rows: DataFrame) -> None:
        columns = self.spark.createDataFrame([], SCHEMAS[name]).schema
        rows.select(*[F.col(c.name).cast(c.dataType) for c in columns]).write.mode("append").partitionBy(*PARTITIONED.get(name, [])).parquet(self._path(name))
        self.version += 1

    def _one(self, name: str, row: tuple) -> None:
        self.append(name, self.spark.createDataFrame([row], SCHEMAS[name]).coalesce(1))

    # -- collections

    def collections(self) -> DataFrame:
        """Every collection with its chunk_count."""
        return with_counts(self.table("collections"), self.table("chunks"), "name", "collection", "chunk_count")

    def get(self, name: str):
        return self.table("collections").where(F.col("name") == name).first()

    def require(self, name: str):
        found = self.get(name)
        if found is None:
            raise CatalogError(f"no collection {name!r}")
        return found

    def create(self, name: str, profile: str, model: str, dimension: int, codec: str, metric: str, created_at: str, params: bytes = b"") -> None:
        if self.get(name) is not None:
            raise CatalogError(f"collection {name!r} exists")
        self._one("collections", (name, profile, model, dimension, codec, metric, created_at, bytearray(params)))

    def ensure(self, name: str, profile: str, model: str, dimension: int, codec: str, metric: str, created_at: str, params: bytes = b""):
        found = self.get(name)
        if found is None:
            self.create(name, profile, model, dimension, codec, metric, created_at, params)
            return self.require(name)
        if (found["embed_model"], found["dimension"], found["codec"]) != (model, dimension, codec):
            raise CatalogError(f"collection {name!r} holds {found['codec']} codes of {found['embed_model']} in {found['dimension']} dimensions")
        return found

    def delete(self, name: str) -> None:
        """The collection and its chunks, whose partition is dropped."""
        self.require(name)
        self._keep("collections", F.col("name") != name)
        self._remove(f"{self._path('chunks')}/collection={name}")
        self.version += 1

    def _remove(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def _keep(self, name: str, condition) -> None:
        """Leaves the rows of a table that meet the condition: written aside in full before the old files go and theirs take the place."""
        aside = f"{self._path(name)}-kept-{uuid.uuid4().hex}"
        self.table(name).where(condition).coalesce(1).write.parquet(aside)
        self._remove(self._path(name))
        place = self.spark._jvm.org.apache.hadoop.fs.Path
        if not place(aside).getFileSystem(self.spark._jsc.hadoopConfiguration()).rename(place(aside), place(self._path(name))):
            raise CatalogError(f"the rows of {name!r} stand in {aside}")

    def insert_chunks(self, name: str, rows: DataFrame) -> None:
        """rows(source, ordinal, text, vector); ids go on from the collection's last, in the order of source and ordinal.

        Numbers come from ranks within a source and the sizes of earlier sources, so that no task orders all rows.
        """
        self.require(name)
        last = self.table("chunks").where(F.col("collection") == name).agg(F.max("id").alias("m")).first()["m"] or 0
        sizes = rows.groupBy("source").count()
        spread = sizes.withColumn("_slot", F.pmod(F.xxhash64("source"), F.lit(1024)))
        slots = spread.groupBy("_slot").agg(F.sum("count").alias("n")).withColumn("_base", F.coalesce(F.sum("n").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
        before = F.coalesce(F.sum("count").over(Window.partitionBy("_slot").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = spread.withColumn("_before", before).join(F.broadcast(slots), "_slot").select("source", (F.col("_before") + F.col("_base")).alias("_from"))
        rank = F.row_number().over(Window.partitionBy("source").orderBy("ordinal"))
        self.append("chunks", rows.withColumn("_rank", rank).join(offsets, "source").withColumns({"id": F.col("_from") + F.col("_rank") + last, "collection": F.lit(name)}))

    def codes(self, name: str) -> DataFrame:
        """(id, source, vector) of a collection, cached until something is appended."""
        version, df = self._cached.get(name, (-1, None))
        if version != self.version:
            if df is not None:
                df.unpersist()
            size = self.require(name)
            df = self.table("chunks").where(F.col("collection") == name).select("id", "source", "vector").persist()
            self._cached[name] = (self.version, df)
            del size
        return df

    # -- sessions and runs

    def ensure_session(self, session: str, created_at: str) -> None:
        if self.table("sessions").where(F.col("id") == session).isEmpty():
            self._one("sessions", (session, created_at))

    def append_message(self, session: str, role: str, content: str, created_at: str) -> None:
        seq = self.table("messages").where(F.col("session") == session).agg(F.max("seq").alias("m")).first()["m"]
        self._one("messages", (session, (seq or 0) + 1, role, content, created_at))

    def messages(self, session: str) -> DataFrame:
        """A session's messages in order, of roles that are known."""
        return self.table("messages").where((F.col("session") == session) & F.col("role").isin("system", "user", "assistant")).orderBy("seq")

    def sessions(self) -> DataFrame:
        return with_counts(self.table("sessions"), self.table("messages"), "id", "session", "message_count")

    def delete_session(self, session: str) -> None:
        self._keep("sessions", F.col("id") != session)
        self._remove(f"{self._path('messages')}/session={session}")

    def insert_runs(self, rows: DataFrame) -> None:
        self.append("runs", rows)
