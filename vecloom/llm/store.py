"""Shared storage for intermediate tables, and packing of documents into groups.

Intermediate tables are written below ``spark.checkpoint.dir`` with Spark's own
writers, so a lost executor never loses them and no local path is assumed.
"""

from __future__ import annotations

import gc
import pickle
import uuid

import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes in a packed group, and text bytes that one bucket of a regrouping stands for.
GROUP_BYTES = 6 << 20
BIT_WORDS = 1 << 16
BUCKET_BYTES = 4 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder; a local session without one gets a temporary one, any other is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = f"file://{tempfile.gettempdir()}/vecloom-shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Shuffle files go when the job that made them ends, not when the JVM happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back: cuts lineage without local checkpoints."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._vecloom_path = path
    return out


def bucketed(df: DataFrame, name: str, col: str) -> DataFrame:
    """df, written once as Parquet in the shared folder, dealt by col as a shuffle would: joins and groups by it move the other side alone."""
    spark = df.sparkSession
    path, entry = shared_dir(spark, name), f"vecloom_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.repartition(n, col).write.format("parquet").option("path", path).bucketBy(n, col).saveAsTable(entry)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.table(entry)
    out.schema  # resolved here, as the entry in the catalog goes; the files stay
    spark.sql(f"DROP TABLE {entry}")
    out._vecloom_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes tables made by written() that nothing will read again."""
    for df in frames:
        if path := getattr(df, "_vecloom_path", None):
            jvm = df.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Keeps Arrow batches of long texts small: a batch is held by the JVM and by Python at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def tidy() -> None:
    """At the end of a task: gives memory that its Python worker no longer needs back to the system, as the worker lives on."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def tidied(run):
    """run, a function from batches to batches, with tidy() after its last."""

    def one(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return one


def narrowed(df: DataFrame, col: str, wanted: DataFrame, wanted_col: str) -> DataFrame:
    """The rows of df that may have a wanted value: all that do and few others, told by a table of 2**22 bits.

    The table is BIT_WORDS rows whatever the number of wanted values, so it can be sent to every task; a join after
    this moves little. With very many wanted values it lets everything pass.
    """

    def word(c):
        return F.xxhash64(c).bitwiseAND(F.lit(BIT_WORDS - 1))

    def place(c):
        return F.shiftrightunsigned(F.xxhash64(c), 32).bitwiseAND(F.lit(63)).cast("int")

    bits = wanted.select(word(wanted_col).alias("_w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), place(wanted_col)).alias("_b")).groupBy("_w").agg(F.bit_or("_b").alias("_bits"))
    held = F.call_function("shiftright", F.col("_bits"), place(col)).bitwiseAND(F.lit(1)) == 1
    return df.join(F.broadcast(bits), word(col) == F.col("_w")).where(held).select(*df.columns)


def squeeze(value) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(value, protocol=5))


def unsqueeze(blob: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def text_bytes(df: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of a text column; sizes the number of groups and buckets."""
    return df.agg(F.sum(F.octet_length(text_col)).alias("b")).first()["b"] or 0


def buckets_for(spark: SparkSession, total_bytes: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // BUCKET_BYTES), 1)


def pack_groups(df: DataFrame, id_col: str, text_col: str, name: str, packed=lambda ids, texts: (ids, texts), by_gid: bool = False) -> DataFrame:
    """Documents packed in input order into groups of about GROUP_BYTES: rows (gid, n_bytes, blob).

    The blob holds what packed makes of ids (None where null) and UTF-8 texts (b'' where null). A
    group is written once, so its id and order stay the same for every later
    stage. A text longer than a group is a group of its own. by_gid: the table is
    dealt by gid once, for stages that bring answers to the groups.
    """

    def pack(batches):
        gid = TaskContext.get().partitionId() << 24
        ids, texts, size = [], [], 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for key, text in zip(keys, batch.column(1)):
                raw = (text.as_py() or "").encode() if text.is_valid else b""
                if ids and size + len(raw) > GROUP_BYTES:
                    yield one(gid, ids, texts, size)
                    gid, ids, texts, size = gid + 1, [], [], 0
                ids.append(key)
                texts.append(raw)
                size += len(raw) + 16
        if ids:
            yield one(gid, ids, texts, size)

    def one(gid, ids, texts, size):
        import pyarrow as pa

        return pa.RecordBatch.from_pydict({"gid": [gid], "n_bytes": [size], "blob": [squeeze(packed(ids, texts))]})

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    groups = rows.mapInArrow(pack, "gid long, n_bytes long, blob binary")
    return bucketed(groups, name, "gid") if by_gid else written(groups, name)
