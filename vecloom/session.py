"""Session and table helpers shared by queries, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def local_session(cpus: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session; on a cluster the caller's own session is used instead."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, unless their import path has it as the driver's has: workers start
    in the driver's folder in local mode, or with its PYTHONPATH."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [os.path.abspath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    if root in known or getattr(spark.sparkContext, "_vecloom_shipped", False):
        return
    base = tempfile.mkdtemp()
    with zipfile.ZipFile(f"{base}/vecloom.zip", "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "vecloom")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(f"{base}/vecloom.zip")
    spark.sparkContext._vecloom_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session without one gets a temporary one, any other is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/vecloom-shared"
    return base.rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, read whole; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample_dir(sf: str = "sf0.01") -> str:
    return os.path.join(os.environ.get("TESTDATA_DIR", "/root/testdata"), sf)
