"""Where intermediate tables live, and how results that several steps read are written once.

Tables go to the shared folder named by ``spark.checkpoint.dir``, so they outlive lost executors. Only a local-mode
session without that setting gets a folder of its own.
"""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return f"{configured.rstrip('/')}/mirrorledger"
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.conf.get("spark.app.id")
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="mirrorledger-")
    return _local_folders[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def posix_folder(spark: SparkSession, name: str) -> str:
    """A new folder for plain files. File jobs open paths directly, so the shared folder must be a mounted one."""
    path = new_path(spark, name).removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise RuntimeError(f"file jobs need a mounted folder, not {path}")
    return path


def materialise(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Write once and read back; returns the table and its row count (counted while writing)."""
    spark = df.sparkSession
    path = new_path(spark, name)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["n"]


TASK_BYTES = 1 << 30
TASK_ROWS = 2_000


def io_tasks(work: DataFrame, size: Column, files: int = TASK_ROWS) -> int:
    """How many tasks a file job gets: about 1 GiB or 2000 files (``files``) each, and at least one per core.

    Adaptive execution would size them by their few bytes of metadata instead of the bytes they read.
    """
    planned = work.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    cores = work.sparkSession.sparkContext.defaultParallelism
    return max(1, min(planned["n"], max(cores, planned["n"] // files, planned["bytes"] // TASK_BYTES)))
