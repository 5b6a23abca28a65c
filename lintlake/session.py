"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Stages whose generated method is too long for the JIT run as split
    # projections instead: wide rule packs stay compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Python steps take whole files: batches are bounded by bytes.
    "spark.sql.execution.arrow.maxBytesPerBatch": "67108864",
    # Keyed state of streams lives on disk and is saved as changes, not whole.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(app: str = "lintlake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, taking the one the cluster names first.

    Only a local master without ``spark.checkpoint.dir`` gets a folder of its
    own; on a cluster a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="lintlake-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


WORK_FOLDER: ContextVar[str | None] = ContextVar("work_folder", default=None)


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def settled_under(spark: SparkSession, folder: str) -> Iterator[None]:
    """Tables settled inside the block go to ``folder``, which is removed at its end, also after an error.

    For work that repeats, such as micro-batches: nothing of it is left behind. Write all results inside the block.
    """
    token = WORK_FOLDER.set(folder)
    try:
        yield
    finally:
        WORK_FOLDER.reset(token)
        remove_folder(spark, folder)


def settle(df: DataFrame) -> DataFrame:
    """Write a table that a plan reads several times to the checkpoint folder, as Parquet, and read it back.

    Everything upstream runs once, the rows survive a lost executor, and plans
    built on the result stay short. ``forget_settled`` removes the files.
    """
    spark = df.sparkSession
    folder = WORK_FOLDER.get() or f"{ensure_checkpoint_dir(spark).rstrip('/')}/settled/{spark.sparkContext.applicationId}"
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget_settled(spark: SparkSession) -> None:
    """Remove the settled tables of this application; call it when no result that builds on them is read any more."""
    remove_folder(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/settled/{spark.sparkContext.applicationId}")
