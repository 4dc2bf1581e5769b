"""Tables written to the shared folder, so that a lost executor costs no lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local master may go without."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")
        folder = _local_dirs.get(context.applicationId)
        if folder is None:
            folder = tempfile.mkdtemp(prefix="newsloom-")
            _local_dirs[context.applicationId] = folder
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; never one that is in use."""
    return f"{shared_dir(spark).rstrip('/')}/newsloom/{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: columnar, prunable, without lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Delete a table of ``stage`` that nothing reads again."""
    for folder in {path.rsplit("/", 1)[0] for path in df.inputFiles()}:
        drop_path(df.sparkSession, folder)


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """What runs meanwhile hands rows to Python in batches of about ``size`` bytes, or one row: 10,000 long
    texts at once are held several times, by the JVM and by Python. A bound that the session has is kept."""
    if spark.conf.get(BATCH_SETTING, None) is not None:
        yield
        return
    spark.conf.set(BATCH_SETTING, str(size))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_SETTING)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that a later one replaces."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Delete the shuffle files of tables that nothing refers to; Spark does so once the driver's JVM, which may
    not be short of memory for hours, has noticed. Spark refers to the last query that ran, so a small one runs."""
    spark.range(0, 1, 1, 1).collect()
    gc.collect()
    spark._jvm.System.gc()


def path_is_complete(spark: SparkSession, path: str) -> bool:
    """True if a job finished writing ``path``; a folder left by a failed job does not count."""
    return path_exists(spark, f"{path.rstrip('/')}/_SUCCESS")
