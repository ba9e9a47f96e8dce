"""Session helpers shared by queries, tests and the bench."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "lakeaccord", cores: str = "8", memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


@functools.cache
def _scratch() -> str:
    """One local folder for this process, removed at its end."""
    folder = tempfile.mkdtemp(prefix="lakeaccord-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read.

    That is what ``spark.checkpoint.dir`` names, or what was given to
    ``setCheckpointDir``. Only a local master may go without: there one machine
    holds all executors, so a scratch folder is as good as a shared one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _scratch()


def fresh_path(spark: SparkSession, purpose: str) -> str:
    """A path below the shared folder that no earlier run has used."""
    return f"{shared_folder(spark)}/lakeaccord/{purpose}-{uuid.uuid4().hex}"


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame written below the shared folder and read again: computed once, and its lineage ends there."""
    path = fresh_path(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@contextlib.contextmanager
def bucketed(spark: SparkSession, frame: DataFrame, column: str, buckets: int, purpose: str) -> Iterator[DataFrame]:
    """Within it, the frame as a table written in buckets, so that grouping by `column` again and again moves no row of it."""
    path = fresh_path(spark, purpose)
    name = f"lakeaccord_{uuid.uuid4().hex}"
    frame.write.bucketBy(buckets, column).option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> bool:
    """Removes a folder that :func:`fresh_path` gave, or one above such folders."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove_written(spark: SparkSession) -> bool:
    """Removes all that :func:`fresh_path` gave; results that were not read to the end need it no more."""
    return remove(spark, f"{shared_folder(spark)}/lakeaccord")
