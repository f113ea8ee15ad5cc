"""Intermediate data in the folder that driver and executors share, and how long it lives.

Checkpoints and staged tables belong to the scope in which they are made.  `with work_scope(spark):` deletes its own when
it ends, after the caller has used the results; outside any, they are the process's and go when it ends.  A loop hands
tables that it has replaced to `drop`.  Under spark.cleaner.referenceTracking.cleanCheckpoints Spark may delete
checkpoints earlier, once nothing refers to them.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


class Scope:
    """Paths made in it, in the order of their making."""

    def __init__(self) -> None:
        self.paths: dict[str, SparkSession] = {}

    def close(self) -> None:
        for path, spark in list(self.paths.items()):
            delete_path(spark, path)
            self.paths.pop(path, None)


_PROCESS = Scope()
_CURRENT: ContextVar[Scope] = ContextVar("siltstone_scope", default=_PROCESS)


@atexit.register
def _close_process() -> None:
    try:
        _PROCESS.close()
    except Exception:  # noqa: BLE001  the session may have ended before the interpreter does
        return


@contextmanager
def work_scope() -> Iterator[Scope]:
    """Everything staged or checkpointed inside is deleted at the end; use up the results before that."""
    scope = Scope()
    token = _CURRENT.set(scope)
    try:
        yield scope
    finally:
        _CURRENT.reset(token)
        scope.close()


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir, which is made Spark's checkpoint folder too.

    Where it is unset, a local session gets a temporary folder, and any other master an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = getattr(spark.sparkContext, "_siltstone_work", None)
        if base is None:
            base = spark.sparkContext._siltstone_work = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a path through Hadoop's file system, so that any store works."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name in the shared folder, which belongs to the scope."""
    path = f"{work_folder(spark)}/siltstone/{label}-{uuid.uuid4().hex}"
    _CURRENT.get().paths[path] = spark
    return path


#: Drops a query's shuffle files as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
_WRITERS: dict[int, tuple[int, str]] = {}


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that end in a written table: nothing but that table is used again, so their shuffle files go at once.

    The setting is a session's; threads of one session share it, and the last to end puts it back.
    """
    key = id(spark)
    with _LOCK:
        n, before = _WRITERS.get(key, (0, spark.conf.get(CLEANUP, "false")))
        _WRITERS[key] = (n + 1, before)
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            n, before = _WRITERS.pop(key)
            if n > 1:
                _WRITERS[key] = (n - 1, before)
            else:
                spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: written once, so that every use sees the same rows in the same partitions."""
    spark = df.sparkSession
    work_folder(spark)
    with shuffles_dropped(spark):
        found = df.checkpoint(eager=True)
    path = checkpoint_path(found)
    if path:
        _CURRENT.get().paths[path] = spark
    return found


def checkpoint_path(df: DataFrame) -> str | None:
    """Where the rows of a table from `cut` lie; null for an empty one, which has no files."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    return file.get() if file.isDefined() else None


def drop(*tables: DataFrame) -> None:
    """Deletes tables from `cut` that nothing reads any more."""
    for df in tables:
        path = checkpoint_path(df)
        if path:
            delete_path(df.sparkSession, path)
            _CURRENT.get().paths.pop(path, None)


def staged(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Writes `df` as Parquet into the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def tasks(spark: SparkSession) -> int:
    """Partitions of an exchange whose number is stated, so that it is not coalesced."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
