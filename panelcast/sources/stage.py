"""Tables written between the passes of a pipeline.

A pass that feeds several later ones is written once, as Parquet, to the folder the cluster names
in ``spark.checkpoint.dir``. That cuts the lineage, survives lost executors, lets later passes read
only the columns they need, and gives the planner real sizes to choose joins by. A session that
names no shared folder keeps the table in Spark's cache instead, which recomputes what is lost;
nothing is ever written to a folder of one machine.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: Scopes around the running code. A thread starts without any, unless it runs in a copy of its parent's context.
_scopes: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("staging_scopes", default=())


#: Frees the shuffle files of a query when it ends, not when the driver next collects garbage.
_FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of stored tables up to which the planner may choose to send them to every task.
SENT_BYTES = 1 << 20
_lock = threading.Lock()
_freeing: dict[str, int | str | None] = {"writes": 0, "before": None}


@contextmanager
def _freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files; the setting goes back once no thread writes any more.

    A query that needs such files again, to compute lost cached rows, makes them anew.
    """
    with _lock:
        if not _freeing["writes"]:
            _freeing["before"] = spark.conf.get(_FREES_SHUFFLES, None)
            spark.conf.set(_FREES_SHUFFLES, "true")
        _freeing["writes"] += 1
    try:
        yield
    finally:
        with _lock:
            _freeing["writes"] -= 1
            if not _freeing["writes"] and _freeing["before"] is None:
                spark.conf.unset(_FREES_SHUFFLES)
            elif not _freeing["writes"]:
                spark.conf.set(_FREES_SHUFFLES, _freeing["before"])


def staging_folder(spark: SparkSession) -> str | None:
    """The shared folder, or None if the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/") if folder else None


def staging_path(spark: SparkSession, name: str) -> str | None:
    folder = staging_folder(spark)
    return f"{folder}/{name}-{uuid.uuid4().hex}" if folder else None


@dataclass(frozen=True)
class Layout:
    """Rows kept in ``buckets`` buckets of ``keys``, so that work by these keys needs no shuffle."""

    buckets: int
    keys: tuple[str, ...]

    def place(self, df: DataFrame) -> DataFrame:
        """Rows in one task per bucket; the planner drops this where they are so placed already."""
        return df.repartition(self.buckets, *self.keys)

    def save(self, df: DataFrame, table: str, path: str | None = None) -> None:
        """Write a new catalog table, one sorted file per bucket."""
        writer = self.place(df).write.format("parquet").bucketBy(self.buckets, *self.keys).sortBy(*self.keys)
        (writer.option("path", path) if path else writer).saveAsTable(table)


def stage(df: DataFrame, name: str, layout: Layout | None = None) -> DataFrame:
    """Compute ``df`` once and return a reader of the result, which keeps the ``layout`` if one is given."""
    spark, path, table = df.sparkSession, staging_path(df.sparkSession, name), None
    if path is None:
        staged = (layout.place(df) if layout else df).persist(StorageLevel.MEMORY_AND_DISK)
    elif layout is None:
        with _freed_shuffles(spark):
            df.write.parquet(path)
        staged = spark.read.schema(df.schema).parquet(path)
    else:
        table = path.rsplit("/", 1)[1].replace("-", "_")
        with _freed_shuffles(spark):
            layout.save(df, table, path)
        staged = spark.table(table)
    staged.staged_path, staged.staged_table = path, table
    if _scopes.get():
        _scopes.get()[-1].append(staged)
    return staged


@contextmanager
def staging_scope() -> Iterator[None]:
    """Whatever is staged inside is deleted at the end, so results must be written or collected before.

    Without a scope staged tables stay in the shared folder, as a lazy result may still read them.
    """
    own: list[DataFrame] = []
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(token)
        for staged in own:
            unstage(staged)


def staged_result(spark: SparkSession, name: str, make: Callable[[], DataFrame],
                  layout: Layout | None = None) -> DataFrame:
    """Stage what ``make`` returns and delete what it staged on the way; in the cache everything stays."""
    if staging_folder(spark) is None:
        return stage(make(), name, layout)
    own: list[DataFrame] = []
    token = _scopes.set((*_scopes.get(), own))
    try:
        result = stage(make(), name, layout)
    finally:
        _scopes.reset(token)
    for staged in own:
        if staged is not result:
            unstage(staged)
    if _scopes.get():
        _scopes.get()[-1].append(result)
    return result


def unstage(staged: DataFrame) -> None:
    """Delete a table of ``stage`` that nothing reads any more."""
    if staged.staged_path is None:
        staged.unpersist()
        return
    spark = staged.sparkSession
    if staged.staged_table is not None:
        spark.sql(f"DROP TABLE IF EXISTS `{staged.staged_table}`")  # the files of a table at a path stay
    path = spark._jvm.org.apache.hadoop.fs.Path(staged.staged_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unsent(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df``, whose joins sort both sides if the tables that it reads have over ``most`` bytes (by default ``SENT_BYTES``).

    Keys and counts compress to a few bytes a row in files, and files are all that the planner knows of a staged table: left
    to itself it sends to every task, by way of the driver, what has thirty times the bytes and more in memory.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    stored = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return df.hint("merge") if stored > (SENT_BYTES if most is None else most) else df
