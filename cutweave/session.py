"""Session builder and the shared folder through which lineage is cut."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def build_session(app: str = "cutweave", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the jobs assume: AQE, UTC, Arrow."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one if all run
    on this machine; else an error, as executors would each write to a disk of their own."""
    global _own_dir
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is unset: set it to a folder that driver and executors share")
    if _own_dir is None or not os.path.isdir(_own_dir):
        _own_dir = tempfile.mkdtemp(prefix="spark-cutweave-")
    return "file://" + _own_dir


def new_path(spark: SparkSession, what: str = "table") -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, what: str = "table") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, and survives lost executors.

    The shuffle files that made it are dropped once it is written, so a chain of tables never holds more disk than its
    longest step.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    if _scopes:
        _scopes[-1].tables.append(out)
    return out


#: A table that Spark may broadcast unasked within ``by_shuffles``.
BROADCAST = "1m"


def by_shuffles(job: Callable) -> Callable:
    """A function (of a session, and more) within which Spark broadcasts only small tables unasked. Its default takes written
    tables of 10 MB, which are several times that in memory and go through the driver, once a join."""

    @wraps(job)
    def run(spark: SparkSession, *args, **more):
        names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
        before = {n: spark.conf.get(n, None) for n in names}
        for n in names:
            spark.conf.set(n, BROADCAST)
        try:
            return job(spark, *args, **more)
        finally:
            for n, value in before.items():
                spark.conf.unset(n) if value is None else spark.conf.set(n, value)

    return run


@contextmanager
def dealt_by_fewer_keys(spark: SparkSession) -> Iterator[None]:
    """Joins that run inside take rows that both sides have dealt by some of their keys as they are. Else Spark deals them out
    anew, by all keys."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def dealt(df: DataFrame, parts: int, *columns: str) -> DataFrame:
    """``df`` dealt by columns to so many tasks, if they are more than run at once: for rows of which a task is to hold no more
    the more there are, where a session's count of shuffle partitions stays as it is."""
    return df.repartition(parts, *columns) if parts > df.sparkSession.sparkContext.defaultParallelism else df


class Scope:
    """The tables that are written while a scope is the innermost; those not kept are deleted when it ends."""

    def __init__(self):
        self.tables: list[DataFrame] = []
        self.kept: list[DataFrame] = []

    def keep(self, table: DataFrame) -> DataFrame:
        """A written table that outlives the scope; it then belongs to the scope around."""
        self.kept.append(table)
        return table


_scopes: list[Scope] = []


@contextmanager
def scope() -> Iterator[Scope]:
    """Delete what ``materialise`` writes inside, however it ends, but for what is kept."""
    own = Scope()
    _scopes.append(own)
    try:
        yield own
    finally:
        _scopes.pop()
        for table in own.tables:
            if not any(table is k for k in own.kept):
                discard(table)
            elif _scopes:
                _scopes[-1].tables.append(table)


def scoped(build: Callable[[], DataFrame], what: str = "table") -> DataFrame:
    """What ``build`` makes, written; every table that it writes on the way is deleted."""
    with scope() as own:
        return own.keep(materialise(build(), what))


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder, in whatever store it is; one that isn't there is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def discard(table: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote and that nothing reads any more."""
    remove(table.sparkSession, table._written_at)
