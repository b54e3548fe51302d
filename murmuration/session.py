"""The folder that all executors share, and tables written there to cut lineage.

A table in the shared folder survives the loss of executors, which ``localCheckpoint`` does not. The folder is
the one that the cluster names in ``spark.checkpoint.dir``. Where that setting is absent, a session on one machine
(master ``local``) gets a temporary folder, and any other session an error. The session's settings are not changed.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of this process's applications, with their sessions; what is left in them goes when the process ends.
_used: dict[str, SparkSession] = {}
#: The temporary folder of this process, for sessions on one machine.
_machine: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The application's folder for intermediate tables, below ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _machine_dir(spark)
    path = f"{base.rstrip('/')}/murmuration/{spark.sparkContext.applicationId}"
    if path not in _used:
        _used[path] = spark
        atexit.register(_forget, path)  # after the JVM's own exit handler, so it runs before it
    return path


def _machine_dir(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _machine:
        _machine.append(tempfile.mkdtemp(prefix="murmuration-"))
        atexit.register(shutil.rmtree, _machine[0], ignore_errors=True)
    return _machine[0]


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _forget(path: str) -> None:
    try:
        _delete(_used.pop(path), path)
    except Exception:  # noqa: BLE001 - the session has ended, and with it the way to the folder
        pass


#: Tables written within each open ``scratch``.
_scopes: list[list[Table]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Intermediate tables that operators write within it go at its end, and results must have been used by then::

        with scratch():
            similarity_groups(segments).write.parquet(path)

    Without it they stay until the process ends, since results are read from them."""
    _scopes.append([])
    try:
        yield
    finally:
        for table in _scopes.pop():
            table.drop()


#: Spark's setting to delete what a query has shuffled as soon as it ends, not when the driver next collects garbage.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go when the table that they were for is written. The setting is then as it was."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, before)


class Table:
    """A DataFrame written to the shared folder. ``df`` reads it; ``drop`` deletes its files."""

    def __init__(self, df: DataFrame, label: str) -> None:
        self._spark = df.sparkSession
        self.path = f"{shared_dir(self._spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self._spark.read.schema(df.schema).parquet(self.path)
        if _scopes:
            _scopes[-1].append(self)

    def drop(self) -> None:
        _delete(self._spark, self.path)


def write_table(df: DataFrame, label: str) -> Table:
    """Write ``df`` to the shared folder and return a handle on the copy."""
    return Table(df, label)
