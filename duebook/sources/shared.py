"""Tables written to the folder that the driver and all executors share, and who owns them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_open: ContextVar[Tables | None] = ContextVar("tables", default=None)


class Tables:
    """Owns the tables that are written while it is open (``with Tables(): ...``) and removes them when it is closed.

    What it computed must be collected or written elsewhere before that. Tables written outside any scope stay readable, and
    are removed when the application ends, as are those of a scope that is never closed.
    """

    def __init__(self) -> None:
        self._held: list[tuple[SparkSession, str, str | None]] = []

    def __enter__(self) -> Tables:
        self._token = _open.set(self)
        return self

    def __exit__(self, *_) -> None:
        _open.reset(self._token)
        self.close()

    @contextmanager
    def used(self) -> Iterator[Tables]:
        """Own what is written meanwhile, and stay open."""
        token = _open.set(self)
        try:
            yield self
        finally:
            _open.reset(token)

    @property
    def paths(self) -> list[str]:
        return [path for _, path, _ in self._held]

    def hold(self, spark: SparkSession, path: str, name: str | None = None) -> None:
        self._held.append((spark, path, name))

    def close(self) -> None:
        for spark, path, name in self._held:
            if name:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(spark, path)
        self._held.clear()


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename a folder; the parent of ``to`` is made if it is missing."""
    fs, at = _file_system(spark, path)
    target = _file_system(spark, to)[1]
    fs.mkdirs(target.getParent())
    if not fs.rename(at, target):
        raise OSError(f"cannot rename {path} to {to}")


def folder(spark: SparkSession, name: str | None = None) -> str:
    """A new path in ``spark.checkpoint.dir``, owned by the open scope; a temporary folder stands in on a local master only.

    ``name``: of a catalog table that will lie there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    return owned(spark, f"{named}/table-{uuid.uuid4().hex}", name)


def owned(spark: SparkSession, path: str, name: str | None = None) -> str:
    """A path for a table in the new folder ``path``, which is now of the open scope, and goes when the application ends."""
    fs, at = _file_system(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)  # holds for what is there
    if scope := _open.get():
        scope.hold(spark, path, name)
    return f"{path}/rows"


def written(df: DataFrame) -> DataFrame:
    """The rows, computed once and read back: each later use reads the columns that it needs, also after losing executors."""
    path = folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
