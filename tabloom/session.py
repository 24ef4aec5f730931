"""Session helpers: a local session for tests and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_fallback_roots: dict[str, str] = {}


def local_session(cores: str = "*", name: str = "tabloom", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks. Jobs on a cluster bring their own."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A temporary folder is taken only on a local master that names none.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    app = spark.sparkContext.applicationId
    if app not in _fallback_roots:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        _fallback_roots[app] = tempfile.mkdtemp(prefix="tabloom-")
    return _fallback_roots[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder."""
    return os.path.join(shared_root(spark), f"{label}-{uuid.uuid4().hex}")


def scratch_table(label: str) -> str:
    """A new, unused table name."""
    return f"{label}_{uuid.uuid4().hex[:12]}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through the file system that holds it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


_scopes: list[set[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Everything that is written as scratch inside, by whatever operator, goes at the end.

    For jobs that store their result inside the scope: a lazy result that is used after it
    would miss its tables.
    """
    scope: set[str] = set()
    _scopes.append(scope)
    try:
        yield
    finally:
        _scopes.remove(scope)
        for path in scope:
            drop_path(spark, path)


class Scratch:
    """Tables written to the shared folder, with an owner that removes them.

    Operators that write intermediate tables take the ``Scratch`` of their caller, or make
    one of their own, which the ``scratch_scope`` around them owns. What a lazy result
    still reads must stay until that result has been used; ``drop`` removes single tables
    as soon as nothing reads them.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, str] = {}
        self._folders: list[str] = []
        self._scope = _scopes[-1] if _scopes else set()

    def path(self, label: str) -> str:
        """A new path for files that are not a table."""
        path = scratch_path(self.spark, label)
        self._folders.append(path)
        self._scope.add(path)
        return path

    def write(self, df: DataFrame, label: str, **options: str) -> DataFrame:
        """The rows written once, for plans that read them several times.

        Later steps read only the columns they need, and a lost executor costs one task of
        a file read instead of the whole computation.
        """
        path = scratch_path(self.spark, label)
        df.write.options(**options).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(back)] = path
        self._scope.add(path)
        back._scratch = self  # keeps the id taken while the table is known
        return back

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            path = self._paths.pop(id(frame), None)
            if path:
                self._scope.discard(path)
                drop_path(self.spark, path)

    def close(self) -> None:
        for path in [*self._paths.values(), *self._folders]:
            self._scope.discard(path)
            drop_path(self.spark, path)
        self._paths.clear()
        self._folders.clear()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def written(df: DataFrame, label: str, scratch: Scratch | None = None) -> DataFrame:
    """The rows written once to the shared folder, owned by ``scratch`` if there is one."""
    return (scratch or Scratch(df.sparkSession)).write(df, label)
