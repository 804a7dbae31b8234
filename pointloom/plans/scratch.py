"""Intermediate tables in the folder that all executors share.

A written table cuts the lineage, survives the loss of executors and is read
again with column pruning.  The folder is the one the cluster names in
``spark.checkpoint.dir``; only a session without that setting (a test, a local
shell) gets a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_WRITTEN: dict[str, SparkSession] = {}
_ORIGIN: dict[str, DataFrame] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, also set as its checkpoint folder."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = _LOCAL.setdefault(context.applicationId, tempfile.mkdtemp(prefix="pointloom-"))
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _WRITTEN[path] = spark
    _ORIGIN[_bare(path)] = df
    out = spark.read.schema(schema).parquet(path)
    out._scratch_path = path
    return out


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one, e.g. for a stream; deleted with the tables of :func:`written` when the session ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that no later plan reads."""
    path = getattr(df, "_scratch_path", None)
    if path in _WRITTEN:
        _delete(_WRITTEN.pop(path), path)


class Leftovers:
    """Tables that one step wrote for itself, deleted when a later step no longer reads them.

    A lazy result may read what its step wrote; once it has been written and read
    again, nothing does.  ``release(inputs)`` deletes the tables that were written
    inside ``with`` blocks before, but those that ``inputs`` read.
    """

    def __init__(self):
        self._paths: set[str] = set()

    def __enter__(self):
        self._before = set(_WRITTEN)
        return self

    def __exit__(self, *_):
        self._paths |= set(_WRITTEN) - self._before

    def release(self, *inputs: DataFrame) -> None:
        if not self._paths:
            return
        read = [f for df in inputs for f in df.inputFiles()]
        unread = {p for p in self._paths if not any(_bare(p) in f for f in read)}
        for path in unread & set(_WRITTEN):
            _delete(_WRITTEN.pop(path), path)
        self._paths -= unread


def _bare(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def origin_of(path: str) -> DataFrame | None:
    """What the table at ``path`` was written from, if :func:`written` wrote it and it is still there."""
    return _ORIGIN.get(_bare(path.rstrip("/")))


def _delete(spark: SparkSession, path: str) -> None:
    _ORIGIN.pop(_bare(path), None)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _drop_all() -> None:
    for path, spark in list(_WRITTEN.items()):
        _WRITTEN.pop(path)
        try:
            if spark._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session may be gone already
            return
