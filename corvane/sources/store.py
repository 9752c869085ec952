"""Tables cut from lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None
_scopes = threading.local()
_marked: set[str] = set()


def _file_system(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where that is unset, a folder of
    this process in local mode, and an error on a cluster, whose executors would
    not see it."""
    global _local_dir
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        if "://" in path:
            return path.rstrip("/")
        jpath, fs = _file_system(spark, path)  # in the file system that the cluster means
        return fs.makeQualified(jpath).toString().rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="corvane-")
        atexit.register(shutil.rmtree, _local_dir, True)
    return f"file://{_local_dir}"


def application_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; removed when it ends."""
    path = f"{shared_dir(spark)}/corvane/{spark.sparkContext.applicationId}"
    if path not in _marked:
        jpath, fs = _file_system(spark, path)
        fs.mkdirs(jpath)
        fs.deleteOnExit(jpath)
        _marked.add(path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written at ``path`` to its end."""
    jpath, fs = _file_system(spark, f"{path}/_SUCCESS")
    return fs.exists(jpath)


def remove(spark: SparkSession, path: str) -> None:
    jpath, fs = _file_system(spark, path)
    fs.delete(jpath, True)


class scratch:
    """Tables materialised inside are removed at the end, also after an error,
    but for those handed to :meth:`keep`, which pass to the scope around it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], set()

    def __enter__(self) -> scratch:
        _scopes.stack = [*getattr(_scopes, "stack", []), self]
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(df._corvane_path)
        return df

    def __exit__(self, kind, *_) -> None:
        _scopes.stack = _scopes.stack[:-1]
        for path in self.paths:
            if path in self.kept and kind is None:
                if _scopes.stack:
                    _scopes.stack[-1].paths.append(path)
            else:
                remove(self.spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, owned by the scope it is made in."""
    path = f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if getattr(_scopes, "stack", None):
        _scopes.stack[-1].paths.append(path)
    return path


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written as a table in the shared folder and read back: its lineage
    is cut, it survives lost executors and is computed once."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._corvane_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Remove a table made by :func:`materialise` that nothing reads again."""
    path = getattr(df, "_corvane_path", None)
    if path:
        remove(df.sparkSession, path)
