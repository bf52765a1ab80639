"""Tables in the folder that all executors share: they cut lineage, and lost executors cost no recomputation."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_scopes: list[list[DataFrame]] = []


@contextmanager
def temporary() -> Iterator[None]:
    """Tables that are `written` inside go at the end: for a job whose result is stored by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for df in _scopes.pop():
            discard(df)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Spark would read it from."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir.  Where that is unset, as in tests, only a local session may go on."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if "dir" not in _local:
            _local["dir"] = f"file://{tempfile.mkdtemp(prefix='spark-shared-', dir='/tmp')}"
        base = _local["dir"]
    return f"{qualified(spark, base)}/tables/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from a table in a new shared folder."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table of a `written` result that nothing reads any more, such as the last round's in a loop."""
    spark, path = df.sparkSession, df._shared_path
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
