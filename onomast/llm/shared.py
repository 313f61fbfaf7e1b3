"""The folder that all executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows that go to a Python worker at a time, while tables are written.
ROWS = 1000
_own: dict[str, str] = {}
_noted: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where that is unset on a local master, as in tests."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = sc.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="onomast-")
        found = _own[app]
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """The URI of a folder of its own in the shared one; not yet made."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def limit_batches(spark: SparkSession, rows: int = ROWS) -> str:
    """Let at most ``rows`` go to a Python worker at once, as texts may be long; gives the session's setting before."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    return before


@contextmanager
def small_batches(spark: SparkSession, rows: int = ROWS) -> Iterator[None]:
    """For the time of an action: :func:`limit_batches`.  The session's own setting comes back after it."""
    before = limit_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def written(df: DataFrame, name: str = "cut", **options: str) -> tuple[DataFrame, str]:
    """``df`` written as a Parquet table in the shared folder and read from there, and the table's URI, for :func:`remove` once nothing reads it any more."""
    spark = df.sparkSession
    uri = new_folder(spark, name)
    with small_batches(spark):
        df.write.options(**options).parquet(uri)
    return spark.read.schema(df.schema).parquet(uri), uri


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a table in the shared folder: its lineage ends, a lost executor loses nothing.  The table stays until :func:`clear`."""
    table, uri = written(df)
    _noted.append(uri)
    return table


def clear(spark: SparkSession) -> None:
    """Delete all tables that :func:`cut` has made: for when whatever reads them has been written elsewhere."""
    while _noted:
        remove(spark, _noted.pop())


def remove(spark: SparkSession, uri: str) -> None:
    """Delete a folder made by :func:`new_folder`."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
