"""Session and shared-storage helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders chosen for applications whose configuration names none.
_own: dict[str, str] = {}
#: What is written in each open scope of this thread of work, innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A cluster names it in its configuration. Where it is unset, a folder of our own is chosen on one
    machine, one for each application; with executors elsewhere it is an error, as they would not share it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        key = spark.sparkContext.applicationId
        if key not in _own:
            _own[key] = tempfile.mkdtemp(prefix="seqspark-")
        path = _own[key]
    return path.rstrip("/")


def materialize(df: DataFrame, name: str, by: str | None = None, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage: later jobs re-read files instead of recomputing the plan, and the files
    outlive any executor. ``by`` deals the files by the values of a column; ``instead_of`` is a table of
    an earlier call that nothing needs once this one is written, and is deleted.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes.get():
        scope.append(path)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    if instead_of is not None:
        delete_table(spark, instead_of.written_to)
    return table


def delete_table(spark: SparkSession, path: str) -> None:
    """Delete a written table, through the file system that Spark knows for its path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a written table is still there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """A scope whose written tables are deleted at its end, but for those taken off the list it gives.

    What an inner scope leaves belongs to the outer one as well."""
    made: list[str] = []
    opened = _scopes.set((*_scopes.get(), made))
    try:
        yield made
    finally:
        _scopes.reset(opened)
        for path in made:
            delete_table(spark, path)


def table_bytes(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Bytes of the files of a given table."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``rows`` in ``parts`` partitions by ``keys``; None leaves it to Spark.

    Ranges and places shrink to a hundredth of their memory when they are shuffled, so Spark, which joins
    partitions up to a size in bytes of a shuffle, would put those of many sequences in one task.
    """
    return rows if parts is None else rows.repartition(parts, *keys)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
