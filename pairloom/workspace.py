"""Where intermediate tables go: the shared folder named in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only for a local master."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="pairloom-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


# Paths written since each of the open ``temporary`` blocks began.
_open: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that ``materialize`` writes inside the block; read them before it ends."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            _delete(spark, spark._jvm.org.apache.hadoop.fs.Path(path))


def exists(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _delete(spark: SparkSession, path) -> None:
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def temporary_path(spark: SparkSession, label: str) -> str:
    """A new path that goes with the innermost open ``temporary`` block, if there is one."""
    path = new_path(spark, label)
    if _open:
        _open[-1].append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage like a reliable checkpoint: losing executors costs a
    re-read, not a re-run of everything before.
    """
    spark = df.sparkSession
    path = temporary_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table ``materialize`` gave, once nothing will read it again."""
    spark = table.sparkSession
    root = shared_dir(spark)
    for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
        # The names are URIs, in which blanks and the like are encoded.
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        if path.toUri().getPath().startswith(spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath() + "/"):
            _delete(spark, path)
