"""Session helpers: the settings every job relies on, and tables cut from their lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Where cut() notes the paths of its tables, if someone collects them. Each thread has its own.
_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


def configure(spark: SparkSession) -> SparkSession:
    """Set the session options that results depend on (UTC, map merging) and adaptive execution."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master, which is
    one process, gets a folder of its own; on a cluster no folder is known to be shared, so it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: later stages start from the files.

    The table stays until drop() or release() deletes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    if (noted := _noted.get()) is not None:
        noted.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


@contextmanager
def noting() -> Iterator[list[str]]:
    """The paths of the tables that cut() writes in this thread, in the body of the with statement, in order."""
    paths: list[str] = []
    token = _noted.set(paths)
    try:
        yield paths
    finally:
        _noted.reset(token)


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() returned; nothing may read them any more. Tables that are gone are passed over."""
    for df in tables:
        _delete(df.sparkSession, [df.cut_path])


def release(spark: SparkSession, paths: Iterable[str], docs: DataFrame) -> None:
    """Delete those of the tables under paths that docs doesn't read: other frames that read them are lost."""
    read = docs.inputFiles()
    _delete(spark, [p for p in paths if not any(p.rpartition("/")[2] in f for f in read)])
