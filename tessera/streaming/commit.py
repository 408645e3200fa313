"""Keyed tables of a stream that are saved in a fixed order and exactly once: documents, then indexes, then the cursor.

Each micro-batch replaces what a try of the same batch has left, and readers see a batch only when its cursor, which is saved last,
is whole. So a run that is killed between two steps and repeated gives the same tables as one that isn't.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

#: What is saved, in order.
STEPS = ("documents", "indexes", "cursor")


class OrderedCommit:
    """A function for foreachBatch. tables gives the rows of each step from those of a batch; before(step, batch_id) is called ahead of each step."""

    def __init__(self, folder: str, tables: dict[str, Callable[[DataFrame], DataFrame]], before: Callable[[str, int], None] | None = None):
        if tuple(tables) != STEPS:
            raise ValueError(f"steps are {STEPS}, in this order")
        self.folder, self.tables, self.before = folder, tables, before

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.DISK_ONLY)  # each step reads the batch; the source is asked once
        try:
            for step, rows in self.tables.items():
                if self.before:
                    self.before(step, batch_id)
                rows(batch).write.mode("overwrite").parquet(f"{self.folder}/{step}/batch={batch_id}")
        finally:
            batch.unpersist()


def committed(spark: SparkSession, folder: str) -> list[int]:
    """Batches whose cursor is whole, in order."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{STEPS[-1]}/batch=*/_SUCCESS")
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob)
    return sorted(int(s.getPath().getParent().getName().partition("=")[2]) for s in found or [])


def saved(spark: SparkSession, folder: str, step: str, schema: str) -> DataFrame:
    """Rows of a step of all committed batches, with the column batch."""
    paths = [f"{folder}/{step}/batch={b}" for b in committed(spark, folder)]
    if not paths:
        return spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.schema(f"{schema}, batch int").option("basePath", f"{folder}/{step}").parquet(*paths)


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The newest row of each key: an upsert of later batches over earlier ones, aggregated before the shuffle."""
    values = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(key, "_v.*")


def cursor_links(spark: SparkSession, folder: str) -> dict[str, str]:
    """The delta links to go on from, by drive: one row for each drive of an owner, so they are few."""
    rows = latest(saved(spark, folder, "cursor", "drive_id bigint, delta_link string"), "drive_id")
    return {str(r.drive_id): r.delta_link for r in rows.collect()}


def feed_tables() -> dict[str, Callable[[DataFrame], DataFrame]]:
    """What a batch of delta items saves: its items as documents, an index row for each file, and each drive's link.

    A page without items doesn't move the saved link; who starts from it reads that page again.
    """

    def documents(batch: DataFrame) -> DataFrame:
        return batch.select("drive_id", "item_id", "seq", "page", "epoch")

    def indexes(batch: DataFrame) -> DataFrame:
        files = batch.where((F.col("kind") == "file") & ~F.col("deleted"))
        return files.groupBy("drive_id", "item_id").agg(F.count(F.lit(1)).alias("versions"), F.max("seq").alias("last_seq"))

    def cursor(batch: DataFrame) -> DataFrame:
        return batch.groupBy("drive_id").agg(F.max_by("delta_link", "page").alias("delta_link"))

    return {"documents": documents, "indexes": indexes, "cursor": cursor}
