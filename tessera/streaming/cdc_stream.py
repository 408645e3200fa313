"""Change classification of a delta feed as a stream with state for each item."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.sources.adapters import delta_columns

OUTPUT = "drive_id bigint, item_id bigint, seq bigint, change_type string"
STATE = "path string, name string, etag string"


def classify(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Classify one item's rows in order; the state is the path and name of the last undeleted occurrence, and the last etag of one."""
    path, name, etag = state.get if state.exists else (None, None, None)
    rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
    out = []
    for r in rows.itertuples():
        if r.deleted:
            change = "deleted"
        else:
            change = _change((r.path, r.name, r.etag or None), (path or None, name or None, etag))
            path, name, etag = r.path, r.name, r.etag or etag
        if change:
            out.append((key[0], key[1], r.seq, change))
    state.update((path, name, etag))
    yield pd.DataFrame(out, columns=["drive_id", "item_id", "seq", "change_type"])


def _change(new: tuple, old: tuple) -> str | None:
    if old == (None, None, None):
        return "created"
    if new[2] is None or new[2] != old[2]:
        return "updated"
    moved, renamed = (was is not None and was != now for was, now in zip(old[:2], new[:2]))
    return "moved_and_renamed" if moved and renamed else "moved" if moved else "renamed" if renamed else None


def changes(items: DataFrame) -> DataFrame:
    """Changes of a stream of delta items. State is kept by item in the state store, so a restart goes on from the checkpoint."""
    files = items.where(F.col("kind") == "file").withColumn("name", F.col("name")).drop("kind")
    return files.groupBy("drive_id", "item_id").applyInPandasWithState(classify, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def table_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A table as a stream of its files, in the order of their times; path may be a folder or one file."""
    # A stream's path that isn't a pattern has to be a folder.
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def run_available(spark: SparkSession, path: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """Classify all events under path as a stream, into a table of the shared folder, and read it."""
    import uuid

    from tessera.session import shared_dir

    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    rows = changes(delta_columns(table_stream(spark, path, files_per_batch)))
    query = rows.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(OUTPUT).parquet(f"{base}/out")
