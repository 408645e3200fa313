"""Change classification of a delta stream with several states for each item, and resets of the feed.

An item's kind, its path, name and etag, and the epoch in which it was last seen are states of their own. When an owner's epoch
has risen, the feed was reset: path, name and etag of an item that is known as a file are void, and its kind
stays. The epoch comes with each row, so a reset reaches all items without a row that goes to all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.streaming.cdc_stream import OUTPUT, _change

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Tracker(StatefulProcessor):
    """Changes of one item. Deleted rows change no state; folders are remembered by their kind only."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kind = handle.getValueState("kind", "kind string")
        self.tracked = handle.getValueState("tracked", "path string, name string, etag string")
        self.epoch = handle.getValueState("epoch", "epoch bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = lambda state: state.get() if state.exists() else None
        kind, epoch = (first(s) or (None,) for s in (self.kind, self.epoch))
        known = first(self.tracked)
        kind, epoch, before, out = kind[0], epoch[0], (kind[0], epoch[0], known), []
        path, name, etag = known or (None, None, None)
        for r in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples():
            if epoch is not None and r.epoch > epoch and kind == "file":
                path = name = etag = None
            epoch = r.epoch if epoch is None else max(epoch, r.epoch)
            effective = kind if r.deleted and r.kind == "file" and kind else r.kind
            if effective != "file":
                kind = kind if r.deleted else r.kind
                continue
            if r.deleted:
                out.append((*key, r.seq, "deleted"))
                continue
            change = _change((r.path, r.name, r.etag or None), (path or None, name or None, etag))
            if change:
                out.append((*key, r.seq, change))
                path, name, etag, kind = r.path, r.name, r.etag or etag, "file"
        if kind != before[0]:
            self.kind.update((kind,))
        if epoch != before[1]:
            self.epoch.update((int(epoch),))
        if (path, name, etag) != (known or (None, None, None)):
            if (path, name, etag) == (None, None, None):
                self.tracked.clear()
            else:
                self.tracked.update((path, name, etag))
        yield pd.DataFrame(out, columns=["drive_id", "item_id", "seq", "change_type"])

    def close(self) -> None:
        pass


def tracked_changes(items: DataFrame) -> DataFrame:
    """Changes of a stream of delta items with epochs, by item; state is kept in the state store, so a restart goes on from the checkpoint."""
    items.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = items.select("drive_id", "item_id", "ts", "seq", "kind", "deleted", "path", "name", "etag", "epoch")
    return rows.groupBy("drive_id", "item_id").transformWithStateInPandas(Tracker(), OUTPUT, "append", "none")


def run_available(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    """Write what a stream has now to a table in folder, from the checkpoint there if it ran before, and read all of the table."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(OUTPUT).parquet(f"{folder}/out")


def weekly_epochs(items: DataFrame) -> DataFrame:
    """Items of a feed that is reset each week."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return items.withColumn("epoch", F.floor(day / 7).cast("long"))
