"""Merging snapshots for restore and save: newest wins, date range, folder filter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F


def newest_wins(entries: DataFrame) -> DataFrame:
    """For each owner and object the entry of its newest snapshot.

    A grouped minimum instead of a window: rows are combined before the shuffle, so objects that are in many
    snapshots don't make a long sorted run in one task.
    """
    order = F.struct(-F.unix_micros(F.col("created_at").cast("timestamp")), F.col("snapshot_id"), F.col("line"), F.col("storage_key"), F.col("size_bytes"))
    row = F.struct("snapshot_id", "created_at", "storage_key", "folder_id", "size_bytes", "att_count", "att_bytes")
    return entries.groupBy("owner_id", "object_id").agg(F.min_by(row, order).alias("e")).select("owner_id", "object_id", "e.*")


def in_date_range(at: Column, start: dt.date | None = None, end: dt.date | None = None) -> Column:
    """From the start to the last millisecond of the end day, both included. Compared with literals, so it reaches the scan."""
    keep = F.lit(True)
    if start:
        keep &= at >= F.lit(dt.datetime.combine(start, dt.time())).cast("timestamp_ntz")
    if end:
        keep &= at < F.lit(dt.datetime.combine(end, dt.time()) + dt.timedelta(days=1)).cast("timestamp_ntz")
    return keep


def in_folder(entries: DataFrame, folders: DataFrame, name: str) -> DataFrame:
    """Entries of the folder of that name, by the first id in order; none if the name is unknown. Folders are a small dimension."""
    chosen = folders.where(F.lower("display_name") == name.lower()).agg(F.min("folder_id").alias("folder_id"))
    return entries.join(chosen, "folder_id", "left_semi")


def exclude_folders(folders: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Folders that have an id and aren't among the excluded names; a folder without a name stays."""
    return folders.where(F.col("folder_id").isNotNull() & ~F.lower(F.coalesce("display_name", F.lit(""))).isin(*names))


def folder_groups(entries: DataFrame, folders: DataFrame, unknown: str = "__unknown__") -> DataFrame:
    """Entries and bytes by folder, with its name or 'Unknown'."""
    g = entries.groupBy(F.coalesce("folder_id", F.lit(unknown)).alias("folder_id")).agg(F.count(F.lit(1)).alias("entries"), F.sum(F.col("size_bytes") + F.col("att_bytes")).alias("size_bytes"))
    return g.join(folders, "folder_id", "left").select("folder_id", F.coalesce("display_name", F.lit("Unknown")).alias("display_name"), "entries", "size_bytes")


def restorable(change_type: Column, storage_key: Column) -> Column:
    return (change_type != "deleted") & (F.coalesce(storage_key, F.lit("")) != "")


def missing_after_restore(attempted: Column, remote: Column) -> Column:
    return F.greatest(attempted - remote, F.lit(0))
