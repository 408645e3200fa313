"""Plans for restoring and saving: which entries, in which folders, under which names, and what they come to."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators import merge


def chosen_folders(folders: DataFrame, asked: DataFrame) -> DataFrame:
    """Each asked name (column name) with the folders of that name in any case, and a warning where there is none."""
    x = asked.join(folders.select("folder_id", F.lower("display_name").alias("_low")), F.lower("name") == F.col("_low"), "left").drop("_low")
    return x.withColumn("warning", F.when(F.col("folder_id").isNull(), F.concat(F.lit("folder not found: "), F.col("name"))))


def chosen_files(entries: DataFrame, refs: list[str]) -> DataFrame:
    """Entries named by an id or a path. References are lowered, and so are paths, but not ids: an id with capitals is found by its path only."""
    if not refs:
        return entries
    low = [r.lower() for r in refs]
    path = F.lower(F.concat(F.regexp_replace("parent_path", "/+$", ""), F.lit("/"), F.regexp_replace("file_name", "^/+", "")))
    return entries.where(F.col("file_id").cast("string").isin(low) | path.isin(low))


def mailbox_plan(entries: DataFrame, folders: DataFrame, start: dt.date | None = None, end: dt.date | None = None, folder: str | None = None) -> DataFrame:
    """Per owner and folder: entries and bytes to restore from the owner's snapshots in the range, newest wins, and how many come before the folder's.

    Folders follow each other by id; processed_before is the running number at which a folder begins.
    """
    x = merge.newest_wins(entries.where(merge.in_date_range(F.col("created_at"), start, end)))
    x = merge.in_folder(x, folders, folder) if folder else x
    unknown = F.coalesce("folder_id", F.lit("__unknown__")).alias("folder_id")
    g = x.groupBy("owner_id", unknown).agg(F.count(F.lit(1)).alias("entries"), F.sum(F.col("size_bytes") + F.col("att_bytes")).cast("long").alias("size_bytes"))
    before = F.coalesce(F.sum("entries").over(Window.partitionBy("owner_id").orderBy("folder_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = g.withColumn("processed_before", before.cast("long"))
    return g.join(folders, "folder_id", "left").withColumn("display_name", F.coalesce("display_name", F.lit("Unknown")))


def folder_paths(path: Column) -> Column:
    """All folders above and at a path, without the root: /a/b gives /a and /a/b; a dot and an empty path are the root."""
    parts = F.filter(F.split(F.when(path.isin("", "."), "/").otherwise(path), "/"), lambda x: x != "")
    return F.transform(parts, lambda x, i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i + 1), "/")))


def drive_plan(entries: DataFrame, refs: list[str] | None = None, count_root: bool = False) -> DataFrame:
    """Per drive: files to restore, their bytes, and folders to create (with the root where it is visited, for libraries)."""
    x = chosen_files(entries, refs or []).where(merge.restorable(F.col("change_type"), F.col("storage_key")))
    files = x.groupBy("drive_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").cast("long").alias("size_bytes"))
    paths = x.select("drive_id", F.explode(folder_paths(F.col("parent_path"))).alias("path"))
    if count_root:
        paths = paths.unionAll(x.select("drive_id", F.lit("/").alias("path")))
    made = paths.distinct().groupBy("drive_id").agg(F.count(F.lit(1)).alias("folders_created"))
    return files.join(made, "drive_id", "left").withColumn("folders_created", F.coalesce("folders_created", F.lit(0)).cast("long"))


def save_plan(entries: DataFrame, objects: DataFrame, names: DataFrame) -> DataFrame:
    """Archive entries: path in the archive and integrity (ok, mismatch, or error where the object is missing) of each entry.

    entries: folder_id, folder, ordinal, storage_key, checksum. names: folder_id, ordinal, file_name. objects: storage_key, checksum.
    """
    found = objects.groupBy("storage_key").agg(F.max("checksum").alias("found"))
    x = entries.join(names.select("folder_id", "ordinal", "file_name"), ["folder_id", "ordinal"]).join(found, "storage_key", "left")
    state = F.when(F.col("found").isNull(), "error").when(F.col("found") != F.col("checksum"), "mismatch").otherwise("ok")
    return x.withColumn("integrity", state).withColumn("path", F.concat(F.regexp_replace("folder", "^/+", ""), F.lit("/"), F.col("file_name")))


def save_summary(plan: DataFrame, by: str) -> DataFrame:
    """saved (mismatches are saved too), errors, integrity failures, and bytes by a column."""
    ok = F.col("integrity") != "error"
    return plan.groupBy(by).agg(F.count_if(ok).alias("saved"), F.count_if(~ok).alias("errors"), F.count_if(F.col("integrity") == "mismatch").alias("integrity_failures"), F.coalesce(F.sum(F.when(ok, F.col("size_bytes"))), F.lit(0)).cast("long").alias("bytes"))


def file_save(entries: DataFrame, objects: DataFrame, refs: list[str] | None = None, skip_check: bool = False) -> DataFrame:
    """The archive of drives' or libraries' snapshots: drive_id, file_id, path in the archive, size_bytes and outcome of each entry that can be restored.

    outcome: saved, missing (no object, or one that can't be opened: content null) or mismatch, which isn't saved either. The hierarchy of folders stays. objects: storage_key, found (checksum of the opened content).
    """
    x = chosen_files(entries, refs or []).where(merge.restorable(F.col("change_type"), F.col("storage_key")))
    there = objects.groupBy("storage_key").agg(F.max("found").alias("found"))
    x = x.join(there, "storage_key", "left")
    bad = F.lit(not skip_check) & (F.coalesce("checksum", F.lit("")) != "") & (F.col("found") != F.col("checksum"))
    folder = F.regexp_replace(F.regexp_replace("parent_path", "^/+", ""), "/+$", "")
    path = F.when(folder == "", F.col("file_name")).otherwise(F.concat(folder, F.lit("/"), F.col("file_name")))
    return x.select("drive_id", "file_id", path.alias("path"), "size_bytes", F.when(F.col("found").isNull(), "missing").when(bad, "mismatch").otherwise("saved").alias("outcome"))


def file_save_summary(plan: DataFrame) -> DataFrame:
    """Per drive: files saved and skipped, integrity failures, bytes saved."""
    saved = F.col("outcome") == "saved"
    return plan.groupBy("drive_id").agg(F.count_if(saved).alias("files_saved"), F.count_if(~saved).alias("files_skipped"), F.count_if(F.col("outcome") == "mismatch").alias("integrity_failures"), F.coalesce(F.sum(F.when(saved, F.col("size_bytes"))), F.lit(0)).cast("long").alias("total_bytes"))


def tenant_rollup(outcomes: DataFrame) -> DataFrame:
    """Per tenant: owners backed up and failed, and sums of stored, deduplicated and attachments, where a missing one is 0."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return outcomes.groupBy("tenant_id").agg(F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"), total("stored"), total("deduplicated"), total("attachments"))


def migration_summary(moves: DataFrame, failed: Column) -> DataFrame:
    """Scanned keys, those migrated (a dry run counts as such), failed, and distinct legacy addresses."""
    done = F.col("action") == "migrated"
    return moves.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(done & ~failed).alias("migrated"), F.count_if(done & failed).alias("failed"), F.count_distinct("email").alias("emails"))
