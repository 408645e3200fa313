"""Catalog questions: owners, snapshots, entries by ordinal or id, files by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.stats import with_totals


def newest_first() -> Column:
    """Order key of snapshots: newest, then least id."""
    return F.struct(F.col("created_at"), -F.col("snapshot_id"))


def owner_summary(snapshots: DataFrame) -> DataFrame:
    """Per owner: snapshots, entries of the latest one, bytes of all, time of the latest."""
    t = with_totals(snapshots)
    return t.groupBy("owner_id").agg(F.count(F.lit(1)).alias("snapshots"), F.max_by("messages", newest_first()).alias("latest_objects"), F.sum("size_bytes").alias("total_size_bytes"), F.max("created_at").alias("last_backup_at"))


def newest_snapshots(heads: DataFrame, n: int) -> DataFrame:
    """The newest n snapshots of each owner, ranked."""
    w = Window.partitionBy("owner_id").orderBy(F.desc("created_at"), "snapshot_id")
    return heads.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def latest_snapshot(heads: DataFrame) -> DataFrame:
    """The latest snapshot of each owner; aggregated before the shuffle, unlike a window."""
    return heads.groupBy("owner_id").agg(F.max_by(F.struct("snapshot_id", "created_at"), newest_first()).alias("s")).select("owner_id", "s.snapshot_id", "s.created_at")


def entry_ordinals(snapshots: DataFrame, limit: int | None = 50) -> DataFrame:
    """Entries with their ordinals from 1; at most `limit` of each snapshot."""
    kept = F.slice("entries", 1, limit) if limit else F.col("entries")
    return snapshots.select("owner_id", "snapshot_id", F.posexplode(kept)).select("owner_id", "snapshot_id", (F.col("pos") + 1).cast("long").alias("ordinal"), "col.object_id", "col.storage_key", "col.size_bytes")


def resolve_entry(snapshots: DataFrame, ref: Column) -> DataFrame:
    """Each snapshot's entry by an ordinal (a whole number from 1) or else by object id; null if there is none."""
    ordinal = F.when(ref.rlike(r"^[0-9]+$"), ref.try_cast("int"))
    by_id = F.get(F.filter("entries", lambda e: e["object_id"].cast("string") == ref), 0)
    return snapshots.select("owner_id", "snapshot_id", F.when(ordinal >= 1, F.get("entries", ordinal - 1)).otherwise(by_id).alias("entry"))


def find_by_path(versions: DataFrame, ref: str, path_col: str = "path", id_col: str = "file_id") -> DataFrame:
    """Versions of a file named by a path (if the reference has a slash) or by an id."""
    from tessera.functions.scalars import normalize_path

    if "/" in ref or "\\" in ref:
        return versions.where(normalize_path(F.col(path_col)) == normalize_path(F.lit(ref)))
    return versions.where(F.col(id_col) == ref)


def version_history(items: DataFrame) -> DataFrame:
    """Versions of each file in the order in which they were appended, numbered from 1."""
    w = Window.partitionBy("drive_id", "item_id").orderBy("ts", "seq")
    return items.where(~F.col("deleted") & (F.col("kind") == "file")).withColumn("version", F.row_number().over(w).cast("long"))


def earlier_versions(versions: DataFrame, current_first: bool) -> DataFrame:
    """Versions without the current one: the first listed (drives), or the one named '1' (libraries)."""
    if current_first:
        return versions.where(F.col("position") > 1)
    return versions.where(F.col("version_id") != "1")
