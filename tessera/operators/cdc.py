"""Change classification of delta feeds in batch, with remembered state as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def present(x: Column) -> Column:
    """Null for an empty string, which counts as missing."""
    return F.nullif(x, F.lit(""))


def change_type(deleted: Column, path: Column, name: Column, etag: Column, pp: Column, pn: Column, pe: Column) -> Column:
    """What happened to an item, given the previous path, name and etag (null if missing or empty); null if nothing did.

    path and name are the item's own, however empty; an empty etag is to be given as null.
    """
    return (
        F.when(deleted, "deleted")
        .when(pp.isNull() & pn.isNull() & pe.isNull(), "created")
        .when(pe.isNull() | etag.isNull() | (pe != etag), "updated")
        .when(differs(pp, path) & differs(pn, name), "moved_and_renamed")
        .when(differs(pp, path), "moved")
        .when(differs(pn, name), "renamed")
    )


def differs(previous: Column, current: Column) -> Column:
    """A value that was there has changed; an empty or missing new value is a change, a missing previous one isn't."""
    return previous.isNotNull() & ~previous.eqNullSafe(current)


def with_previous(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Items with the path and name of the last undeleted occurrence before them, null if empty, and the last etag that one had. by: more columns that an item's state belongs to."""
    w = Window.partitionBy("drive_id", "item_id", *(by or [])).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(~F.col("deleted"), F.struct("path", "name")), ignorenulls=True).over(w)
    etag = F.last(F.when(~F.col("deleted"), present(F.col("etag"))), ignorenulls=True).over(w)
    x = items.select("*", last.alias("_last"), etag.alias("p_etag"))
    return x.select("*", present(F.col("_last.path")).alias("p_path"), present(F.col("_last.name")).alias("p_name")).drop("_last")


def changes(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Changed files with their change_type; folders and unchanged files give no row. by: columns such as an epoch, in each of which files start anew."""
    x = with_previous(items.where(effective_kind(items) == "file") if "kind_before" in items.columns else items.where(F.col("kind") == "file"), by)
    kind = change_type(F.col("deleted"), F.col("path"), F.col("name"), present(F.col("etag")), F.col("p_path"), F.col("p_name"), F.col("p_etag"))
    return x.withColumn("change_type", kind).where(F.col("change_type").isNotNull())


def effective_kind(items: DataFrame) -> Column:
    """Kind of an item; a deleted one that is called a file has the kind that is remembered in kind_before, if any."""
    return F.when(F.col("deleted") & (F.col("kind") == "file"), F.coalesce("kind_before", F.lit("file"))).otherwise(F.col("kind"))


def with_kind_before(items: DataFrame) -> DataFrame:
    """Items with kind_before, the kind of the last undeleted occurrence before them."""
    w = Window.partitionBy("drive_id", "item_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn("kind_before", F.last(F.when(~F.col("deleted"), F.col("kind")), ignorenulls=True).over(w))


def file_state(items: DataFrame) -> DataFrame:
    """State after the feed: last path and name of each file that was ever there, and its last etag. Aggregated before the shuffle."""
    seen = items.where((F.col("kind") == "file") & ~F.col("deleted"))
    at = F.struct("ts", "seq")
    return seen.groupBy("drive_id", "item_id").agg(F.max_by("path", at).alias("path"), F.max_by("name", at).alias("name"), F.max_by("etag", F.when(present(F.col("etag")).isNotNull(), at)).alias("etag"))


def atomic_drives(rows: DataFrame, failed: Column) -> DataFrame:
    """Rows of drives in which no item failed: the others are dropped whole and their cursor stays."""
    bad = rows.where(failed).select("drive_id").distinct()
    return rows.join(bad, "drive_id", "left_anti")


def after_reset(state: DataFrame) -> DataFrame:
    """Tracking state after a reset of the feed: files lose path, name and etag, and keep their kind."""
    lost = lambda c: F.when(F.col("kind") == "file", F.lit(None)).otherwise(F.col(c)).alias(c)
    return state.select(*(lost(c) if c in ("path", "name", "etag") else F.col(c) for c in state.columns))


def stale_link(link: Column) -> Column:
    """A delta link that doesn't name its columns can't be used again."""
    return ~F.coalesce(link.contains("$select="), F.lit(False))


def sync_mode(force: Column, saved_links: Column) -> Column:
    return F.when(force, "full").when(saved_links > 0, "incremental").otherwise("initial")


def needs_full_read(link: Column, processed: Column, folder_total: Column, previous_entries: Column) -> Column:
    """A saved link that gave nothing for a folder which isn't empty, while the last snapshot was: the feed is stale."""
    return (F.coalesce(link, F.lit("")) != "") & (processed == 0) & (folder_total > 0) & (previous_entries == 0)


def merged_links(saved: Column, new: Column) -> Column:
    """Delta links by source: the new ones over the saved ones. Needs spark.sql.mapKeyDedupPolicy LAST_WIN, as configure() sets it."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_concat(F.coalesce(saved, empty), F.coalesce(new, empty))


def link_rows(cursors: DataFrame, by: str) -> DataFrame:
    """A row for each link of a map of delta links."""
    return cursors.select(by, F.explode("delta_links").alias("source_id", "delta_link"))


def fetch_failures(items: DataFrame, failed: Column) -> DataFrame:
    """Whether each drive failed (drive_id, failed): a file that a run fetches failed. Folders, deletions and unchanged files are never fetched, so a mark on them fails no drive."""
    bad = changes(items).where(failed & (F.col("change_type") != "deleted")).select("drive_id", F.lit(True).alias("failed")).distinct()
    return items.select("drive_id").distinct().join(bad, "drive_id", "left").select("drive_id", F.coalesce("failed", F.lit(False)).alias("failed"))


def backup_rows(items: DataFrame, stored: DataFrame, drives: DataFrame) -> DataFrame:
    """The changes of drives that didn't fail, with their outcome: deleted, stored or deduplicated.

    drives: drive_id, failed. The changes of a drive that failed are dropped whole. stored has the keys that are in the store; the first change that has another key stores it.
    """
    x = changes(items.join(drives.where("not failed").select("drive_id"), "drive_id", "left_semi"))
    first = x.where(F.col("change_type") != "deleted").groupBy("storage_key").agg(F.min(F.struct("ts", "seq")).alias("first"))
    first = first.join(stored.select("storage_key").distinct(), "storage_key", "left_anti")
    x = x.join(first, "storage_key", "left")
    new = F.coalesce(F.col("first") == F.struct("ts", "seq"), F.lit(False))
    return x.withColumn("outcome", F.when(F.col("change_type") == "deleted", "deleted").when(new, "stored").otherwise("deduplicated")).drop("first")


def backup_plan(items: DataFrame, stored: DataFrame, failed: Column) -> DataFrame:
    """Per drive: entries of the new snapshot, files stored and deduplicated, deletions, bytes, and whether a snapshot and the cursor are saved.

    The cursor of a drive in which a fetched file failed stays; a drive without changes saves its cursor, but no snapshot.
    Entries of deleted files count in entries and bytes, as they are entries of the snapshot with a size of their own.
    """
    drives = fetch_failures(items, failed)
    return _summed(drives, backup_rows(items, stored, drives))


def _summed(drives: DataFrame, rows: DataFrame) -> DataFrame:
    per = rows.groupBy("drive_id").agg(F.count(F.lit(1)).alias("entries"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("stored", "deduplicated", "deleted")), F.sum("size_bytes").cast("long").alias("size_bytes"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return drives.join(per, "drive_id", "left").select("drive_id", n("entries"), n("stored"), n("deduplicated"), n("deleted"), n("size_bytes"), (F.coalesce("entries", F.lit(0)) > 0).alias("snapshot"), (~F.col("failed")).alias("cursor_saved"))


def backup_with_versions(items: DataFrame, stored: DataFrame, failed: Column, versions: DataFrame, known: DataFrame) -> DataFrame:
    """backup_plan with versions_stored, versions_deduplicated, versions_unavailable and versions_failed of each drive, and healthy (nothing failed).

    Versions are looked at only for files of which a change stored its blob, not where all were deduplicated. versions and known are those of
    version_sync() with drive_id; what the run's changes have stored counts as in the store. Any failed item drops its drive here, fetched or not.
    """
    drives = items.groupBy("drive_id").agg(F.bool_or(failed).alias("failed"))
    rows = backup_rows(items, stored, drives)
    new = rows.where(F.col("outcome") == "stored")
    asked = versions.join(new.select("drive_id", F.col("item_id").alias("file_id")).distinct(), ["drive_id", "file_id"], "left_semi")
    there = stored.select("storage_key").unionAll(new.select("storage_key"))
    x = version_sync(asked, known, there)
    outcomes = ("stored", "deduplicated", "unavailable", "failed")
    per = x.groupBy("drive_id").agg(*(F.count_if(F.col("outcome") == o).alias(f"versions_{o}") for o in outcomes))
    out = _summed(drives, rows).join(per, "drive_id", "left")
    n = [F.coalesce(f"versions_{o}", F.lit(0)).cast("long").alias(f"versions_{o}") for o in outcomes]
    return out.select(*(c for c in out.columns if not c.startswith("versions_")), *n, (F.col("cursor_saved")).alias("healthy"))


def version_sync(versions: DataFrame, known: DataFrame, stored: DataFrame) -> DataFrame:
    """outcome of each source version that the index doesn't know: unavailable, failed, stored (the first of a key that isn't in the store) or deduplicated.

    versions: file_id, version_id, storage_key, status (null, unavailable or failed), seq. A version id may stand under many files.
    """
    new = versions.join(known.where(F.coalesce("version_id", F.lit("")) != "").select("file_id", "version_id").distinct(), ["file_id", "version_id"], "left_anti")
    first = new.where("status is null").groupBy("storage_key").agg(F.min("seq").alias("first")).join(stored.select("storage_key").distinct(), "storage_key", "left_anti")
    x = new.join(first, "storage_key", "left")
    return x.withColumn("outcome", F.coalesce("status", F.when(F.col("seq") == F.col("first"), "stored").otherwise("deduplicated"))).drop("first")


#: A source's raw item of a feed, as far as it is used.
RAW_ITEM = "id string, name string, size bigint, webUrl string, eTag string, lastModifiedDateTime string, parentReference struct<path:string>, file map<string,string>, folder map<string,string>, `@removed` struct<reason:string>"


def map_items(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """The other columns of raw and item_id, kind, name, path, size_bytes, deleted and the optional web_url, etag, modified_at of each raw item; items without an id go.

    Names and paths are in NFC; a path is what follows root:, a slash if that is nothing or there is none. An empty optional field counts as missing.
    """
    from tessera.functions import scalars, udfs

    r = F.from_json(json_col, RAW_ITEM)
    x = raw.withColumn("_r", r).where(F.coalesce(F.col("_r.id"), F.lit("")) != "")
    path = F.coalesce(F.nullif(F.col("_r.parentReference.path"), F.lit("")), F.lit("/"))
    deleted = F.col("_r.@removed").isNotNull()
    kept = [c for c in raw.columns if c != json_col]
    optional = lambda f, name: F.nullif(F.col(f"_r.{f}"), F.lit("")).alias(name)
    return x.select(
        *kept, F.col("_r.id").alias("item_id"), scalars.item_kind(F.col("_r.file").isNotNull(), F.col("_r.folder").isNotNull(), deleted).alias("kind"), udfs.nfc(F.coalesce("_r.name", F.lit(""))).alias("name"),
        udfs.nfc(scalars.parent_path(path)).alias("path"), F.coalesce("_r.size", F.lit(0)).cast("long").alias("size_bytes"), deleted.alias("deleted"), optional("webUrl", "web_url"), optional("eTag", "etag"), optional("lastModifiedDateTime", "modified_at"),
    )
