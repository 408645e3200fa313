"""Mail backup as one plan, and messages read back from the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import crypto, udfs
from tessera.operators import cdc, merge
from tessera.schemas import EXCLUDED_FOLDERS
from tessera.sources import packs


def backup(feed: DataFrame, folders: DataFrame, previous: DataFrame, stored: DataFrame, force: Column | None = None) -> DataFrame:
    """One row for each owner that has folders: what a run stores and what its snapshot document says.

    folders: owner_id, folder_id, display_name; excluded ones and those without an id are left out. feed: owner_id, folder_id, message_id,
    seq, checksum, size_bytes, attachments, removed, failed, delta_link: rows of the folders' delta feeds, which may lack an id. previous:
    owner_id, total_objects, delta_links of the latest snapshot. stored: storage_key.

    A folder in which something failed is left out whole and keeps its saved link. The first message of an owner with a
    checksum that isn't in the store stores it. total_objects never falls below the previous one; saved links stay under the new ones.
    """
    chosen = merge.exclude_folders(folders, EXCLUDED_FOLDERS).select("owner_id", "folder_id").distinct()
    rows = feed.join(chosen, ["owner_id", "folder_id"])
    per_folder = rows.groupBy("owner_id", "folder_id").agg(F.bool_or("failed").alias("bad"), F.max_by("delta_link", F.when(F.col("delta_link").isNotNull(), F.col("seq"))).alias("link"))
    good = per_folder.where("not bad")
    live = rows.where(F.col("message_id").isNotNull() & ~F.col("removed")).join(good.select("owner_id", "folder_id"), ["owner_id", "folder_id"], "left_semi")
    live = live.withColumn("storage_key", F.concat_ws("/", F.lit("data"), F.col("owner_id").cast("string"), "checksum"))
    first = live.groupBy("storage_key").agg(F.min(F.struct("folder_id", "seq")).alias("first")).join(stored.select("storage_key").distinct(), "storage_key", "left_anti")
    live = live.join(first, "storage_key", "left").withColumn("new", F.coalesce(F.col("first") == F.struct("folder_id", "seq"), F.lit(False)))
    sums = live.groupBy("owner_id").agg(F.count(F.lit(1)).alias("entries"), F.count_if("new").alias("stored"), F.sum("size_bytes").cast("long").alias("total_size_bytes"), F.sum(F.when(F.col("new"), F.col("attachments"))).cast("long").alias("attachments_stored"))
    links = good.where("link is not null").groupBy("owner_id").agg(F.map_from_entries(F.collect_list(F.struct("folder_id", "link"))).alias("new_links"))
    total = chosen.groupBy("owner_id").agg(F.count(F.lit(1)).alias("total_folders"))
    bad = per_folder.groupBy("owner_id").agg(F.count_if("bad").alias("folder_errors"))
    x = total.join(bad, "owner_id", "left").join(sums, "owner_id", "left").join(links, "owner_id", "left").join(previous.select("owner_id", F.col("total_objects").alias("before"), "delta_links"), "owner_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    force = F.lit(False) if force is None else force
    saved = F.when(~force, F.col("delta_links"))
    return x.select(
        "owner_id", cdc.sync_mode(force, size(saved)).alias("mode"), n("stored").alias("stored"), (n("entries") - n("stored")).alias("deduplicated"), n("attachments_stored").alias("attachments_stored"), n("folder_errors").alias("folder_errors"),
        size("new_links").cast("long").alias("completed_folders"), "total_folders", F.greatest(n("entries"), F.when(force, 0).otherwise(n("before"))).alias("total_objects"), n("total_size_bytes").alias("total_size_bytes"), cdc.merged_links(saved, F.col("new_links")).alias("delta_links"),
    )


def read_messages(entries: DataFrame, root: str, key: Column, keys: DataFrame, schema: str) -> DataFrame:
    """entries (tenant, storage_key and more) and message (a struct of the schema) of each whose object is there, can be opened and parsed. keys: tenant and the data keys, of which key is the column."""
    found = packs.get(entries, root, "storage_key").where("body is not null").join(keys, "tenant")
    text = udfs.inflate(crypto.decrypt(F.col("body"), key)).cast("string")
    out = found.withColumn("message", F.from_json(text, schema)).where("message is not null")
    return out.select(*entries.columns, "message")
