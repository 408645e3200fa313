"""Storage statistics of snapshots, from nested arrays without exploding them where the grain allows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.ordering import locale_key

MEASURES = ("messages", "size_bytes", "attachments", "attachment_bytes")


def entry_totals(entries: Column) -> Column:
    """Sums over an array of entries, as a struct: size (their bytes), n (attachments) and att (their bytes). A missing attachment list counts as empty."""
    count = lambda e: F.coalesce(F.size(e["attachments"]), F.lit(0))
    size = lambda e: F.aggregate(F.coalesce(e["attachments"], F.array().cast("array<struct<size_bytes:bigint>>")), F.lit(0).cast("long"), lambda a, x: a + x["size_bytes"])
    zero = F.struct(F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("att"))
    return F.aggregate(entries, zero, lambda a, e: F.struct((a["size"] + e["size_bytes"]).alias("size"), (a["n"] + count(e)).alias("n"), (a["att"] + size(e)).alias("att")))


def with_totals(snapshots: DataFrame) -> DataFrame:
    """Per snapshot: entries, their bytes with attachments, attachments, their bytes."""
    out = snapshots.withColumn("_t", entry_totals(F.col("entries")))
    return out.select("owner_id", "snapshot_id", "created_at", F.size("entries").cast("long").alias("messages"), (F.col("_t.size") + F.col("_t.att")).alias("size_bytes"), F.col("_t.n").alias("attachments"), F.col("_t.att").alias("attachment_bytes"))


def totals(heads: DataFrame, entries: DataFrame) -> DataFrame:
    """The same from flat rows: entries are summed up by snapshot, combined before the shuffle, and then joined."""
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    per = entries.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.col("size_bytes") + F.col("att_bytes")).alias("size_bytes"), F.sum("att_count").alias("attachments"), F.sum("att_bytes").alias("attachment_bytes"))
    return heads.join(per, "snapshot_id", "left").select("owner_id", "snapshot_id", "created_at", *map(n, MEASURES))


def _totals(snapshots: DataFrame) -> DataFrame:
    """Totals of snapshots with nested entries; a table that has them is taken as it is."""
    return with_totals(snapshots) if "entries" in snapshots.columns else snapshots


def _sums() -> list[Column]:
    return [F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(m) for m in MEASURES]


def month_key(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def monthly(snapshots: DataFrame) -> DataFrame:
    """By month: snapshots (those without entries count) and sums."""
    return _totals(snapshots).groupBy(month_key(F.col("created_at")).alias("month")).agg(F.count(F.lit(1)).alias("snapshots"), *_sums())


def bucket(snapshots: DataFrame) -> DataFrame:
    """One row for everything."""
    return _totals(snapshots).agg(F.count_distinct("owner_id").alias("owners"), F.count(F.lit(1)).alias("snapshots"), *_sums())


def by_owner(snapshots: DataFrame) -> DataFrame:
    return _totals(snapshots).groupBy("owner_id").agg(F.count(F.lit(1)).alias("snapshots"), *_sums())


def by_folder(snapshots: DataFrame, unknown: str = "unknown") -> DataFrame:
    """By folder; entries without one are under `unknown` (an empty id is an id)."""
    e = snapshots.select(F.explode("entries").alias("e"))
    att = F.aggregate(F.coalesce("e.attachments", F.array().cast("array<struct<size_bytes:bigint>>")), F.lit(0).cast("long"), lambda a, x: a + x["size_bytes"])
    e = e.select(F.coalesce("e.folder_id", F.lit(unknown)).alias("folder_id"), F.lit(1).cast("long").alias("messages"), (F.col("e.size_bytes") + att).alias("size_bytes"), F.coalesce(F.size("e.attachments"), F.lit(0)).cast("long").alias("attachments"), att.alias("attachment_bytes"))
    return e.groupBy("folder_id").agg(*_sums())


def owner_detail(heads: DataFrame, entries: DataFrame, unknown: str = "unknown") -> DataFrame:
    """Per owner: snapshots, entries by folder in the locale's order of their names, snapshots by month; each as one text of few parts."""
    joined = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(x)), lambda t: F.concat_ws(":", t["name"], t["n"].cast("string"))), ",")
    folder = F.coalesce("folder_id", F.lit(unknown))
    by_folder = entries.groupBy("owner_id", folder.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    by_folder = by_folder.groupBy("owner_id").agg(joined(F.struct(locale_key(F.col("name")).alias("key"), "name", "n")).alias("folders"))
    by_month = heads.groupBy("owner_id", month_key(F.col("created_at")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    by_month = by_month.groupBy("owner_id").agg(F.sum("n").alias("snapshots"), joined(F.struct("name", "n")).alias("months"))
    return by_month.join(by_folder, "owner_id", "left")


def folders_of(entries: DataFrame, unknown: str = "unknown") -> DataFrame:
    """by_folder from flat entries."""
    e = entries.select(F.coalesce("folder_id", F.lit(unknown)).alias("folder_id"), F.lit(1).cast("long").alias("messages"), (F.col("size_bytes") + F.col("att_bytes")).alias("size_bytes"), F.col("att_count").alias("attachments"), F.col("att_bytes").alias("attachment_bytes"))
    return e.groupBy("folder_id").agg(*_sums())


def mailbox(heads: DataFrame, entries: DataFrame, unknown: str = "unknown") -> DataFrame:
    """Each owner's statistics at three grains in one table: grain (owner, folder or month), owner_id, name (of the folder or month), snapshots, and all measures.

    One aggregate over grouping sets: entries and snapshots are rows of one union, so they are shuffled once. A folder
    has no number of snapshots; snapshots without entries count for their owner and month. folder_id null is `unknown`.
    """
    none = F.lit(None).cast("string")
    zero = [F.lit(0).cast("long").alias(m) for m in ("entry", *MEASURES[1:])]
    snap = heads.select("owner_id", month_key(F.col("created_at")).alias("month"), none.alias("folder"), F.lit(1).cast("long").alias("snapshot"), *zero)
    size = (F.col("size_bytes") + F.col("att_bytes")).alias("size_bytes")
    ent = entries.select("owner_id", month_key(F.col("created_at")).alias("month"), F.coalesce("folder_id", F.lit(unknown)).alias("folder"), F.lit(0).cast("long").alias("snapshot"), F.lit(1).cast("long").alias("entry"), size, F.col("att_count").alias("attachments"), F.col("att_bytes").alias("attachment_bytes"))
    x = snap.unionAll(ent).groupingSets([["owner_id"], ["owner_id", "folder"], ["owner_id", "month"]], "owner_id", "folder", "month")
    x = x.agg(F.grouping("folder").alias("_f"), F.grouping("month").alias("_m"), F.sum("snapshot").alias("snapshots"), F.sum("entry").alias("messages"), *(F.sum(m).alias(m) for m in MEASURES[1:]))
    grain = F.when(F.col("_f") == 0, "folder").when(F.col("_m") == 0, "month").otherwise("owner")
    # Snapshots are in no folder: they make a group of their own there, which goes.
    x = x.where((F.col("_f") == 1) | F.col("folder").isNotNull())
    return x.select(grain.alias("grain"), "owner_id", F.coalesce("folder", "month").alias("name"), F.when(F.col("_f") == 1, F.col("snapshots")).alias("snapshots"), *MEASURES)
