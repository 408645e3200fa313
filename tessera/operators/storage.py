"""Content-addressed storage: deduplication plans, verification, replication, deletion and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def store_plan(blobs: DataFrame, stored: DataFrame) -> DataFrame:
    """outcome of each blob: stored for the first of a key that isn't in the store, else deduplicated.

    The first of each key is found by a grouped minimum, which is combined before the shuffle, so a key that
    many rows share is no long run in one task.
    """
    first = blobs.groupBy("storage_key").agg(F.min("seq").alias("first"))
    new = first.join(stored.select("storage_key").distinct(), "storage_key", "left_anti").select("storage_key", F.col("first").alias("seq"), F.lit(True).alias("new"))
    return blobs.join(new, ["storage_key", "seq"], "left").select("seq", "owner_id", "storage_key", "size_bytes", F.when(F.col("new"), "stored").otherwise("deduplicated").alias("outcome"))


def dedup_ratio(plan: DataFrame) -> DataFrame:
    stored = F.col("outcome") == "stored"
    return plan.groupBy("owner_id").agg(F.count_if(stored).alias("stored"), F.count_if(~stored).alias("deduplicated"), F.coalesce(F.sum(F.when(stored, F.col("size_bytes"))), F.lit(0)).cast("long").alias("stored_bytes"), F.sum("size_bytes").cast("long").alias("logical_bytes"))


def verify(entries: DataFrame, objects: DataFrame) -> DataFrame:
    """status of each entry against the stored object under its key: ok, mismatch or missing."""
    found = objects.groupBy("storage_key").agg(F.max("checksum").alias("stored_checksum"))
    status = F.when(F.col("stored_checksum").isNull(), "missing").when(F.col("stored_checksum") != F.col("checksum"), "mismatch").otherwise("ok")
    return entries.join(found, "storage_key", "left").withColumn("status", status)


def verification_summary(verified: DataFrame) -> DataFrame:
    bad = F.col("status") != "ok"
    return verified.groupBy("owner_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("failed"), F.count_if(~bad).alias("passed"), F.count_if(F.col("status") == "missing").alias("missing"))


def index_issues(entries: DataFrame, index: DataFrame) -> DataFrame:
    """Entries whose file has no row in the version index."""
    return entries.join(index.select("seq").distinct(), "seq", "left_anti")


def object_keys(entries: DataFrame) -> DataFrame:
    """Keys of the entries, once for each reference; empty keys are dropped."""
    return entries.where(F.coalesce("storage_key", F.lit("")) != "")


def replicate(keys: DataFrame, on_target: DataFrame, fails: Column) -> DataFrame:
    """outcome of each reference to a key: failed, skipped (there already, or copied for an earlier reference), copied."""
    there = on_target.select("storage_key", F.lit(True).alias("there")).distinct()
    first = keys.groupBy("storage_key").agg(F.min("reference").alias("first"))
    x = keys.join(first, "storage_key").join(there, "storage_key", "left")
    outcome = F.when(fails, "failed").when(F.col("there") | (F.col("reference") != F.col("first")), "skipped").otherwise("copied")
    return x.withColumn("outcome", outcome)


def replication_summary(outcomes: DataFrame, by: str) -> DataFrame:
    """Counts, copied bytes and the status they mean."""
    n = lambda what: F.count_if(F.col("outcome") == what)
    x = outcomes.groupBy(by).agg(n("copied").alias("copied"), n("skipped").alias("skipped"), n("failed").alias("failed"), F.coalesce(F.sum(F.when(F.col("outcome") == "copied", F.col("size_bytes"))), F.lit(0)).cast("long").alias("bytes_copied"))
    return x.withColumn("status", replication_status(F.col("copied"), F.col("failed")))


def replication_status(copied: Column, failed: Column) -> Column:
    return F.when(failed == 0, "COMPLETED").when(copied > 0, "PARTIAL").otherwise("FAILED")


def missing_snapshots(source: DataFrame, target: DataFrame) -> DataFrame:
    """Snapshots that the target lacks, to be copied oldest first."""
    return source.join(target.select("snapshot_id"), "snapshot_id", "left_anti")


def backlog(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """Snapshots that each target lacks, with their place in the order of copying, the oldest first."""
    x = wanted.join(there.select("snapshot_id", "target").distinct(), ["snapshot_id", "target"], "left_anti")
    return x.withColumn("place", F.row_number().over(Window.partitionBy("owner_id", "target").orderBy("created_at", "snapshot_id")).cast("long"))


def rehydration_summary(source: DataFrame, primary: DataFrame, objects: DataFrame) -> DataFrame:
    """Per owner: objects restored; a snapshot that is on the primary already adds one to skipped; a label of the number of snapshots."""
    there = primary.select("snapshot_id", F.lit(True).alias("there")).distinct()
    x = source.join(there, "snapshot_id", "left").join(objects.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("objects"), F.sum("size_bytes").alias("bytes")), "snapshot_id", "left")
    lacking = F.col("there").isNull()
    total = lambda c: F.coalesce(F.sum(F.when(lacking, F.col(c))), F.lit(0)).cast("long")
    out = x.groupBy("owner_id").agg(F.count(F.lit(1)).alias("snapshots"), total("objects").alias("copied"), F.count_if(~lacking).alias("skipped"), total("bytes").alias("bytes_copied"))
    return out.withColumn("label", F.concat(F.col("snapshots").cast("string"), F.lit("-snapshots")))


#: Parts of error texts that mean a lock kept the object.
RETAINED = ("object lock", "retention", "worm protected", "accessdenied", "operationaborted")


def deletion_outcome(error: Column) -> Column:
    """deleted without an error, retained if the error tells of a lock, failed otherwise."""
    low = F.lower(error)
    locked = F.lit(False)
    for part in RETAINED:
        locked |= low.contains(part)
    return F.when(error.isNull(), "deleted").when(locked, "retained").otherwise("failed")


def deletion_summary(results: DataFrame) -> DataFrame:
    """Counts by kind (manifest or object) and outcome, one row a kind."""
    kind = F.when(F.col("key").startswith("manifests/"), "manifest").otherwise("object")
    x = results.select(kind.alias("kind"), deletion_outcome(F.col("error")).alias("outcome"))
    return x.groupBy("kind").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("deleted", "retained", "failed")))


def pending_status(sources: DataFrame, cursors: DataFrame, pending: DataFrame, by: str) -> DataFrame:
    """Per group of sources: whether each has a cursor, and the pending changes of those that do; others were never backed up."""
    x = sources.join(cursors.select("source_id", "delta_link"), "source_id", "left").join(pending, "source_id", "left")
    known = F.coalesce("delta_link", F.lit("")) != ""
    out = x.groupBy(by).agg(F.count(F.lit(1)).alias("sources"), F.bool_and(known).alias("all_backed_up"), F.coalesce(F.sum(F.when(known, F.col("pending"))), F.lit(0)).cast("long").alias("pending"))
    return out.withColumn("status", F.when(~F.col("all_backed_up"), "never backed up").when(F.col("pending") == 0, "up-to-date").otherwise(F.concat(F.col("pending").cast("string"), F.lit(" change(s)"))))


def migrate_keys(keys: DataFrame, owners: DataFrame) -> DataFrame:
    """Keys whose owner segment is an e-mail address, under the owner's id: new_key, and action (migrated or unmapped).

    Of several ids for an address, the last one counts. owners is a dimension; Spark broadcasts it if it is small.
    """
    part = F.split("key", "/")
    legacy = keys.withColumn("email", F.lower(F.get(part, 1))).where(F.col("email").rlike(r"^[^@]+@[^@]+\.[^@]+$"))
    latest = owners.groupBy(F.lower("email").alias("email")).agg(F.max_by("object_id", "seq").alias("object_id"))
    moved = F.array_join(F.concat(F.slice(part, 1, 1), F.array(F.col("object_id").cast("string")), F.slice(part, F.lit(3), F.greatest(F.size(part) - 2, F.lit(0)))), "/")
    return legacy.join(latest, "email", "left").select("key", "email", F.when(F.col("object_id").isNotNull(), moved).alias("new_key"), F.when(F.col("object_id").isNotNull(), "migrated").otherwise("unmapped").alias("action"))
