"""Which keys a deletion covers, what it comes to, and records of replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.storage import deletion_outcome

#: Prefixes of each kind of data; an owner's data is under the prefix and the owner's id.
MAIL = ("manifests/", "data/", "attachments/")
DRIVE = ("onedrive/manifests/", "onedrive/data/", "onedrive/index/", "onedrive/_meta/")
SITE = ("sharepoint/manifests/", "sharepoint/data/", "sharepoint/index/", "sharepoint/_meta/")
META = ("_meta/",)


def in_scope(key: Column, prefixes: tuple[str, ...], owner: Column | None = None) -> Column:
    """Whether a key is under one of the prefixes, of an owner if one is given."""
    out = F.lit(False)
    for p in prefixes:
        out |= key.startswith(F.concat(F.lit(p), owner.cast("string"), F.lit("/")) if owner is not None else F.lit(p))
    return out


def deletion_targets(keys: DataFrame, versions: DataFrame, prefixes: tuple[str, ...], owner: Column | None = None) -> DataFrame:
    """Keys to delete with their order (manifests first), and version_id: all versions and markers where a key has some, else the key itself."""
    mine = keys.where(in_scope(F.col("key"), prefixes, owner)).select("key")
    x = mine.join(versions.select("key", "version_id"), "key", "left")
    return x.withColumn("rank", F.when(F.col("key").contains("manifests/"), 0).otherwise(1))


def snapshot_targets(keys: DataFrame, versions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Keys to delete for single snapshots, with version_id: their manifests alone, as other snapshots may need the same objects.

    snapshots: workload (mail, drive or site), owner_id and snapshot_id. A mail snapshot is found by its id under any owner; the others by their exact keys.
    """
    name = F.concat(F.col("snapshot_id").cast("string"), F.lit(".json"))
    prefix = F.when(F.col("workload") == "drive", DRIVE[0]).otherwise(SITE[0])
    exact = snapshots.where("workload <> 'mail'").select(F.concat(prefix, F.col("owner_id").cast("string"), F.lit("/"), name).alias("key"))
    mail = snapshots.where("workload = 'mail'").select(name.alias("_name"))
    found = keys.where(F.col("key").startswith(MAIL[0])).withColumn("_name", F.substring_index("key", "/", -1)).join(mail, "_name", "left_semi").select("key")
    mine = found.unionAll(keys.select("key").join(exact, "key", "left_semi")).distinct()
    return mine.join(versions.select("key", "version_id"), "key", "left")


def deletion_counts(results: DataFrame, by: str) -> DataFrame:
    """deleted, retained and failed by a column, from rows with error (null: deleted)."""
    return _tally(results.withColumn("outcome", deletion_outcome(F.col("error"))), by)


def all_versions(versions: DataFrame, markers: DataFrame) -> DataFrame:
    """Versions of objects and delete markers as one list: key, version_id, is_delete_marker."""
    flag = lambda df, x: df.select("key", "version_id", F.lit(x).alias("is_delete_marker"))
    return flag(versions, False).unionAll(flag(markers, True))


def _tally(x: DataFrame, *by: str) -> DataFrame:
    return x.groupBy(*by).agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("deleted", "retained", "failed")))


def purge(results: DataFrame) -> DataFrame:
    """Per tenant: counts of the core scope, and of the meta scope only where nothing of the core was retained or failed.

    results: tenant_id, key, error, where a null error is a deletion. Keys of drives and sites belong to neither scope.
    """
    key = F.col("key")
    scope = F.when(in_scope(key, MAIL), "core").when(in_scope(key, META), "meta")
    x = results.select("tenant_id", scope.alias("scope"), deletion_outcome(F.col("error")).alias("outcome")).where("scope is not null")
    core, meta = (_tally(x.where(F.col("scope") == s), "tenant_id") for s in ("core", "meta"))
    both = core.join(meta.select("tenant_id", *(F.col(c).alias(f"m_{c}") for c in ("deleted", "retained", "failed"))), "tenant_id", "left")
    whole = F.col("retained") + F.col("failed") == 0
    total = lambda c: (F.col(c) + F.when(whole, F.coalesce(f"m_{c}", F.lit(0))).otherwise(0)).cast("long").alias(c)
    return both.select("tenant_id", total("deleted"), total("retained"), total("failed"), whole.alias("meta_purged"))


def status_records(outcomes: DataFrame, endpoint: Column, at: Column) -> DataFrame:
    """A record of each owner, snapshot and target: counts, bytes, status, and the last error by order.

    outcomes: owner_id, snapshot_id, target_id, outcome, size_bytes, error, seq, elapsed_ms. at is when they were complete.
    """
    from tessera.operators.storage import replication_status

    n = lambda o: F.count_if(F.col("outcome") == o).alias(f"objects_{o}")
    x = outcomes.groupBy("owner_id", "snapshot_id", "target_id").agg(
        F.count(F.lit(1)).alias("objects_total"), n("copied"), n("skipped"), n("failed"), F.sum("size_bytes").cast("long").alias("bytes_total"),
        F.coalesce(F.sum(F.when(F.col("outcome") == "copied", F.col("size_bytes"))), F.lit(0)).cast("long").alias("bytes_copied"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("last_error"), F.sum("elapsed_ms").cast("long").alias("elapsed_ms"),
    )
    started = at - F.make_dt_interval(secs=F.col("elapsed_ms") / 1000)
    return x.withColumn("status", replication_status(F.col("objects_copied"), F.col("objects_failed"))).withColumn("target_endpoint", endpoint).withColumn("completed_at", at).withColumn("started_at", started).drop("elapsed_ms")


def upsert_status(saved: DataFrame, new: DataFrame) -> DataFrame:
    """Records by owner, snapshot and target; a new one takes the place of the saved one."""
    x = saved.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rows = F.struct(*(c for c in saved.columns))
    return x.groupBy("owner_id", "snapshot_id", "target_id").agg(F.max_by(rows, F.struct("_new", "completed_at")).alias("r")).select("r.*")


def status_of(records: DataFrame, snapshot: Column | None = None, owner: str | None = None) -> DataFrame:
    """All records, or those of a snapshot or an owner, newest first."""
    x = records if snapshot is None else records.where(F.col("snapshot_id") == snapshot)
    x = x if owner is None else x.where(F.col("owner_id").cast("string") == F.lower(F.lit(owner)))
    return x.orderBy(F.desc("completed_at"), "owner_id", "snapshot_id", "target_id")


def manifests_to_copy(outcomes: DataFrame, workload: Column) -> DataFrame:
    """Whether each snapshot's manifest is copied: for mail only if no object failed; for drives and sites in any case."""
    x = outcomes.groupBy("snapshot_id").agg(F.count_if(F.col("outcome") == "failed").alias("failed"), F.first(workload).alias("workload"))
    return x.withColumn("manifest_copied", (F.col("failed") == 0) | (F.col("workload") != "mail"))


def verify_replica(keys: DataFrame, checksums: DataFrame, objects: DataFrame) -> DataFrame:
    """status of each reference to a key on a replica: missing, mismatch or ok; keys without a checksum are only looked for.

    Of several checksums for a key the last by pos counts. Every reference counts, repeats as well.
    """
    last = checksums.where(F.coalesce("checksum", F.lit("")) != "").groupBy("storage_key").agg(F.max_by("checksum", "pos").alias("checksum"))
    there = objects.groupBy("storage_key").agg(F.max("checksum").alias("found"), F.lit(True).alias("there"))
    x = keys.join(last, "storage_key", "left").join(there, "storage_key", "left")
    return x.withColumn("status", F.when(F.col("there").isNull(), "missing").when(F.col("checksum") != F.col("found"), "mismatch").otherwise("ok"))


def verify_drive(entries: DataFrame, index: DataFrame, objects: DataFrame) -> DataFrame:
    """Per snapshot: entries whose file has no version of that snapshot in the index, and blobs that are missing or damaged.

    Deleted entries need a row of the index too, but have no blob. index: file_id, snapshot_id. objects: storage_key, checksum.
    """
    known = index.select("file_id", "snapshot_id").distinct().withColumn("known", F.lit(True))
    there = objects.groupBy("storage_key").agg(F.max("checksum").alias("found"))
    x = entries.join(known, ["file_id", "snapshot_id"], "left").join(there, "storage_key", "left")
    blob = has_blob()
    bad = blob & ~F.coalesce(F.col("found") == F.col("checksum"), F.lit(False))
    return x.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("known").isNull()).alias("index_issues"), F.count_if(blob).alias("blobs"), F.count_if(bad).alias("failed"))


def has_blob() -> Column:
    """An entry that isn't deleted and has a key and a checksum."""
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return (F.col("change_type") != "deleted") & filled("storage_key") & filled("checksum")
