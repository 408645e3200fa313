"""Snapshots as encrypted JSON documents under keys: writing, reading, finding them by id or owner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import crypto, udfs
from tessera.schemas import ENTRY

#: Schema of a stored snapshot document.
DOCUMENT = f"owner_id bigint, snapshot_id bigint, created_at string, total_objects bigint, total_size_bytes bigint, delta_links map<string,string>, entries array<{ENTRY}>"


def document_key(owner: Column, snapshot: Column, prefix: str = "manifests/") -> Column:
    return F.concat(F.lit(prefix), owner.cast("string"), F.lit("/"), snapshot.cast("string"), F.lit(".json"))


def build(snapshots: DataFrame, previous_objects: Column | None = None) -> DataFrame:
    """Snapshots with their totals: bytes of entries and attachments, and objects, never fewer than before."""
    from tessera.operators.stats import entry_totals

    before = F.lit(0) if previous_objects is None else F.coalesce(previous_objects, F.lit(0))
    out = snapshots.withColumn("_t", entry_totals(F.col("entries")))
    out = out.withColumn("total_size_bytes", F.col("_t.size") + F.col("_t.att")).drop("_t")
    return out.withColumn("total_objects", F.greatest(F.size("entries").cast("long"), before).cast("long"))


def encode(built: DataFrame, key: Column, prefix: str = "manifests/") -> DataFrame:
    """Columns key and body of each snapshot: its JSON, fields that are null left out, compressed, and encrypted with a random IV."""
    links = F.col("delta_links") if "delta_links" in built.columns else F.create_map().cast("map<string,string>")
    document = F.struct("owner_id", "snapshot_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"), "total_objects", "total_size_bytes", links.alias("delta_links"), "entries")
    return built.select(document_key(F.col("owner_id"), F.col("snapshot_id"), prefix).alias("key"), crypto.encrypt(udfs.deflate(F.to_json(document).cast("binary")), key).alias("body"))


def save(built: DataFrame, key: Column, root: str, prefix: str = "manifests/", damaged: Column | None = None) -> None:
    """Write each snapshot's encrypted document under its key in a store. damaged (of column key): documents to which a byte is added, as a test needs them."""
    from tessera.sources import packs

    x = encode(built, key, prefix)
    if damaged is not None:
        x = x.withColumn("body", F.when(damaged, F.concat("body", F.lit(b"x"))).otherwise(F.col("body")))
    packs.put(x, root)


def decode(store: DataFrame, key: Column, prefix: str = "manifests/") -> DataFrame:
    """The snapshots under a prefix; what can't be decrypted or parsed is left out. Columns: key and those of the document."""
    text = udfs.inflate(crypto.decrypt(F.col("body"), key)).cast("string")
    x = store.where(F.col("key").startswith(prefix)).select("key", F.from_json(text, DOCUMENT).alias("d"))
    return x.where(F.col("d.snapshot_id").isNotNull()).select("key", "d.*")


def find_by_snapshot(keys: DataFrame, ids: DataFrame) -> DataFrame:
    """The least key that ends in /<id>.json for each id of ids (column snapshot_id, text); null if there is none."""
    named = keys.select("key", F.regexp_extract("key", r"/([^/]*)\.json$", 1).alias("snapshot_id"))
    return ids.join(named, "snapshot_id", "left").groupBy("snapshot_id").agg(F.min("key").alias("key"))


def find_exact(keys: DataFrame, asked: DataFrame, prefix: str) -> DataFrame:
    """Whether the key of each asked owner and snapshot is there."""
    there = keys.select("key", F.lit(True).alias("found")).distinct()
    return asked.withColumn("key", document_key(F.col("owner_id"), F.col("snapshot_id"), prefix)).join(there, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def of_owner(df: DataFrame, owner: str, column: str = "owner_id") -> DataFrame:
    """Rows of an owner. Ids are stored in lower case; only the one that is asked for is lowered, so a filter on it reaches the scan."""
    return df.where(F.col(column) == F.lower(F.lit(owner)))


def attachment_keys(snapshot: Column, line: Column, count: Column) -> Column:
    """Keys of an entry's attachments."""
    numbers = F.when(count > 0, F.sequence(F.lit(1).cast("long"), count)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(numbers, lambda i: F.concat_ws("/", F.lit("attachments"), snapshot.cast("string"), line.cast("string"), i.cast("string")))


def storage_keys(entries: DataFrame, keep_empty: bool = True) -> DataFrame:
    """A row for each reference to a key by an entry or an attachment, repeats kept (columns snapshot_id, kind, storage_key).

    entries has storage_key and att_keys. Mail keeps empty keys; drives drop them.
    """
    own = entries.select("snapshot_id", F.lit("entry").alias("kind"), "storage_key")
    out = own.unionAll(entries.select("snapshot_id", F.lit("attachment").alias("kind"), F.explode("att_keys").alias("storage_key")))
    return out if keep_empty else out.where(F.coalesce("storage_key", F.lit("")) != "")


def drive_keys(entries: DataFrame, owners: DataFrame) -> DataFrame:
    """Keys of a drive's objects with those of its version indexes and its cursor: owner_id, kind, storage_key."""
    blobs = entries.where(F.coalesce("storage_key", F.lit("")) != "").select("owner_id", F.lit("blob").alias("kind"), "storage_key")
    index = entries.select("owner_id", F.lit("index").alias("kind"), F.concat_ws("/", F.lit("onedrive/index"), F.col("owner_id").cast("string"), F.concat(F.col("file_id").cast("string"), F.lit(".json"))).alias("storage_key")).distinct()
    cursor = owners.select("owner_id", F.lit("cursor").alias("kind"), F.concat(F.lit("onedrive/_meta/"), F.col("owner_id").cast("string"), F.lit("/delta.json")).alias("storage_key"))
    return blobs.unionAll(index).unionAll(cursor)


def with_fallback(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """The key under which each row's object is: new_key if it is there, else legacy_key if that is, else null."""
    there = keys.select("key").distinct()
    x = asked.join(there.select(F.col("key").alias("new_key"), F.lit(True).alias("_new")), "new_key", "left").join(there.select(F.col("key").alias("legacy_key"), F.lit(True).alias("_legacy")), "legacy_key", "left")
    return x.withColumn("key", F.when(F.col("_new"), F.col("new_key")).when(F.col("_legacy"), F.col("legacy_key"))).drop("_new", "_legacy")
