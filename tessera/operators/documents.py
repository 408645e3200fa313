"""Snapshot documents without a fixed schema, and documents that can't be parsed.

Entries of deleted files have no key and no checksum, and optional fields that are missing aren't written, so documents are written as JSON
without nulls and read back as variants, whose fields are asked for one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Optional fields of an entry.
OPTIONAL = ("web_url", "last_modified_at", "etag")
#: Documents of cursors and registries.
CURSOR = "owner_id string, delta_link_by_drive map<string,string>, updated_at string"
REGISTRY = "version int, identities array<struct<object_id:string,email:string,status:string>>"
_CORRUPT = "_corrupt"


def entry(changes: DataFrame) -> Column:
    """The document of a change: a deleted file's has no storage_key and checksum; a null field isn't written."""
    gone = F.col("change_type") == "deleted"
    fields = [F.col("item_id").cast("string").alias("file_id"), F.col("drive_id").cast("string").alias("drive_id"), F.col("name").alias("file_name"), F.col("path").alias("parent_path"), F.col("size_bytes")]
    fields += [F.when(~gone, F.col(c)).alias(c) for c in ("storage_key", "checksum")] + [F.col("change_type")]
    fields += [F.col(c) for c in OPTIONAL if c in changes.columns]
    return F.struct(*fields)


def entry_documents(changes: DataFrame, keep: list[str]) -> DataFrame:
    """keep and document (text) of each change."""
    return changes.select(*keep, F.to_json(entry(changes), {"ignoreNullFields": "true"}).alias("document"))


def snapshot_documents(changes: DataFrame, by: list[str]) -> DataFrame:
    """by and document (text): files, bytes and entries of each snapshot. Every entry counts, a deleted one with its size too."""
    grouped = changes.select(*by, "size_bytes", entry(changes).alias("e"), F.struct("ts", "seq").alias("at")).groupBy(*by)
    x = grouped.agg(F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes"), F.transform(F.array_sort(F.collect_list(F.struct("at", "e"))), lambda s: s["e"]).alias("entries"))
    return x.select(*by, F.to_json(F.struct("total_files", "total_size_bytes", "entries"), {"ignoreNullFields": "true"}).alias("document"))


def as_variant(documents: DataFrame, column: str = "document") -> DataFrame:
    """The text column as a variant; text that isn't JSON is null."""
    return documents.withColumn(column, F.try_parse_json(column))


def field(document: Column, path: str, kind: str = "string") -> Column:
    """A field of a variant; null if it isn't there or isn't of the kind."""
    return F.try_variant_get(document, path, kind)


def field_names(documents: DataFrame, keep: list[str], column: str = "document") -> DataFrame:
    """keep and field: a row for each field that a document has."""
    named = F.explode(F.map_keys(F.try_variant_get(F.col(column), "$", "map<string,variant>")))
    return documents.select(*keep, named.alias("field"))


def parsed(documents: DataFrame, schema: str, column: str = "document") -> DataFrame:
    """documents with the struct parsed, and corrupt: the text that couldn't be parsed, or null. A document that is corrupt counts as none: parsed is null."""
    whole = F.from_json(column, f"{schema}, {_CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    x = documents.withColumn("_d", whole)
    bad = F.col(column).isNotNull() & (F.col("_d").isNull() | F.col(f"_d.{_CORRUPT}").isNotNull())
    return x.withColumn("corrupt", F.when(bad, F.col(column))).withColumn("parsed", F.when(F.col(column).isNotNull() & ~bad, F.col("_d").dropFields(_CORRUPT))).drop("_d")


def saved_links(cursors: DataFrame, by: str) -> DataFrame:
    """by, links (a map: empty where there is no cursor or it is corrupt) and state (loaded, none or corrupt) of cursor documents."""
    x = parsed(cursors, CURSOR)
    state = F.when(F.col("corrupt").isNotNull(), "corrupt").when(F.col("parsed").isNull(), "none").otherwise("loaded")
    return x.select(by, F.coalesce("parsed.delta_link_by_drive", F.create_map().cast("map<string,string>")).alias("links"), state.alias("state"))


def registry_rows(registries: DataFrame, by: str) -> DataFrame:
    """by, object_id, email, status of the identities of registry documents; a corrupt or missing registry has none."""
    return parsed(registries, REGISTRY).select(by, F.explode("parsed.identities").alias("i")).select(by, "i.object_id", "i.email", "i.status")
