"""Schemas of the logical tables: snapshots with nested entries and attachments, stored objects, feeds and registries."""

ATTACHMENT = "struct<size_bytes:bigint>"
ENTRY = f"struct<object_id:bigint,storage_key:string,folder_id:string,size_bytes:bigint,line:int,attachments:array<{ATTACHMENT}>>"
SNAPSHOTS = f"owner_id bigint, snapshot_id bigint, created_at timestamp_ntz, entries array<{ENTRY}>"
ENTRIES = "owner_id bigint, snapshot_id bigint, created_at timestamp_ntz, object_id bigint, storage_key string, folder_id string, size_bytes bigint, line int, att_count bigint, att_bytes bigint"
DELTA_ITEMS = "drive_id bigint, item_id bigint, ts timestamp_ntz, seq bigint, kind string, deleted boolean, path string, name string, etag string"
#: What a delta item's change can be called, in the order in which the cases are tried.
CHANGE_TYPES = ("deleted", "created", "updated", "moved_and_renamed", "moved", "renamed")
#: Folders that are left out of a backup.
EXCLUDED_FOLDERS = ("drafts", "outbox", "recoverableitemsdeletions", "junkemail")
