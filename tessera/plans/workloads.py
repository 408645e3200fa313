"""Queries of whole workloads: mail and file backups, archives, deletion of snapshots, messages and feeds as they come, with DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import crypto, scalars, udfs
from tessera.operators import catalog, cdc, limits, mailbox, manifests, merge, messages, profile, restore, scopes
from tessera.plans.composed import _FILES, _OUT, _RECORD, _files, _keys, _KEYS, _opened, _records
from tessera.plans.registry import _ITEMS, query
from tessera.schemas import EXCLUDED_FOLDERS
from tessera.session import shared_dir
from tessera.sources import adapters, packs

#: Folders of the mail feeds that queries make of events, by event type; drafts are excluded, and one has no name.
_FOLDERS = {"view": "Inbox", "click": "Archive", "signup": "Drafts", "purchase": "Sent", "error": None}
_FEED = """feed AS (SELECT user_id AS owner_id, event_type AS folder_id, CASE WHEN event_id % 41 <> 5 THEN event_id END AS message_id, event_id AS seq, md5(CAST(event_id % 300 AS VARCHAR)) AS checksum, event_id % 1000 AS size_bytes, event_id % 4 AS attachments, event_id % 17 = 3 AS removed, event_id % 499 = 7 AS failed, 'link-' || event_id AS delta_link FROM events WHERE event_type <> 'signup'),
fold AS (SELECT DISTINCT user_id AS owner_id, event_type AS folder_id FROM events WHERE event_type <> 'signup'),
pf AS (SELECT owner_id, folder_id, bool_or(failed) AS bad, arg_max(delta_link, seq) AS link FROM feed GROUP BY 1, 2),
live AS (SELECT feed.*, 'data/' || owner_id || '/' || checksum AS storage_key FROM feed JOIN pf USING (owner_id, folder_id) WHERE NOT bad AND message_id IS NOT NULL AND NOT removed),
told AS (SELECT *, row_number() OVER (PARTITION BY storage_key ORDER BY folder_id, seq) = 1 AND NOT ends_with(checksum, '7') AS new FROM live),
sums AS (SELECT owner_id, count(*) AS entries, count(*) FILTER (new) AS stored, sum(size_bytes) AS b, sum(CASE WHEN new THEN attachments END) AS att FROM told GROUP BY 1)"""


@query(f"""WITH {_FEED} SELECT f.owner_id, CASE WHEN f.owner_id % 3 = 0 THEN 'initial' WHEN f.owner_id % 7 = 1 THEN 'full' ELSE 'incremental' END AS mode, coalesce(stored, 0) AS stored, coalesce(entries - stored, 0) AS deduplicated, CAST(coalesce(att, 0) AS BIGINT) AS attachments_stored,
 bad_n AS folder_errors, good_n AS completed_folders, f.n AS total_folders, greatest(coalesce(entries, 0), CASE WHEN f.owner_id % 7 = 1 AND f.owner_id % 3 <> 0 THEN 0 ELSE f.owner_id % 90 END) AS total_objects, CAST(coalesce(b, 0) AS BIGINT) AS total_size_bytes,
 CAST(good_n + CASE WHEN f.owner_id % 3 = 0 OR f.owner_id % 7 = 1 THEN 0 ELSE 1 + CASE WHEN view_good THEN 0 ELSE 1 END END AS INTEGER) AS links, view_link AS inbox_link
FROM (SELECT owner_id, count(*) AS n FROM fold GROUP BY 1) f JOIN (SELECT owner_id, count(*) FILTER (bad) AS bad_n, count(*) FILTER (NOT bad) AS good_n, coalesce(bool_or(folder_id = 'view' AND NOT bad), false) AS view_good, CASE WHEN bool_or(folder_id = 'view' AND NOT bad) THEN max(CASE WHEN folder_id = 'view' THEN link END) WHEN owner_id % 3 <> 0 AND owner_id % 7 <> 1 THEN 'old' END AS view_link FROM pf GROUP BY 1) p USING (owner_id) LEFT JOIN sums USING (owner_id)""")
def backup_mailbox_plan(spark, sf):
    """A run of mail backups: folders filtered, feeds deduplicated, failed folders left out, totals and links merged with those of before."""
    e = adapters.table(spark, sf, "events")
    n = F.col("event_id")
    name = F.lit(None).cast("string")
    for kind, folder in _FOLDERS.items():
        name = F.when(F.col("event_type") == kind, F.lit(folder or "Notes")).otherwise(name)
    folders = e.select(F.col("user_id").alias("owner_id"), F.col("event_type").alias("folder_id"), name.alias("display_name")).distinct()
    feed = e.select(
        F.col("user_id").alias("owner_id"), F.col("event_type").alias("folder_id"), F.when(n % 41 != 5, n).alias("message_id"), n.alias("seq"), F.md5((n % 300).cast("string").cast("binary")).alias("checksum"), (n % 1000).alias("size_bytes"),
        (n % 4).alias("attachments"), (n % 17 == 3).alias("removed"), (n % 499 == 7).alias("failed"), F.concat(F.lit("link-"), n.cast("string")).alias("delta_link"),
    )
    owners = e.select(F.col("user_id").alias("owner_id")).distinct()
    saved = F.when(F.col("owner_id") % 3 != 0, F.create_map(F.lit("view"), F.lit("old"), F.lit("gone"), F.lit("old")))
    previous = owners.select("owner_id", (F.col("owner_id") % 90).alias("total_objects"), saved.alias("delta_links"))
    stored = feed.where(F.col("checksum").endswith("7")).select(F.concat_ws("/", F.lit("data"), F.col("owner_id").cast("string"), "checksum").alias("storage_key")).distinct()
    x = mailbox.backup(feed, folders, previous, stored, (F.col("owner_id") % 7 == 1) & (F.col("owner_id") % 3 != 0))
    return x.select("owner_id", "mode", "stored", "deduplicated", "attachments_stored", "folder_errors", "completed_folders", "total_folders", "total_objects", "total_size_bytes", F.size("delta_links").alias("links"), F.try_element_at("delta_links", F.lit("view")).alias("inbox_link"))


_LIBRARY = f"""{_ITEMS}, bad AS (SELECT drive_id, bool_or(seq % 997 = 5) AS failed FROM items GROUP BY 1), prev AS (SELECT *, last_value(CASE WHEN NOT deleted THEN path END IGNORE NULLS) OVER w AS pp, last_value(CASE WHEN NOT deleted THEN name END IGNORE NULLS) OVER w AS pn, last_value(CASE WHEN NOT deleted THEN etag END IGNORE NULLS) OVER w AS pe
 FROM items WHERE kind = 'file' WINDOW w AS (PARTITION BY drive_id, item_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT * FROM (SELECT *, 's' || seq % 400 AS storage_key, seq % 1000 AS size_bytes, CASE WHEN deleted THEN 'deleted' WHEN pp IS NULL AND pn IS NULL AND pe IS NULL THEN 'created' WHEN pe IS NULL OR etag IS NULL OR pe <> etag THEN 'updated' WHEN pp <> path OR pn <> name THEN 'moved' END AS t FROM prev) WHERE t IS NOT NULL AND drive_id NOT IN (SELECT drive_id FROM bad WHERE failed)),
s AS (SELECT *, t <> 'deleted' AND row_number() OVER (PARTITION BY t <> 'deleted', storage_key ORDER BY ts, seq) = 1 AND seq % 400 % 10 <> 7 AS new FROM c),
fresh AS (SELECT DISTINCT drive_id, item_id FROM s WHERE new),
v AS (SELECT i.drive_id, i.item_id, i.seq, 's' || (i.seq * 7 % 800) AS storage_key, CASE WHEN i.seq % 31 = 1 THEN 'unavailable' WHEN i.seq % 37 = 2 THEN 'failed' END AS status FROM items i JOIN fresh USING (drive_id, item_id) WHERE i.seq % 3 = 0 AND i.seq % 12 <> 0),
there AS (SELECT DISTINCT storage_key FROM (SELECT storage_key FROM s WHERE new UNION ALL SELECT 's' || k FROM range(400) t(k) WHERE k % 10 = 7)),
o AS (SELECT *, CASE WHEN status IS NOT NULL THEN status WHEN seq = min(CASE WHEN status IS NULL THEN seq END) OVER (PARTITION BY storage_key) AND storage_key NOT IN (SELECT storage_key FROM there) THEN 'stored' ELSE 'deduplicated' END AS outcome FROM v),
p AS (SELECT drive_id, count(*) AS entries, count(*) FILTER (new) AS stored, count(*) FILTER (t <> 'deleted' AND NOT new) AS deduplicated, count(*) FILTER (t = 'deleted') AS deleted, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM s GROUP BY 1),
q AS (SELECT drive_id, count(*) FILTER (outcome = 'stored') AS vs, count(*) FILTER (outcome = 'deduplicated') AS vd, count(*) FILTER (outcome = 'unavailable') AS vu, count(*) FILTER (outcome = 'failed') AS vf FROM o GROUP BY 1)"""


@query(f"""WITH {_LIBRARY} SELECT drive_id, coalesce(entries, 0) AS entries, coalesce(stored, 0) AS stored, coalesce(deduplicated, 0) AS deduplicated, coalesce(deleted, 0) AS deleted, coalesce(size_bytes, 0) AS size_bytes, coalesce(entries, 0) > 0 AS snapshot, NOT failed AS cursor_saved,
 coalesce(vs, 0) AS versions_stored, coalesce(vd, 0) AS versions_deduplicated, coalesce(vu, 0) AS versions_unavailable, coalesce(vf, 0) AS versions_failed, NOT failed AS healthy FROM bad LEFT JOIN p USING (drive_id) LEFT JOIN q USING (drive_id)""")
def backup_library_plan(spark, sf):
    """A run of library backups, with the historical versions of files whose blob was new."""
    key = lambda n: F.concat(F.lit("s"), n.cast("string"))
    n = F.col("seq")
    items = adapters.delta_items(spark, sf).withColumn("storage_key", key(n % 400)).withColumn("size_bytes", n % 1000)
    stored = items.where(n % 400 % 10 == 7).select("storage_key").distinct()
    stored = stored.unionAll(spark.range(400).where("id % 10 = 7").select(key(F.col("id")).alias("storage_key")))
    versions = items.where(n % 3 == 0).select("drive_id", F.col("item_id").alias("file_id"), n.cast("string").alias("version_id"), key(n * 7 % 800).alias("storage_key"), n.alias("seq"), F.when(n % 31 == 1, "unavailable").when(n % 37 == 2, "failed").alias("status"))
    known = versions.where(n % 12 == 0).select("file_id", "version_id")
    return cdc.backup_with_versions(items, stored, n % 997 == 5, versions, known)


@query(f"""WITH {_FILES}, k AS (SELECT DISTINCT storage_key FROM files WHERE length(storage_key) % 5 <> 0), r AS (SELECT f.*, k.storage_key IS NOT NULL AS there, seq % 50 = 7 AS bad FROM files f LEFT JOIN k ON k.storage_key = f.storage_key WHERE change_type <> 'deleted' AND f.storage_key <> '')
SELECT drive_id, count(*) FILTER (there AND NOT bad) AS files_saved, count(*) FILTER (NOT there OR bad) AS files_skipped, count(*) FILTER (there AND bad) AS integrity_failures, CAST(coalesce(sum(size_bytes) FILTER (there AND NOT bad), 0) AS BIGINT) AS total_bytes FROM r GROUP BY 1""")
def save_drive_archive(spark, sf):
    """Archives of drives: what is saved, what is missing, and what isn't what its checksum says."""
    return restore.file_save_summary(restore.file_save(*_archive(spark, sf)))


def _archive(spark, sf):
    sound = F.md5(F.col("storage_key").cast("binary"))
    e = _files(spark, sf).withColumn("checksum", F.when(F.col("seq") % 50 == 7, F.reverse(sound)).otherwise(sound))
    return e, e.where(F.length("storage_key") % 5 != 0).select("storage_key", sound.alias("found")).distinct()


@query(f"""WITH {_FILES}, k AS (SELECT DISTINCT storage_key FROM files WHERE length(storage_key) % 5 <> 0) SELECT drive_id, file_id, CASE WHEN parent_path = '/Docs' THEN 'Docs/' ELSE 'Docs/Mail/' END || file_name AS path, size_bytes, CASE WHEN k.storage_key IS NULL THEN 'missing' ELSE 'saved' END AS outcome
FROM files f LEFT JOIN k ON k.storage_key = f.storage_key WHERE change_type <> 'deleted' AND f.storage_key <> '' AND (parent_path = '/Docs/Mail' AND file_name = 'g' OR file_id = 11)""")
def save_library_archive(spark, sf):
    """Chosen files of libraries' archives with their paths, unchecked."""
    return restore.file_save(*_archive(spark, sf), ["/DOCS/Mail/G", "11"], skip_check=True)


@query(f"""WITH {_KEYS}, asked AS (SELECT 'manifests/' || o_custkey || '/' || o_orderkey || '.json' AS key, o_orderkey % 100 AS run FROM orders WHERE o_orderkey % 12 = 0), t AS (SELECT key, n FROM k JOIN asked USING (key)), v AS (SELECT t.*, unnest(CASE WHEN n % 4 = 0 THEN ['v1', 'v2'] ELSE [NULL] END) AS version_id FROM t)
SELECT n % 5 AS run, count(*) FILTER (n % 9 NOT IN (1, 2)) AS deleted, count(*) FILTER (n % 9 = 1) AS retained, count(*) FILTER (n % 9 = 2) AS failed FROM v GROUP BY 1""")
def delete_snapshots(spark, sf):
    """Deleting single mail snapshots: their manifests, found under any owner, with all versions; their objects stay."""
    keys = _keys(spark, sf)
    asked = adapters.heads(spark, sf).where("snapshot_id % 12 = 0").select(F.lit("mail").alias("workload"), F.lit(None).cast("bigint").alias("owner_id"), "snapshot_id")
    versions = keys.where("n % 4 = 0")
    versions = scopes.all_versions(versions.withColumn("version_id", F.lit("v1")), versions.withColumn("version_id", F.lit("v2")))
    n = F.regexp_extract("key", r"/(\d+)\.json$", 1).cast("long")
    x = scopes.snapshot_targets(keys, versions, asked).withColumn("error", F.when(n % 9 == 1, "Object Lock is on").when(n % 9 == 2, "timeout"))
    return scopes.deletion_counts(x.withColumn("run", n % 5), "run")


@query("""WITH k AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'onedrive/manifests/' WHEN 1 THEN 'sharepoint/manifests/' ELSE 'onedrive/data/' END || o_custkey || '/' || o_orderkey || '.json' AS key, o_orderkey AS n FROM orders) SELECT key, CASE WHEN n % 8 = 0 THEN 'only' END AS version_id FROM k WHERE n % 3 <> 2 AND n % 5 = 1""")
def delete_file_snapshots(spark, sf):
    """Deleting single snapshots of drives and sites: the exact keys of their manifests."""
    n, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    kind = F.when(n % 3 == 0, "drive").when(n % 3 == 1, "site")
    orders = adapters.table(spark, sf, "orders")
    prefix = F.when(kind == "drive", "onedrive/manifests/").when(kind == "site", "sharepoint/manifests/").otherwise("onedrive/data/")
    keys = orders.select(F.concat(prefix, c, F.lit("/"), n.cast("string"), F.lit(".json")).alias("key"), n.alias("n"))
    asked = orders.where(n % 5 == 1).select(F.coalesce(kind, F.lit("drive")).alias("workload"), F.col("o_custkey").alias("owner_id"), n.alias("snapshot_id"))
    return scopes.snapshot_targets(keys, keys.where("n % 8 = 0").select("key", F.lit("only").alias("version_id")), asked)


_MESSAGE = "subject string, body string, `from` string, isRead boolean"


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS ordinal FROM conversations) SELECT conv_id AS snapshot_id, turn AS object_id, 'turn ' || turn AS subject, text AS body, role AS sender, turn % 2 = 0 AS is_read FROM e WHERE ordinal = 2 AND (conv_id * 31 + turn) % 11 <> 4""")
def read_message(spark, sf):
    """The second message of each snapshot, looked up by its ordinal, fetched from the store, decrypted and parsed; what can't be opened gives nothing."""
    keys = crypto.key_table(spark, {"tenant": crypto.key_of("correct horse", "tenant", n=2**14)})
    root = f"{shared_dir(spark)}/messages-{uuid.uuid4().hex}"
    documents = messages.message_json(adapters.table(spark, sf, "conversations"))
    name = F.concat_ws("/", F.lit("data"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    sealed = documents.withColumn("tenant", F.lit("tenant")).join(keys, "tenant").select(name.alias("key"), "conv_id", "turn", crypto.encrypt(udfs.deflate(F.col("json").cast("binary")), F.col("data_key")).alias("body"))
    damaged = (F.col("conv_id") * 31 + F.col("turn")) % 11 == 4
    packs.put(sealed.select("key", F.when(damaged, F.concat("body", F.lit(b"x"))).otherwise(F.col("body")).alias("body")), root)
    c = adapters.table(spark, sf, "conversations")
    entry = F.struct(F.col("turn"), F.col("role"), F.col("text"), F.col("turn").alias("object_id"), name.alias("storage_key"))
    snapshots = c.groupBy(F.col("conv_id").alias("snapshot_id")).agg(F.array_sort(F.collect_list(entry)).alias("entries")).withColumn("owner_id", F.col("snapshot_id"))
    found = catalog.resolve_entry(snapshots, F.lit("2")).where("entry is not null").select("snapshot_id", "entry.object_id", "entry.storage_key", F.lit("tenant").alias("tenant"))
    x = mailbox.read_messages(found, root, F.col("data_key"), keys, _MESSAGE)
    return x.select("snapshot_id", "object_id", "message.subject", "message.body", F.col("message.from").alias("sender"), F.col("message.isRead").alias("is_read"))


@query(f"WITH {_OUT} SELECT {_RECORD} FROM r WHERE snapshot_id % 13 <> 5 AND starts_with(CAST(owner_id AS VARCHAR), '1')")
def replication_status_stored(spark, sf):
    """Replication records kept as encrypted documents, of the owners whose ids start with 1: listed by prefix, those that can't be opened passed over."""
    keys = crypto.key_table(spark, {"tenant": crypto.key_of("correct horse", "tenant", n=2**14)})
    root = f"{shared_dir(spark)}/status-{uuid.uuid4().hex}"
    records = _records(spark, sf, 1).drop("completed_at", "started_at")
    name = F.concat_ws("/", F.lit("_replication"), F.col("owner_id").cast("string"), F.col("snapshot_id").cast("string"), F.concat("target_id", F.lit(".json")))
    sealed = records.withColumn("tenant", F.lit("tenant")).join(keys, "tenant")
    body = crypto.encrypt(udfs.deflate(F.to_json(F.struct(*records.columns)).cast("binary")), F.col("data_key"))
    packs.put(sealed.select(name.alias("key"), F.when(F.col("snapshot_id") % 13 == 5, F.lit(b"damaged")).otherwise(body).alias("body")), root)
    there = _opened(packs.objects(spark, root, "_replication/1"), keys)
    parsed = F.from_json(udfs.inflate(crypto.decrypt(F.col("body"), F.col("data_key"))).cast("string"), records.schema)
    return there.select(parsed.alias("r")).where("r.snapshot_id is not null").select("r.*")


@query("""WITH d AS (SELECT c_custkey AS owner_id, unnest(['onedrive/manifests/', 'sharepoint/manifests/']) AS prefix FROM customer) SELECT prefix || owner_id || '/' || (owner_id * 10) || '.json' AS key, owner_id, owner_id * 10 AS snapshot_id, CAST(0 AS BIGINT) AS total_objects FROM d WHERE prefix = 'sharepoint/manifests/'""")
def file_manifest_store(spark, sf):
    """Documents of drives and libraries saved under their own prefixes; a read of one prefix doesn't see the other."""
    keys = crypto.key_table(spark, {"tenant": crypto.key_of("correct horse", "tenant", n=2**14)})
    root = f"{shared_dir(spark)}/file-manifests-{uuid.uuid4().hex}"
    c = F.col("c_custkey")
    none = adapters.snapshots(spark, sf).schema["entries"].dataType
    heads = adapters.table(spark, sf, "customer").select(c.alias("owner_id"), (c * 10).alias("snapshot_id"), F.lit("2026-01-01").cast("timestamp_ntz").alias("created_at"), F.array().cast(none).alias("entries"))
    built = manifests.build(heads).withColumn("tenant", F.lit("tenant")).join(keys, "tenant")
    for prefix in ("onedrive/manifests/", "sharepoint/manifests/"):
        manifests.save(built, F.col("data_key"), root, prefix)
    x = manifests.decode(_opened(packs.objects(spark, root, "sharepoint/"), keys), F.col("data_key"), "sharepoint/manifests/")
    return x.select("key", "owner_id", "snapshot_id", "total_objects")


@query("""WITH e AS (SELECT *, event_id AS n FROM events WHERE event_id % 13 <> 4) SELECT n AS seq, 'item-' || user_id AS item_id, CASE WHEN n % 5 < 2 THEN 'file' WHEN n % 5 = 2 THEN 'folder' WHEN n % 7 = 3 THEN 'file' ELSE 'folder' END AS kind, CASE WHEN n % 3 = 0 THEN 'é' ELSE 'name' END || n AS name,
CASE n % 4 WHEN 0 THEN '/' WHEN 1 THEN '/' WHEN 2 THEN '/Docs/é' ELSE '/drives/x' END AS path, CASE WHEN n % 6 <> 0 THEN n ELSE 0 END AS size_bytes, n % 7 = 3 AS deleted, CASE WHEN n % 8 > 1 THEN 'https://x/' || n END AS web_url, CASE WHEN n % 9 > 1 THEN 'e' || n END AS etag, CAST(NULL AS VARCHAR) AS modified_at FROM e""")
def delta_item_mapping(spark, sf):
    """Raw items of a feed as items: names and paths in NFC, kinds by facets, empty optional fields as missing, items without an id left out."""
    n = F.col("event_id")
    text = n.cast("string")
    path = F.when(n % 4 == 0, F.lit(None)).when(n % 4 == 1, "/drives/x/root:").when(n % 4 == 2, "/drives/x/root:/Docs/é").otherwise("/drives/x")
    facet = F.create_map(F.lit("a"), F.lit("b"))
    raw = F.struct(
        F.when(n % 13 != 4, F.concat(F.lit("item-"), F.col("user_id").cast("string"))).alias("id"), F.concat(F.when(n % 3 == 0, "é").otherwise("name"), text).alias("name"), F.when(n % 6 != 0, n).alias("size"), F.when(n % 8 > 1, F.concat(F.lit("https://x/"), text)).when(n % 8 == 1, "").alias("webUrl"), F.when(n % 9 > 1, F.concat(F.lit("e"), text)).alias("eTag"),
        F.struct(path.alias("path")).alias("parentReference"), F.when(n % 5 < 2, facet).alias("file"), F.when(n % 5 == 2, facet).alias("folder"), F.when(n % 7 == 3, F.struct(F.lit("deleted").alias("reason"))).alias("@removed"),
    )
    return cdc.map_items(adapters.table(spark, sf, "events").select(n.alias("seq"), F.to_json(raw).alias("json")))


@query("""WITH r AS (SELECT CASE event_id % 6 WHEN 0 THEN 'list_users' WHEN 1 THEN 'mailbox_exists' WHEN 2 THEN 'delta_sync' WHEN 3 THEN 'create_message' WHEN 4 THEN 'add_attachment' ELSE 'upload_chunk' END AS request_type, event_id % 4 = 0 AS has_link, event_id % 1000 AS size_bytes FROM events)
SELECT CASE WHEN request_type IN ('list_users', 'mailbox_exists') THEN 'identity' ELSE 'outlook' END AS pool, request_type, count(*) AS requests, CAST(count(*) * CASE WHEN request_type = 'list_users' THEN 2 ELSE 1 END AS BIGINT) AS cost, CAST(CASE WHEN request_type = 'delta_sync' THEN sum(CASE WHEN has_link THEN 1 ELSE 2 END) ELSE 0 END AS BIGINT) AS tokens, CAST(CASE WHEN request_type IN ('add_attachment', 'upload_chunk') THEN sum(size_bytes) ELSE 0 END AS BIGINT) AS upload_bytes FROM r GROUP BY 1, 2""")
def request_costs(spark, sf):
    """Requests by pool and type with their resource units, limiter tokens and uploaded bytes, by the table of costs."""
    n = F.col("event_id")
    kinds = ["list_users", "mailbox_exists", "delta_sync", "create_message", "add_attachment", "upload_chunk"]
    operation = F.element_at(F.array(*map(F.lit, kinds)), (n % 6 + 1).cast("int"))
    return limits.request_costs(adapters.table(spark, sf, "events").select(operation.alias("operation"), (n % 4 == 0).alias("has_link"), (n % 1000).alias("size_bytes")))


@query("""WITH m AS (SELECT conv_id, turn, role, text, turn % 4 AS k FROM conversations WHERE text IS NOT NULL) SELECT conv_id, turn, 'turn ' || turn AS subject, CASE WHEN k > 0 THEN 'folder-' || role ELSE '' END AS folder_id, octet_length(encode(text)) + 0 AS body_bytes,
CASE WHEN k = 0 THEN '(no body)' WHEN trim(text, ' ') = '' THEN '(empty body)' ELSE text END AS preview, role || ' <' || role || '@x.org>, b@x.org' AS recipients, 'HIDDEN' AS hidden, CASE WHEN k = 1 THEN '(no subject)' WHEN length(text) > 60 THEN left(text, 59) || '~' ELSE text END AS shown FROM m WHERE NOT (k <> 1 AND text = '')""")
def message_mapping(spark, sf):
    """Messages as a source gives them: stored fields, previews, recipients, and subjects as listings show them."""
    c = adapters.table(spark, sf, "conversations").where("text is not null")
    k = F.col("turn") % 4
    stored = messages.stored_message(messages.message_json(c)).join(c, ["conv_id", "turn"])
    to = F.array(F.struct(F.col("role").alias("name"), F.concat("role", F.lit("@x.org")).alias("address")), F.struct(F.lit("b@x.org").alias("name"), F.lit("b@x.org").alias("address")))
    shown = F.when(k == 1, "").otherwise(F.col("text"))
    x = stored.where((k == 1) | (F.col("text") != ""))
    preview = messages.preview(F.lit("text"), F.when(k != 0, F.col("text")), F.lit(None).cast("string"))
    return x.select("conv_id", "turn", "subject", "folder_id", F.octet_length("text").alias("body_bytes"), preview.alias("preview"), messages.recipients(to).alias("recipients"), scalars.mask_subject(F.col("text")).alias("hidden"), scalars.mask_subject(shown, True).alias("shown"))


@query("""WITH a AS (SELECT doc_id, text, doc_id % 3 AS k FROM documents) SELECT doc_id, CASE WHEN k = 0 THEN to_base64(unhex(md5(coalesce(text, '')))) END AS content_md5, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size_bytes, k = 0 AS inline FROM a WHERE k <> 2""")
def attachment_mapping(spark, sf):
    """Attachments that are files, with the MD5 that a store asks for; those without bytes keep what the source says of them."""
    d = F.col("doc_id") % 3
    body = F.coalesce("text", F.lit(""))
    raw = adapters.table(spark, sf, "documents").select("doc_id", F.when(d == 2, "#microsoft.graph.itemAttachment").otherwise("#microsoft.graph.fileAttachment").alias("type"), F.when(d == 0, F.base64(body.cast("binary"))).alias("contentBytes"), F.octet_length(body).cast("long").alias("size"), (d == 0).alias("inline"))
    x = messages.file_attachments(raw)
    return x.select("doc_id", F.when(F.col("inline"), scalars.content_md5(F.col("content"))).alias("content_md5"), "size_bytes", "inline")


@query("""WITH p AS (SELECT p_partkey AS n, p_name, p_partkey % 5 AS k FROM part) SELECT n, CASE k WHEN 0 THEN 'a_b.c' WHEN 1 THEN 'Unknown' WHEN 2 THEN replace(p_name, '/', '_') WHEN 3 THEN 'x.y' ELSE 'x_y_z' END AS segment, CASE k WHEN 0 THEN '/' WHEN 1 THEN '/x' WHEN 2 THEN '/a/b' ELSE 'plain' END AS parent FROM p""")
def path_rules(spark, sf):
    """Segments of archive paths, and the parents of a feed's items."""
    n = F.col("p_partkey")
    k = n % 5
    raw = F.when(k == 0, "a:b..c").when(k == 1, " .. ").when(k == 2, F.col("p_name")).when(k == 3, ". x.y .").otherwise("x|y?z")
    parent = F.when(k == 0, "/drive/root:").when(k == 1, "/drive/root:/x").when(k == 2, "root:/a/b").otherwise("plain")
    return adapters.table(spark, sf, "part").select(n.alias("n"), scalars.sanitize_segment(raw).alias("segment"), scalars.parent_path(parent).alias("parent"))


@query(f"""WITH f AS (SELECT DISTINCT user_id AS owner_id, CASE event_type WHEN 'view' THEN 'Inbox' WHEN 'click' THEN 'DRAFTS' WHEN 'signup' THEN 'JunkEmail' WHEN 'purchase' THEN 'Archive' END AS name, event_type AS id FROM events) SELECT owner_id, CASE WHEN id <> 'error' THEN id END AS folder_id, name AS display_name FROM f WHERE lower(coalesce(name, '')) NOT IN {EXCLUDED_FOLDERS} AND id <> 'error' AND owner_id = 3""")
def folder_scope(spark, sf):
    """The folders of one owner that a backup takes: none that is excluded, in any case of letters, and none without an id."""
    kind = F.col("event_type")
    name = F.when(kind == "view", "Inbox").when(kind == "click", "DRAFTS").when(kind == "signup", "JunkEmail").when(kind == "purchase", "Archive")
    x = adapters.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("owner_id"), F.when(kind != "error", kind).alias("folder_id"), name.alias("display_name")).distinct()
    x = merge.exclude_folders(manifests.of_owner(x, "3"), EXCLUDED_FOLDERS)
    return x.select(F.col("owner_id").cast("long").alias("owner_id"), "folder_id", "display_name")


@query("""WITH t AS (SELECT c_custkey AS owner_id, c_custkey % 50 AS done, 60 AS total, c_custkey % 7 AS secs FROM customer) SELECT owner_id, CASE WHEN secs > 0 THEN done / secs ELSE 0 END AS rate, CASE WHEN secs > 0 AND done > 0 THEN (total - done) / (done / secs) ELSE 0 END AS eta, greatest(done - owner_id % 40, 0) AS missing FROM t""")
def sync_progress(spark, sf):
    """Rates, remaining seconds, and how many items a restored folder lacks."""
    c = F.col("c_custkey")
    done, seconds = c % 50, (c % 7).cast("double")
    per_second = scalars.rate(done, seconds)
    return adapters.table(spark, sf, "customer").select(c.alias("owner_id"), per_second.alias("rate"), scalars.eta(F.lit(60), done, per_second).alias("eta"), merge.missing_after_restore(done, c % 40).alias("missing"))


@query(f"""WITH {_ITEMS}, k AS (SELECT * EXCLUDE (kind), CASE WHEN deleted OR seq % 6 <> 1 THEN 'file' ELSE 'folder' END AS kind FROM items), b AS (SELECT *, last_value(CASE WHEN NOT deleted THEN kind END IGNORE NULLS) OVER (PARTITION BY drive_id, item_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kind_before FROM k)
SELECT drive_id, count(*) AS items, count(*) FILTER (deleted) AS deleted, count(*) FILTER (deleted AND coalesce(kind_before, 'file') = 'folder') AS deleted_folders, count(*) FILTER (deleted AND kind_before IS NULL) AS unknown FROM b GROUP BY 1""")
def deleted_kinds(spark, sf):
    """Deleted items that a feed calls files and that were known as folders."""
    x = adapters.delta_items(spark, sf).withColumn("kind", F.when(F.col("deleted") | (F.col("seq") % 6 != 1), "file").otherwise("folder"))
    x = cdc.with_kind_before(x)
    kind = cdc.effective_kind(x)
    return x.groupBy("drive_id").agg(F.count(F.lit(1)).alias("items"), F.count_if("deleted").alias("deleted"), F.count_if(F.col("deleted") & (kind == "folder")).alias("deleted_folders"), F.count_if(F.col("deleted") & F.col("kind_before").isNull()).alias("unknown"))


@query("""WITH u AS (SELECT CASE event_id % 10 WHEN 0 THEN '' WHEN 1 THEN '(unknown)' WHEN 2 THEN 'node:internal/streams/' || event_id WHEN 3 THEN 'node:internal/x' WHEN 4 THEN 'node:https' WHEN 5 THEN 'node:zlib' WHEN 6 THEN '/app/node_modules/@aws-sdk/c.js' WHEN 7 THEN '/app/node_modules/x/' || event_id WHEN 8 THEN '/app/lib/storage/node_modules/a.js' ELSE '/app/' || event_id END AS url, event_id % 100 AS self_us FROM events)
SELECT CASE WHEN url IN ('', '(unknown)') THEN '(runtime)' WHEN contains(url, 'lib/storage/') THEN 'storage' WHEN contains(url, '/streams/') THEN 'node:streams' WHEN contains(url, 'node:internal') THEN 'node:internals' WHEN url = 'node:https' THEN 'node:network' WHEN url = 'node:zlib' THEN 'node:other' WHEN contains(url, 'aws') THEN 'aws-sdk' WHEN contains(url, 'node_modules') THEN 'dependencies' ELSE '(other)' END AS domain, count(*) AS functions, CAST(sum(self_us) AS BIGINT) AS self_us FROM u GROUP BY 1""")
def script_domains(spark, sf):
    """Time by domain of the scripts that functions are in: a project's rule first, then the fixed ones."""
    n = F.col("event_id")
    kinds = ["", "(unknown)", None, "node:internal/x", "node:https", "node:zlib", "/app/node_modules/@aws-sdk/c.js", "/app/node_modules/x/", "/app/lib/storage/node_modules/a.js", "/app/"]
    text = n.cast("string")
    url = F.when(n % 10 == 2, F.concat(F.lit("node:internal/streams/"), text)).otherwise(F.element_at(F.array(*map(F.lit, kinds)), (n % 10 + 1).cast("int")))
    url = F.when((n % 10).isin(7, 9), F.concat(url, text)).otherwise(url)
    x = adapters.table(spark, sf, "events").select(profile.script_domain(url, [("storage", "lib/storage/")]).alias("domain"), (n % 100).alias("self_us"))
    return x.groupBy("domain").agg(F.count(F.lit(1)).alias("functions"), F.sum("self_us").alias("self_us"))


@query("""WITH r AS (SELECT user_id % 5 AS tenant_id, event_id AS seq, epoch_us(ts) AS s, epoch_us(ts) + (event_id % 60 + 1) * 60000000 AS e FROM events), p AS (SELECT tenant_id, s AS moment, 1 AS kind, seq, 1 AS step FROM r UNION ALL SELECT tenant_id, e, 0, seq, -1 FROM r),
o AS (SELECT *, sum(step) OVER (PARTITION BY tenant_id ORDER BY moment, kind, seq ROWS UNBOUNDED PRECEDING) AS n FROM p) SELECT tenant_id, CAST(max(n) AS BIGINT) AS most, count(*) FILTER (n > 4) AS waiting FROM o WHERE kind = 1 GROUP BY 1""")
def request_concurrency(spark, sf):
    """How many requests of a tenant are under way at once, and how many begin beyond the four that a limiter lets through."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    x = adapters.table(spark, sf, "events").select((F.col("user_id") % 5).alias("tenant_id"), F.col("event_id").alias("seq"), at.alias("start_us"), (at + (F.col("event_id") % 60 + 1) * 60_000_000).alias("end_us"))
    return limits.concurrency(x)
