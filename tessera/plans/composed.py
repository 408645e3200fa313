"""Queries that compose operators into the plans of backup, restore, replication and deletion, with DuckDB SQL."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tessera.functions import crypto, scalars
from tessera.operators import catalog, cdc, manifests, messages, restore, scopes, stats, storage
from tessera.plans.registry import _CHG, _ENT, _ITEMS, _MERGED, _SNAP, _TOT, query
from tessera.session import shared_dir
from tessera.sources import adapters, packs

_T0 = dt.datetime(2026, 1, 1)


def _store(spark, sf):
    """The root of a store of encrypted snapshot documents under their keys, some of which are damaged, and its tenant's key as a table."""
    keys = crypto.key_table(spark, {"tenant": crypto.key_of("correct horse", "tenant", n=2**14)})
    built = manifests.build(adapters.snapshots(spark, sf)).withColumn("tenant", F.lit("tenant")).join(keys, "tenant")
    root = f"{shared_dir(spark)}/objects-{uuid.uuid4().hex}"
    damaged = F.regexp_extract("key", r"/(\d+)\.json$", 1).cast("long") % 13 == 0
    manifests.save(built, F.col("data_key"), root, damaged=damaged)
    return root, keys


def _opened(objects, keys):
    """Objects with the key that opens them."""
    return objects.withColumn("tenant", F.lit("tenant")).join(keys, "tenant")


@query(f"WITH {_TOT} SELECT 'manifests/' || owner_id || '/' || snapshot_id || '.json' AS key, owner_id, snapshot_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS created_at, messages AS total_objects, CAST(size_bytes AS BIGINT) AS total_size_bytes, CAST(messages AS BIGINT) AS entries FROM tot WHERE snapshot_id % 13 <> 0")
def manifest_roundtrip(spark, sf):
    """All documents of a store that was written: listed by prefix, read in partitions, decrypted; damaged ones are passed over."""
    root, keys = _store(spark, sf)
    x = manifests.decode(_opened(packs.objects(spark, root, "manifests/"), keys), F.col("data_key"))
    return x.select("key", "owner_id", "snapshot_id", "created_at", "total_objects", "total_size_bytes", F.size("entries").cast("long").alias("entries"))


@query(f"WITH {_ENT}, {_SNAP}, r AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY object_id, storage_key, folder_id NULLS FIRST, size_bytes, line) AS k FROM ent) SELECT snap.snapshot_id, object_id, storage_key FROM snap JOIN r ON r.snapshot_id = snap.snapshot_id AND k = 1 WHERE snap.snapshot_id % 50 = 7 AND snap.snapshot_id % 13 <> 0")
def manifest_read_entry(spark, sf):
    """The first entry of asked snapshots: their keys are found in a listing without bodies, and only their objects are opened."""
    root, keys = _store(spark, sf)
    ids = adapters.heads(spark, sf).where("snapshot_id % 50 = 7").select(F.col("snapshot_id").cast("string").alias("snapshot_id"))
    found = manifests.find_by_snapshot(packs.objects(spark, root, bodies=False).select("key"), ids).where("key is not null").select("key")
    x = catalog.resolve_entry(manifests.decode(_opened(packs.get(found, root), keys), F.col("data_key")), F.lit("1"))
    return x.where("entry is not null").select("snapshot_id", "entry.object_id", "entry.storage_key")


@query(f"WITH {_TOT} SELECT 'manifests/' || owner_id || '/' || snapshot_id || '.json' AS key, snapshot_id, messages AS total_objects FROM tot WHERE snapshot_id % 13 <> 0 AND starts_with(CAST(owner_id AS VARCHAR), '1')")
def manifest_prefix(spark, sf):
    """Documents of the owners whose ids start with 1: the source lists and opens only keys with that prefix."""
    root, keys = _store(spark, sf)
    return manifests.decode(_opened(packs.objects(spark, root, "manifests/1"), keys), F.col("data_key")).select("key", "snapshot_id", "total_objects")


@query(f"WITH {_SNAP} SELECT snapshot_id + 0 AS snapshot_id, 'manifests/' || owner_id || '/' || snapshot_id || '.json' AS key, snapshot_id % 10 <> 4 AS found FROM snap WHERE snapshot_id % 7 = 2")
def manifest_find_exact(spark, sf):
    heads = adapters.heads(spark, sf)
    keys = heads.where("snapshot_id % 10 <> 4").select(manifests.document_key(F.col("owner_id"), F.col("snapshot_id")).alias("key"))
    return manifests.find_exact(keys, heads.where("snapshot_id % 7 = 2"), "manifests/").select("snapshot_id", "key", "found")


@query(f"""WITH {_ENT}, {_SNAP}, f AS (SELECT owner_id, folder_id, count(*) AS n FROM (SELECT owner_id, coalesce(ent.folder_id, 'unknown') AS folder_id FROM ent JOIN snap USING (snapshot_id)) GROUP BY 1, 2),
m AS (SELECT owner_id, strftime(created_at, '%Y-%m') AS month, count(*) AS n FROM snap GROUP BY 1, 2)
SELECT owner_id, snapshots, folders, months FROM (SELECT owner_id, count(*) AS snapshots FROM snap GROUP BY 1) JOIN (SELECT owner_id, string_agg(month || ':' || n, ',' ORDER BY month) AS months FROM m GROUP BY 1) USING (owner_id)
LEFT JOIN (SELECT owner_id, string_agg(folder_id || ':' || n, ',' ORDER BY icu_sort_key(folder_id, 'und')) AS folders FROM f GROUP BY 1) USING (owner_id)""")
def stats_owner_detail(spark, sf):
    return stats.owner_detail(adapters.heads(spark, sf), adapters.flat_entries(spark, sf))


@query(f"WITH {_ENT}, {_SNAP}, {_MERGED.format("WHERE created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '1999-01-01'")}, g AS (SELECT owner_id, coalesce(folder_id, '__unknown__') AS folder_id, count(*) AS entries, CAST(sum(size_bytes + att_bytes) AS BIGINT) AS size_bytes FROM w GROUP BY 1, 2) SELECT *, CAST(coalesce(sum(entries) OVER (PARTITION BY owner_id ORDER BY folder_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS processed_before, CASE folder_id WHEN 'N' THEN 'Notes' WHEN 'R' THEN 'Reports' WHEN 'A' THEN 'Archive' ELSE 'Unknown' END AS display_name FROM g")
def restore_mailbox_plan(spark, sf):
    x = restore.mailbox_plan(adapters.flat_entries(spark, sf), adapters.folders(spark), dt.date(1996, 1, 1), dt.date(1998, 12, 31))
    return x.select("owner_id", "folder_id", "entries", "size_bytes", "processed_before", "display_name")


@query("SELECT lower(n_name) AS name, n_nationkey AS folder_id, NULL AS warning FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT r_name, NULL, 'folder not found: ' || r_name FROM region")
def folder_include_list(spark, sf):
    """Nations as folders: every other one is asked for in lower case, and so are the regions, which aren't folders."""
    nation, region = adapters.table(spark, sf, "nation"), adapters.table(spark, sf, "region")
    asked = nation.where("n_nationkey % 2 = 0").select(F.lower("n_name").alias("name")).unionAll(region.select("r_name"))
    return restore.chosen_folders(nation.select(F.col("n_nationkey").alias("folder_id"), F.col("n_name").alias("display_name")), asked)


_FILES = f"""{_CHG}, files AS (SELECT drive_id, item_id AS file_id, seq, change_type, CASE WHEN path = '/a' THEN '/Docs/Mail' ELSE '/Docs' END AS parent_path, name AS file_name, CASE WHEN seq % 17 = 3 THEN '' ELSE concat(path, '-', name, '-', coalesce(etag, 'none')) END AS storage_key, seq % 3 AS snapshot_id, seq % 1000 AS size_bytes FROM chg)"""


def _files(spark, sf):
    """Entries of drives: the changes, with the keys under which their contents are."""
    x = cdc.changes(adapters.delta_items(spark, sf))
    key = F.when(F.col("seq") % 17 == 3, "").otherwise(F.concat_ws("-", "path", "name", F.coalesce("etag", F.lit("none"))))
    return x.select("drive_id", F.col("item_id").alias("file_id"), "seq", "change_type", F.when(F.col("path") == "/a", "/Docs/Mail").otherwise("/Docs").alias("parent_path"), F.col("name").alias("file_name"), key.alias("storage_key"), (F.col("seq") % 3).alias("snapshot_id"), (F.col("seq") % 1000).alias("size_bytes"))


@query(f"WITH {_FILES}, r AS (SELECT * FROM files WHERE change_type <> 'deleted' AND storage_key <> '') SELECT drive_id, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, CASE WHEN bool_or(parent_path = '/Docs/Mail') THEN 2 ELSE 1 END::BIGINT AS folders_created FROM r GROUP BY 1")
def restore_drive_plan(spark, sf):
    return restore.drive_plan(_files(spark, sf))


@query(f"WITH {_FILES}, r AS (SELECT * FROM files WHERE change_type <> 'deleted' AND storage_key <> '' AND (parent_path = '/Docs/Mail' AND file_name = 'g' OR file_id = 11)) SELECT drive_id, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, CASE WHEN bool_or(parent_path = '/Docs/Mail') THEN 3 ELSE 2 END::BIGINT AS folders_created FROM r GROUP BY 1")
def restore_library_plan(spark, sf):
    return restore.drive_plan(_files(spark, sf), ["/DOCS/Mail/G", "11"], count_root=True)


@query(f"""WITH {_ITEMS}, prev AS (SELECT *, last_value(CASE WHEN NOT deleted THEN path END IGNORE NULLS) OVER w AS pp, last_value(CASE WHEN NOT deleted THEN name END IGNORE NULLS) OVER w AS pn, last_value(CASE WHEN NOT deleted THEN etag END IGNORE NULLS) OVER w AS pe
 FROM items WHERE kind = 'file' WINDOW w AS (PARTITION BY drive_id, item_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT * FROM (SELECT *, path || name || coalesce(etag, '') || item_id % 50 AS storage_key, seq % 1000 AS size_bytes, CASE WHEN deleted THEN 'deleted' WHEN pp IS NULL AND pn IS NULL AND pe IS NULL THEN 'created' WHEN pe IS NULL OR etag IS NULL OR pe <> etag THEN 'updated' WHEN pp <> path OR pn <> name THEN 'moved' END AS t FROM prev) WHERE t IS NOT NULL),
bad AS (SELECT drive_id, coalesce(f.failed, false) AS failed FROM (SELECT DISTINCT drive_id FROM items) LEFT JOIN (SELECT DISTINCT drive_id, true AS failed FROM a WHERE t <> 'deleted' AND seq % 997 = 5) f USING (drive_id)),
c AS (SELECT * FROM a WHERE drive_id NOT IN (SELECT drive_id FROM bad WHERE failed)),
s AS (SELECT *, t <> 'deleted' AND row_number() OVER (PARTITION BY t <> 'deleted', storage_key ORDER BY ts, seq) = 1 AND storage_key NOT LIKE '/a%7' AS new FROM c),
p AS (SELECT drive_id, count(*) AS entries, count(*) FILTER (new) AS stored, count(*) FILTER (t <> 'deleted' AND NOT new) AS deduplicated, count(*) FILTER (t = 'deleted') AS deleted, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM s GROUP BY 1)
SELECT drive_id, coalesce(entries, 0) AS entries, coalesce(stored, 0) AS stored, coalesce(deduplicated, 0) AS deduplicated, coalesce(deleted, 0) AS deleted, coalesce(size_bytes, 0) AS size_bytes, coalesce(entries, 0) > 0 AS snapshot, NOT failed AS cursor_saved FROM bad LEFT JOIN p USING (drive_id)""")
def backup_drive_plan(spark, sf):
    key = F.concat("path", "name", F.coalesce("etag", F.lit("")), (F.col("item_id") % 50).cast("string"))
    items = adapters.delta_items(spark, sf).withColumn("storage_key", key).withColumn("size_bytes", F.col("seq") % 1000)
    return cdc.backup_plan(items, items.where(F.col("storage_key").rlike("^/a.*7$")).select("storage_key"), F.col("seq") % 997 == 5)


@query("""WITH v AS (SELECT l_partkey AS file_id, l_orderkey || '.' || l_linenumber || '.' || l_suppkey AS version_id, 'k' || (l_orderkey % 400) AS storage_key, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_orderkey % 31 = 1 THEN 'unavailable' WHEN l_orderkey % 37 = 2 THEN 'failed' END AS status FROM lineitem),
n AS (SELECT *, min(CASE WHEN status IS NULL THEN seq END) OVER (PARTITION BY storage_key) AS first FROM v WHERE seq % 4 <> 1)
SELECT file_id, count(*) FILTER (status IS NULL AND seq = first AND storage_key NOT IN ('k3', 'k7')) AS stored, count(*) FILTER (status IS NULL AND (seq <> first OR storage_key IN ('k3', 'k7'))) AS deduplicated, count(*) FILTER (status = 'unavailable') AS unavailable, count(*) FILTER (status = 'failed') AS failed FROM n GROUP BY 1""")
def version_sync(spark, sf):
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    status = F.when(order % 31 == 1, "unavailable").when(order % 37 == 2, "failed")
    v = adapters.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("file_id"), F.concat_ws(".", order.cast("string"), line.cast("string"), F.col("l_suppkey").cast("string")).alias("version_id"), F.concat(F.lit("k"), (order % 400).cast("string")).alias("storage_key"), (order * 10 + line).alias("seq"), status.alias("status"))
    stored = spark.createDataFrame([("k3",), ("k7",)], "storage_key string")
    x = cdc.version_sync(v, v.where(F.col("seq") % 4 == 1), stored)
    return x.groupBy("file_id").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("stored", "deduplicated", "unavailable", "failed")))


@query(f"WITH {_ENT}, k AS (SELECT snapshot_id, 'entry' AS kind, storage_key FROM ent UNION ALL SELECT snapshot_id, 'attachment', 'attachments/' || snapshot_id || '/' || line || '/' || i FROM (SELECT *, unnest(generate_series(1, att)) AS i FROM ent WHERE att > 0)) SELECT snapshot_id, kind, count(*) AS n, count(DISTINCT storage_key) AS distinct_keys FROM k GROUP BY 1, 2")
def storage_key_references(spark, sf):
    e = adapters.entries(spark, sf).withColumn("att_keys", manifests.attachment_keys(F.col("snapshot_id"), F.col("line"), F.col("att_count")))
    return manifests.storage_keys(e).groupBy("snapshot_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("storage_key").alias("distinct_keys"))


@query(f"""WITH {_FILES}, k AS (SELECT drive_id AS owner_id, 'blob' AS kind, storage_key FROM files WHERE storage_key <> '' UNION ALL SELECT DISTINCT drive_id, 'index', 'onedrive/index/' || drive_id || '/' || file_id || '.json' FROM files UNION ALL SELECT DISTINCT drive_id, 'cursor', 'onedrive/_meta/' || drive_id || '/delta.json' FROM items)
SELECT owner_id, kind, count(*) AS n, max(storage_key) AS last_key FROM k GROUP BY 1, 2""")
def drive_key_scope(spark, sf):
    files = _files(spark, sf).withColumnRenamed("drive_id", "owner_id")
    owners = adapters.delta_items(spark, sf).select(F.col("drive_id").alias("owner_id")).distinct()
    return manifests.drive_keys(files, owners).groupBy("owner_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("storage_key").alias("last_key"))


_OUT = """o AS (SELECT c_custkey % 20 AS owner_id, o_orderkey AS snapshot_id, 'target-' || (o_orderkey % 2) AS target_id, l_linenumber AS seq, CAST(l_quantity AS BIGINT) AS size_bytes, CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN 'failed' WHEN l_suppkey % 3 = 0 THEN 'skipped' ELSE 'copied' END AS outcome
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
r AS (SELECT owner_id, snapshot_id, target_id, count(*) AS objects_total, count(*) FILTER (outcome = 'copied') AS objects_copied, count(*) FILTER (outcome = 'skipped') AS objects_skipped, count(*) FILTER (outcome = 'failed') AS objects_failed, CAST(sum(size_bytes) AS BIGINT) AS bytes_total, CAST(coalesce(sum(size_bytes) FILTER (outcome = 'copied'), 0) AS BIGINT) AS bytes_copied, max(CASE WHEN outcome = 'failed' THEN 'error ' || seq END) AS last_error FROM o GROUP BY 1, 2, 3)"""


def _outcomes(spark, sf):
    heads = adapters.table(spark, sf, "orders").join(adapters.table(spark, sf, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    x = adapters.table(spark, sf, "lineitem").join(heads, F.col("l_orderkey") == F.col("o_orderkey"))
    outcome = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 11 == 0, "failed").when(F.col("l_suppkey") % 3 == 0, "skipped").otherwise("copied")
    seq = F.col("l_linenumber")
    return x.select((F.col("c_custkey") % 20).alias("owner_id"), F.col("o_orderkey").alias("snapshot_id"), F.concat(F.lit("target-"), (F.col("o_orderkey") % 2).cast("string")).alias("target_id"), seq.alias("seq"), F.col("l_quantity").cast("long").alias("size_bytes"), outcome.alias("outcome"), F.when(outcome == "failed", F.concat(F.lit("error "), seq.cast("string"))).alias("error"), F.lit(100).cast("long").alias("elapsed_ms"))


def _records(spark, sf, day):
    return scopes.status_records(_outcomes(spark, sf), F.lit("https://store"), F.lit(_T0 + dt.timedelta(days=day)).cast("timestamp_ntz"))


_RECORD = "owner_id, snapshot_id, target_id, objects_total, objects_copied, objects_skipped, objects_failed, bytes_total, bytes_copied, last_error, CASE WHEN objects_failed = 0 THEN 'COMPLETED' WHEN objects_copied > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status, 'https://store' AS target_endpoint"


@query(f"WITH {_OUT} SELECT {_RECORD}, TIMESTAMP '2026-01-02' AS completed_at, TIMESTAMP '2026-01-02' - to_milliseconds(100 * objects_total) AS started_at FROM r")
def replication_status_records(spark, sf):
    return _records(spark, sf, 1)


@query(f"WITH {_OUT} SELECT owner_id, snapshot_id, target_id, objects_failed, CASE WHEN snapshot_id % 3 = 0 THEN TIMESTAMP '2026-01-03' ELSE TIMESTAMP '2026-01-02' END AS completed_at FROM r WHERE owner_id = 7")
def replication_status_by_owner(spark, sf):
    """Records of an owner after later runs over some of the snapshots took the place of the earlier ones."""
    both = scopes.upsert_status(_records(spark, sf, 1), _records(spark, sf, 2).where("snapshot_id % 3 = 0"))
    return scopes.status_of(both, owner="7").select("owner_id", "snapshot_id", "target_id", "objects_failed", "completed_at")


@query(f"WITH {_OUT} SELECT snapshot_id, sum(objects_failed)::BIGINT AS failed, CASE snapshot_id % 3 WHEN 0 THEN 'mail' WHEN 1 THEN 'drive' ELSE 'site' END AS workload, sum(objects_failed) = 0 OR snapshot_id % 3 <> 0 AS manifest_copied FROM r GROUP BY 1")
def replicate_manifests(spark, sf):
    kind = F.element_at(F.array(F.lit("mail"), F.lit("drive"), F.lit("site")), (F.col("snapshot_id") % 3 + 1).cast("int"))
    return scopes.manifests_to_copy(_outcomes(spark, sf), kind)


@query(f"WITH {_SNAP}, t AS (SELECT *, unnest(['eu', 'us']) AS target FROM snap) SELECT owner_id, snapshot_id, target, CAST(row_number() OVER (PARTITION BY owner_id, target ORDER BY created_at, snapshot_id) AS BIGINT) AS place FROM t WHERE NOT (snapshot_id % 10 <> 3 AND target = 'eu') AND NOT (snapshot_id % 5 = 2 AND target = 'us')")
def replication_backlog(spark, sf):
    heads = adapters.heads(spark, sf)
    wanted = heads.withColumn("target", F.explode(F.array(F.lit("eu"), F.lit("us"))))
    there = heads.where("snapshot_id % 10 <> 3").select("snapshot_id", F.lit("eu").alias("target")).unionAll(heads.where("snapshot_id % 5 = 2").select("snapshot_id", F.lit("us").alias("target")))
    return storage.backlog(wanted, there).select("owner_id", "snapshot_id", "target", "place")


@query(f"""WITH {_FILES}, e AS (SELECT * FROM files WHERE storage_key <> ''), k AS (SELECT storage_key, max(seq) AS pos FROM e WHERE seq % 7 <> 0 GROUP BY 1), s AS (SELECT DISTINCT storage_key, md5(storage_key || ' ' || length(storage_key)) AS c FROM e)
SELECT drive_id, count(*) AS checked, count(*) FILTER (length(storage_key) % 5 = 0) AS missing, count(*) FILTER (length(storage_key) % 5 <> 0 AND pos % 9 = 4) AS mismatched FROM e LEFT JOIN k USING (storage_key) GROUP BY 1""")
def verify_replica(spark, sf):
    """References of drives on a replica that lacks some keys; a key's last checksum is wrong where its place says so."""
    e = _files(spark, sf).where("storage_key <> ''")
    right = F.md5(F.concat_ws(" ", "storage_key", F.length("storage_key").cast("string")).cast("binary"))
    checks = e.select("storage_key", F.col("seq").alias("pos"), F.when(F.col("seq") % 7 == 0, "").when(F.col("seq") % 9 == 4, "wrong").otherwise(right).alias("checksum"))
    objects = e.where(F.length("storage_key") % 5 != 0).select("storage_key", right.alias("checksum")).distinct()
    x = scopes.verify_replica(e.select("drive_id", "storage_key"), checks, objects)
    return x.groupBy("drive_id").agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status") == "mismatch").alias("mismatched"))


@query(f"""WITH {_FILES}, i AS (SELECT DISTINCT file_id, snapshot_id FROM files WHERE seq % 5 <> 1), x AS (SELECT f.*, i.file_id IS NULL AS unknown, f.change_type <> 'deleted' AND f.storage_key <> '' AS blob FROM files f LEFT JOIN i ON i.file_id = f.file_id AND i.snapshot_id = f.snapshot_id)
SELECT snapshot_id, count(*) AS entries, count(*) FILTER (unknown) AS index_issues, count(*) FILTER (blob) AS blobs, count(*) FILTER (blob AND (length(storage_key) % 5 = 0 OR seq % 50 = 7)) AS failed FROM x GROUP BY 1""")
def verify_drive_snapshots(spark, sf):
    sound = F.md5(F.col("storage_key").cast("binary"))
    e = _files(spark, sf).withColumn("checksum", F.when(F.col("seq") % 50 == 7, F.reverse(sound)).otherwise(sound))
    objects = e.where(F.length("storage_key") % 5 != 0).select("storage_key", sound.alias("checksum"))
    return scopes.verify_drive(e, e.where(F.col("seq") % 5 != 1).select("file_id", "snapshot_id"), objects)


_KEYS = """k AS (SELECT o_orderkey AS n, CASE o_orderkey % 6 WHEN 0 THEN 'manifests/' || o_custkey || '/' || o_orderkey || '.json' WHEN 1 THEN 'data/' || o_custkey || '/x' || o_orderkey WHEN 2 THEN '_meta/' || o_orderkey WHEN 3 THEN 'onedrive/data/' || o_custkey || '/y' || o_orderkey WHEN 4 THEN 'onedrive/manifests/' || o_custkey || '/z' || o_orderkey ELSE 'sharepoint/index/' || o_custkey || '/w' || o_orderkey END AS key FROM orders)"""


def _keys(spark, sf):
    n, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    kinds = [F.concat_ws("/", F.lit("manifests"), c, F.concat(n, F.lit(".json"))), F.concat(F.lit("data/"), c, F.lit("/x"), n), F.concat(F.lit("_meta/"), n), F.concat(F.lit("onedrive/data/"), c, F.lit("/y"), n), F.concat(F.lit("onedrive/manifests/"), c, F.lit("/z"), n), F.concat(F.lit("sharepoint/index/"), c, F.lit("/w"), n)]
    return adapters.table(spark, sf, "orders").select(F.col("o_orderkey").alias("n"), F.element_at(F.array(*kinds), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("key"))


@query(f"WITH {_KEYS}, v AS (SELECT key, unnest(['v1', 'v2']) AS version_id FROM k WHERE n % 4 = 1) SELECT key, version_id, CASE WHEN starts_with(key, 'manifests/') OR starts_with(key, 'onedrive/manifests/') THEN 0 ELSE 1 END AS rank FROM k LEFT JOIN v USING (key) WHERE starts_with(key, 'manifests/1/') OR starts_with(key, 'data/1/') OR starts_with(key, 'attachments/1/') OR starts_with(key, 'onedrive/data/1/') OR starts_with(key, 'onedrive/manifests/1/') OR starts_with(key, 'sharepoint/index/1/')")
def deletion_scope(spark, sf):
    """What deleting everything of owner 1 covers: mailbox, drive and site."""
    keys = _keys(spark, sf)
    versions = keys.where(F.col("n") % 4 == 1)
    versions = scopes.all_versions(versions.withColumn("version_id", F.lit("v1")), versions.withColumn("version_id", F.lit("v2")))
    one = F.lit(1)
    parts = [scopes.deletion_targets(keys, versions, p, one) for p in (scopes.MAIL, scopes.DRIVE, scopes.SITE)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query(f"""WITH {_KEYS}, r AS (SELECT n % 40 AS tenant_id, CASE WHEN starts_with(key, 'manifests/') OR starts_with(key, 'data/') THEN 'core' WHEN starts_with(key, '_meta/') THEN 'meta' END AS scope, CASE WHEN n % 40 IN (6, 7, 12) AND n % 3 = 0 THEN 'retained' WHEN n % 40 = 13 THEN 'failed' ELSE 'deleted' END AS outcome FROM k),
c AS (SELECT tenant_id, count(*) FILTER (outcome = 'deleted') AS d, count(*) FILTER (outcome = 'retained') AS r, count(*) FILTER (outcome = 'failed') AS f FROM r WHERE scope = 'core' GROUP BY 1), m AS (SELECT tenant_id, count(*) FILTER (outcome = 'deleted') AS md, count(*) FILTER (outcome = 'retained') AS mr, count(*) FILTER (outcome = 'failed') AS mf FROM r WHERE scope = 'meta' GROUP BY 1)
SELECT tenant_id, CAST(d + CASE WHEN r + f = 0 THEN coalesce(md, 0) ELSE 0 END AS BIGINT) AS deleted, CAST(r + CASE WHEN r + f = 0 THEN coalesce(mr, 0) ELSE 0 END AS BIGINT) AS retained, CAST(f + CASE WHEN r + f = 0 THEN coalesce(mf, 0) ELSE 0 END AS BIGINT) AS failed, r + f = 0 AS meta_purged FROM c LEFT JOIN m USING (tenant_id)""")
def purge_tenants(spark, sf):
    n = F.col("n")
    error = F.when((n % 40).isin(6, 7, 12) & (n % 3 == 0), "Object Lock is on").when(n % 40 == 13, "timeout")
    return scopes.purge(_keys(spark, sf).select((n % 40).alias("tenant_id"), "key", error.alias("error")))


@query("SELECT n_regionkey AS tenant_id, count(*) FILTER (c_custkey % 10 <> 3) AS succeeded, count(*) FILTER (c_custkey % 10 = 3) AS failed, CAST(sum(c_custkey % 7) FILTER (c_custkey % 10 <> 3) AS BIGINT) AS stored, CAST(sum(c_custkey % 5) FILTER (c_custkey % 10 <> 3) AS BIGINT) AS deduplicated, CAST(coalesce(sum(CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 3 END), 0) AS BIGINT) AS attachments FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def tenant_rollup(spark, sf):
    c = F.col("c_custkey")
    ok = c % 10 != 3
    x = adapters.table(spark, sf, "customer").join(adapters.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    x = x.select(F.col("n_regionkey").alias("tenant_id"), F.when(~ok, "failed").alias("error"), F.when(ok, c % 7).alias("stored"), F.when(ok, c % 5).alias("deduplicated"), F.when(c % 4 != 0, c % 3).alias("attachments"))
    return restore.tenant_rollup(x)


@query("""WITH r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS n FROM conversations), s AS (SELECT *, turn % 9 = 4 AS gone, turn % 9 = 5 AS bad FROM r)
SELECT role AS folder, count(*) FILTER (NOT gone) AS saved, count(*) FILTER (gone) AS errors, count(*) FILTER (bad) AS integrity_failures, CAST(coalesce(sum(octet_length(encode(coalesce(text, '')))) FILTER (NOT gone), 0) AS BIGINT) AS bytes FROM s GROUP BY 1""")
def save_archive_summary(spark, sf):
    c = adapters.table(spark, sf, "conversations")
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    e = c.select(F.col("conv_id").alias("folder_id"), F.col("role").alias("folder"), F.col("turn").alias("ordinal"), F.concat("role", F.lit(".eml")).alias("name"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("storage_key"), sha.alias("checksum"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size_bytes"))
    objects = e.where(F.col("ordinal") % 9 != 4).select("storage_key", F.when(F.col("ordinal") % 9 == 5, F.reverse("checksum")).otherwise(F.col("checksum")).alias("checksum"))
    return restore.save_summary(restore.save_plan(e, objects, messages.archive_names(e)), "folder")


_AT = "'2026-01-01T00:' || lpad(CAST(turn % 60 AS VARCHAR), 2, '0') || ':00Z'"


@query(f"""SELECT conv_id, turn, concat_ws(',', 'body', 'from', 'internetMessageId', 'isRead', CASE WHEN turn % 3 > 0 THEN 'receivedDateTime' END, 'sender', CASE WHEN turn % 5 > 0 THEN 'sentDateTime' END, 'subject') AS fields, concat_ws(',', 'Integer 0x0E07=' || CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END, CASE WHEN turn % 3 > 0 THEN 'SystemTime 0x0E06=' || {_AT} END, CASE WHEN turn % 5 > 0 THEN 'SystemTime 0x0039=' || {_AT} END) AS overrides, CASE WHEN turn % 4 > 0 THEN 'folder-' || role ELSE '__unknown__' END AS folder FROM conversations WHERE text IS NOT NULL""")
def message_restore(spark, sf):
    x = messages.sanitize(messages.message_json(adapters.table(spark, sf, "conversations").where("text is not null")))
    return x.select("conv_id", "turn", F.array_join(F.array_sort(F.map_keys("fields")), ",").alias("fields"), F.array_join(F.transform("overrides", lambda o: F.concat_ws("=", o["id"], o["value"])), ",").alias("overrides"), messages.folder_of(F.col("json")).alias("folder"))


@query("""WITH e AS (SELECT event_id AS n, event_id % 12 AS k FROM events) SELECT n, CASE k WHEN 0 THEN 'COMPLIANCE' WHEN 1 THEN 'GOVERNANCE' WHEN 2 THEN 'GOVERNANCE' END AS mode, CASE WHEN k BETWEEN 1 AND 9 THEN CAST(k AS INTEGER) END AS days, CASE WHEN k BETWEEN 1 AND 9 THEN TIMESTAMP '2026-01-01' + to_days(CAST(k AS INTEGER)) END AS until, CASE WHEN k > 8 THEN CAST('2026-01-' || lpad(CAST(k AS VARCHAR), 2, '0') AS TIMESTAMP) END AS day,
 CASE WHEN k IN (0, 1, 2, 9) THEN true ELSE false END AS retryable, CASE WHEN k = 5 THEN 'file' WHEN k % 3 = 0 THEN 'file' WHEN k % 3 = 1 THEN 'folder' ELSE 'folder' END AS kind, CASE WHEN k % 4 = 0 THEN 'full' WHEN k % 4 = 1 THEN 'initial' ELSE 'incremental' END AS sync_mode, k = 6 AS stale FROM e""")
def argument_rules(spark, sf):
    """Rules for single values over made-up arguments: lock mode, retention, dates, errors, kinds, sync mode, stale feeds."""
    n = F.col("event_id")
    k = n % 12
    days = scalars.retention_days(F.when(k < 10, k.cast("string")).otherwise("1.5"))
    mode = scalars.lock_mode(F.when(k == 0, "compliance").when(k == 1, " Governance ").when(k == 3, "none").when(k > 3, "x"), "GOVERNANCE")
    day = F.when(k > 8, F.concat(F.lit("2026-01-"), F.lpad(k.cast("string"), 2, "0"))).otherwise("2026-1-1")
    error = scalars.retryable(F.when(k == 0, 503).otherwise(400), F.when(k == 1, "EPIPE").otherwise("E1"), F.when(k == 2, "Socket Hang Up").when(k == 9, "request aborted by peer").otherwise("no"))
    kind = scalars.item_kind(k % 3 == 0, k % 3 == 1, k == 5)
    mode_of = cdc.sync_mode(k % 4 == 0, F.when(k % 4 == 1, 0).otherwise(2))
    stale = cdc.needs_full_read(F.when(k % 2 == 0, "link").otherwise(""), F.when(k % 4 == 2, 0).otherwise(1), k - 4, F.when(k == 10, 1).otherwise(0))
    return adapters.table(spark, sf, "events").select(n.alias("n"), mode.alias("mode"), days.alias("days"), scalars.retain_until(F.lit(_T0).cast("timestamp_ntz"), days).alias("until"), scalars.parse_date(day).alias("day"), error.alias("retryable"), kind.alias("kind"), mode_of.alias("sync_mode"), stale.alias("stale"))


@query("SELECT c_custkey AS owner_id, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS links, 'new' AS inbox, CASE WHEN c_custkey % 3 = 0 THEN 'old' END AS sent FROM customer")
def delta_links_merged(spark, sf):
    c = F.col("c_custkey")
    saved = F.when(c % 3 == 0, F.create_map(F.lit("inbox"), F.lit("old"), F.lit("sent"), F.lit("old")))
    x = adapters.table(spark, sf, "customer").select(c.alias("owner_id"), cdc.merged_links(saved, F.create_map(F.lit("inbox"), F.lit("new"))).alias("delta_links"))
    rows = cdc.link_rows(x, "owner_id")
    pick = lambda s: F.max(F.when(F.col("source_id") == s, F.col("delta_link"))).alias(s)
    return rows.groupBy("owner_id").agg(F.count(F.lit(1)).cast("int").alias("links"), pick("inbox"), pick("sent"))


@query("SELECT o_orderkey AS n, CASE WHEN o_orderkey % 5 = 0 THEN 'new/' || o_orderkey WHEN o_orderkey % 3 = 0 THEN 'old/' || o_orderkey END AS key FROM orders")
def key_fallback(spark, sf):
    o = adapters.table(spark, sf, "orders").select(F.col("o_orderkey").alias("n"))
    name = lambda p: F.concat(F.lit(p), F.col("n").cast("string"))
    keys = o.where("n % 5 = 0").select(name("new/").alias("key")).unionAll(o.where("n % 3 = 0").select(name("old/").alias("key")))
    return manifests.with_fallback(o.select("n", name("new/").alias("new_key"), name("old/").alias("legacy_key")), keys).select("n", "key")


@query("""WITH n AS (SELECT p_partkey, CAST(p_size AS BIGINT) * 200003 AS n FROM part), c AS (SELECT p_partkey, n, unnest(CASE WHEN n >= 3145728 THEN generate_series(CAST(0 AS BIGINT), n - 1, 4259840) ELSE [CAST(0 AS BIGINT)] END) AS s FROM n)
SELECT p_partkey, s AS "start", CASE WHEN n >= 3145728 THEN least(s + 4259839, n - 1) ELSE n - 1 END AS "end" FROM c""")
def upload_chunk_plan(spark, sf):
    n = F.col("p_size").cast("long") * 200_003
    x = adapters.table(spark, sf, "part").select("p_partkey", F.explode(scalars.upload_chunks(n)).alias("r"))
    return x.select("p_partkey", "r.start", "r.end")


@query("""WITH u AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 6 <> 0 THEN 'User' || c_custkey || '@x.org' END AS mail FROM customer WHERE c_custkey % 9 <> 1) SELECT id AS user_id, mail, CASE WHEN id % 4 = 0 THEN mail ELSE 'Name ' || id END AS display_name, id % 4 <> 1 AS licensed FROM u WHERE mail IS NOT NULL""")
def user_mailboxes(spark, sf):
    from tessera.operators import identity

    c = F.col("c_custkey")
    plan = F.array(F.struct(F.lit("exchange").alias("service"), F.when(c % 4 != 1, "Enabled").otherwise("Deleted").alias("status")))
    users = adapters.table(spark, sf, "customer").select(F.when(c % 9 != 1, c).alias("id"), F.when(c % 6 != 0, F.concat(F.lit("User"), c.cast("string"), F.lit("@x.org"))).alias("mail"), F.when(c % 4 != 0, F.concat(F.lit("Name "), c.cast("string"))).alias("displayName"), plan.alias("assignedPlans"))
    return identity.mailboxes(users).select("user_id", "mail", "display_name", "licensed")


@query(f"WITH {_ITEMS}, v AS (SELECT *, row_number() OVER (PARTITION BY drive_id, item_id ORDER BY ts, seq) AS version FROM items WHERE kind = 'file' AND NOT deleted) SELECT drive_id, item_id, CAST(version AS VARCHAR) AS version_id, path || '/' || name AS logical_path FROM v WHERE version <> 1")
def library_versions(spark, sf):
    """Versions of a library's files without the one that is named 1, with their logical paths."""
    v = catalog.version_history(adapters.delta_items(spark, sf)).withColumn("version_id", F.col("version").cast("string"))
    return catalog.earlier_versions(v, False).select("drive_id", "item_id", "version_id", scalars.logical_path(F.col("path"), F.col("name")).alias("logical_path"))


def _moves(spark, sf):
    from tessera.plans.registry import _identities

    o, c = F.col("o_orderkey").cast("string"), F.col("o_custkey")
    key = F.when(F.col("o_orderkey") % 3 == 0, F.concat_ws("/", F.lit("data"), c.cast("string"), o)).otherwise(F.concat(F.lit("data/User"), (c % 60).cast("string"), F.lit("@example.com/"), o))
    return storage.migrate_keys(adapters.table(spark, sf, "orders").select(key.alias("key")), _identities(spark, sf))


@query("SELECT count(*) AS scanned, count(*) FILTER (o_custkey % 60 < 50 AND o_orderkey % 20 <> 11) AS migrated, count(*) FILTER (o_custkey % 60 < 50 AND o_orderkey % 20 = 11) AS failed, count(DISTINCT o_custkey % 60) AS emails FROM orders WHERE o_orderkey % 3 <> 0")
def migration_summary(spark, sf):
    failed = F.regexp_extract("key", r"/(\d+)$", 1).cast("long") % 20 == 11
    return restore.migration_summary(_moves(spark, sf), failed)


@query("SELECT DISTINCT 'user' || (o_custkey % 60) || '@example.com' AS email FROM orders WHERE o_orderkey % 3 <> 0")
def legacy_owners(spark, sf):
    return _moves(spark, sf).select("email").distinct()


@query(f"""WITH {_ENT}, {_SNAP}, per AS (SELECT snapshot_id, count(*) AS n, CAST(sum(size_bytes + att_bytes) AS BIGINT) AS b, count(DISTINCT coalesce(folder_id, '__unknown__')) AS f FROM ent GROUP BY 1)
SELECT owner_id, snapshot_id, greatest(coalesce(n, 0), snapshot_id % 9) AS total_objects, coalesce(b, 0) AS total_size_bytes, coalesce(f, 0) AS folders, CASE WHEN coalesce(n, 0) = 0 THEN 'cursor only' ELSE 'snapshot' END AS saved FROM snap LEFT JOIN per USING (snapshot_id)""")
def backup_mailbox_totals(spark, sf):
    """What a mailbox backup saves: totals that never fall below those of before, distinct folders, and no snapshot without entries."""
    built = manifests.build(adapters.snapshots(spark, sf), F.col("snapshot_id") % 9)
    folders = F.size(F.array_distinct(F.transform("entries", lambda e: F.coalesce(e["folder_id"], F.lit("__unknown__"))))).cast("long")
    return built.select("owner_id", "snapshot_id", "total_objects", "total_size_bytes", folders.alias("folders"), F.when(F.size("entries") == 0, "cursor only").otherwise("snapshot").alias("saved"))
