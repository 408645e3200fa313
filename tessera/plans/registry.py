"""The library's own queries by name, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import crypto, scalars, udfs
from tessera.operators import catalog, cdc, identity, limits, merge, messages, profile, stats, storage
from tessera.session import configure
from tessera.sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Common tables of the oracles.
_ENT = """ent AS (SELECT l_orderkey AS snapshot_id, l_partkey AS object_id, concat(l_partkey, ':', l_suppkey) AS storage_key, nullif(l_returnflag, 'A') AS folder_id,
 CAST(l_quantity AS BIGINT) * 1000 + l_linenumber AS size_bytes, l_linenumber AS line, CAST(l_linenumber - 1 AS BIGINT) AS att, CAST((l_linenumber - 1) * (l_suppkey + 1) AS BIGINT) AS att_bytes FROM lineitem)"""
_SNAP = "snap AS (SELECT o_custkey AS owner_id, o_orderkey AS snapshot_id, o_orderdate AS created_at FROM orders)"
_TOT = f"""{_ENT}, {_SNAP}, per AS (SELECT snapshot_id, count(*) AS m, sum(size_bytes + att_bytes) AS s, sum(att) AS a, sum(att_bytes) AS ab FROM ent GROUP BY 1),
tot AS (SELECT snap.*, coalesce(m, 0) AS messages, coalesce(s, 0) AS size_bytes, coalesce(a, 0) AS attachments, coalesce(ab, 0) AS attachment_bytes FROM snap LEFT JOIN per USING (snapshot_id))"""
_SUMS = "CAST(sum(messages) AS BIGINT) AS messages, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, CAST(sum(attachments) AS BIGINT) AS attachments, CAST(sum(attachment_bytes) AS BIGINT) AS attachment_bytes"
_ITEMS = """items AS (SELECT user_id % 8 AS drive_id, user_id AS item_id, ts, event_id AS seq, CASE WHEN user_id % 10 = 0 THEN 'folder' ELSE 'file' END AS kind, event_type = 'error' AS deleted,
 CASE WHEN event_type IN ('view', 'click', 'signup') THEN '/a' ELSE '/b' END AS path, CASE WHEN event_id % 5 = 0 THEN 'g' ELSE 'f' END AS name,
 CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 4 = 0 THEN concat('e', event_id % 3) ELSE 'e0' END AS etag FROM events)"""
_CHG = f"""{_ITEMS}, prev AS (SELECT *, last_value(CASE WHEN NOT deleted THEN path END IGNORE NULLS) OVER w AS pp, last_value(CASE WHEN NOT deleted THEN name END IGNORE NULLS) OVER w AS pn, last_value(CASE WHEN NOT deleted THEN etag END IGNORE NULLS) OVER w AS pe
 FROM items WHERE kind = 'file' WINDOW w AS (PARTITION BY drive_id, item_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chg AS (SELECT * FROM (SELECT *, CASE WHEN deleted THEN 'deleted' WHEN pp IS NULL AND pn IS NULL AND pe IS NULL THEN 'created' WHEN pe IS NULL OR etag IS NULL OR pe <> etag THEN 'updated'
 WHEN pp <> path AND pn <> name THEN 'moved_and_renamed' WHEN pp <> path THEN 'moved' WHEN pn <> name THEN 'renamed' END AS change_type FROM prev) WHERE change_type IS NOT NULL)"""
_BLOB = "blob AS (SELECT doc_id AS seq, lang AS owner_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size_bytes, sha256(coalesce(text, '')) AS checksum, 'data/' || lang || '/' || sha256(coalesce(text, '')) AS storage_key FROM documents)"
_LOG = """log AS (SELECT ts, event_id AS seq, user_id AS tenant_id, CASE WHEN event_type IN ('view', 'click') THEN 'mail' WHEN event_type = 'purchase' THEN 'drive' ELSE 'identity' END AS pool, event_type AS request_type,
 CAST(CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 1 ELSE 2 END AS BIGINT) AS cost, CAST(floor(value * 100) AS BIGINT) AS upload_bytes FROM events)"""


def query(oracle: str | None = None):
    """Register a function under its name, with its oracle."""

    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(configure(spark), sf_dir)

        QUERIES[function.__name__] = run
        if oracle:
            ORACLE_SQL[function.__name__] = oracle
        return function

    return register


@query(f"WITH {_TOT} SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS snapshots, {_SUMS} FROM tot GROUP BY 1")
def stats_monthly(spark, sf):
    return stats.monthly(stats.totals(adapters.heads(spark, sf), adapters.entries(spark, sf)))


@query(f"WITH {_TOT} SELECT count(DISTINCT owner_id) AS owners, count(*) AS snapshots, {_SUMS} FROM tot")
def stats_bucket(spark, sf):
    return stats.bucket(stats.totals(adapters.heads(spark, sf), adapters.entries(spark, sf)))


@query(f"WITH {_TOT} SELECT owner_id, count(*) AS snapshots, {_SUMS} FROM tot GROUP BY 1")
def stats_owner(spark, sf):
    return stats.by_owner(stats.totals(adapters.heads(spark, sf), adapters.entries(spark, sf)))


@query(f"WITH {_ENT} SELECT coalesce(folder_id, 'unknown') AS folder_id, count(*) AS messages, CAST(sum(size_bytes + att_bytes) AS BIGINT) AS size_bytes, CAST(sum(att) AS BIGINT) AS attachments, CAST(sum(att_bytes) AS BIGINT) AS attachment_bytes FROM ent JOIN orders ON o_orderkey = snapshot_id GROUP BY 1")
def stats_folder(spark, sf):
    return stats.folders_of(adapters.flat_entries(spark, sf))


@query(f"WITH {_TOT}, r AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, snapshot_id) AS k FROM tot) SELECT owner_id, count(*) AS snapshots, CAST(max(CASE WHEN k = 1 THEN messages END) AS BIGINT) AS latest_objects, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes, max(created_at) AS last_backup_at FROM r GROUP BY 1")
def catalog_owner_summary(spark, sf):
    return catalog.owner_summary(adapters.snapshots(spark, sf))


@query(f"WITH {_SNAP} SELECT owner_id, snapshot_id, created_at, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, snapshot_id) AS k FROM snap) WHERE k <= 3")
def catalog_snapshots_newest(spark, sf):
    return catalog.newest_snapshots(adapters.heads(spark, sf), 3)


@query(f"WITH {_ENT}, {_SNAP} SELECT owner_id, snapshot_id, ordinal, object_id, storage_key, size_bytes FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY object_id, storage_key, folder_id NULLS FIRST, size_bytes, line) AS ordinal FROM ent JOIN snap USING (snapshot_id)) WHERE ordinal <= 50")
def catalog_entry_ordinals(spark, sf):
    return catalog.entry_ordinals(adapters.snapshots(spark, sf), 50)


@query(f"WITH {_SNAP} SELECT owner_id, snapshot_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, snapshot_id) AS k FROM snap) WHERE k = 1")
def latest_snapshot_per_owner(spark, sf):
    return catalog.latest_snapshot(adapters.heads(spark, sf))


@query(f"WITH {_ENT}, {_SNAP}, r AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY object_id, storage_key, folder_id NULLS FIRST, size_bytes, line) AS k FROM ent) SELECT owner_id, snap.snapshot_id, object_id FROM snap LEFT JOIN r ON r.snapshot_id = snap.snapshot_id AND k = 2")
def catalog_resolve_entry(spark, sf):
    return catalog.resolve_entry(adapters.snapshots(spark, sf), F.lit("2")).select("owner_id", "snapshot_id", "entry.object_id")


_MERGED = """w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, object_id ORDER BY created_at DESC, snapshot_id, line, storage_key, size_bytes) AS k FROM ent JOIN snap USING (snapshot_id) {}) WHERE k = 1)"""
_MERGED_ROWS = "SELECT owner_id, object_id, snapshot_id, created_at, storage_key, folder_id, size_bytes, att AS att_count, att_bytes FROM w"


@query(f"WITH {_ENT}, {_SNAP}, {_MERGED.format('')} {_MERGED_ROWS}")
def merge_newest_wins(spark, sf):
    return merge.newest_wins(adapters.flat_entries(spark, sf))


@query(f"WITH {_ENT}, {_SNAP}, {_MERGED.format("WHERE created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '1998-01-01'")} {_MERGED_ROWS}")
def merge_date_range(spark, sf):
    e = adapters.flat_entries(spark, sf)
    return merge.newest_wins(e.where(merge.in_date_range(F.col("created_at"), dt.date(1996, 1, 1), dt.date(1997, 12, 31))))


@query(f"WITH {_ENT}, {_SNAP}, {_MERGED.format('')} {_MERGED_ROWS} WHERE folder_id = 'R'")
def merge_folder_filter(spark, sf):
    return merge.in_folder(merge.newest_wins(adapters.flat_entries(spark, sf)), adapters.folders(spark), "reports").select("owner_id", "object_id", "snapshot_id", "created_at", "storage_key", "folder_id", "size_bytes", "att_count", "att_bytes")


@query(f"WITH {_ENT}, {_SNAP}, {_MERGED.format('')} SELECT coalesce(folder_id, '__unknown__') AS folder_id, CASE coalesce(folder_id, '') WHEN 'N' THEN 'Notes' WHEN 'R' THEN 'Reports' WHEN 'A' THEN 'Archive' ELSE 'Unknown' END AS display_name, count(*) AS entries, CAST(sum(size_bytes + att_bytes) AS BIGINT) AS size_bytes FROM w GROUP BY 1, 2")
def restore_folder_groups(spark, sf):
    return merge.folder_groups(merge.newest_wins(adapters.flat_entries(spark, sf)), adapters.folders(spark))


@query(f"WITH {_CHG} SELECT drive_id, change_type, count(*) AS n FROM chg GROUP BY 1, 2")
def cdc_change_types(spark, sf):
    return cdc.changes(adapters.delta_items(spark, sf)).groupBy("drive_id", "change_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CHG} SELECT drive_id, item_id, seq, change_type FROM chg")
def cdc_change_rows(spark, sf):
    return cdc.changes(adapters.delta_items(spark, sf)).select("drive_id", "item_id", "seq", "change_type")


@query(f"WITH {_ITEMS}, s AS (SELECT * FROM items WHERE kind = 'file' AND NOT deleted) SELECT drive_id, item_id, arg_max(path, (ts, seq)) AS path, arg_max(name, (ts, seq)) AS name, arg_max(etag, (ts, seq)) FILTER (etag IS NOT NULL) AS etag FROM s GROUP BY 1, 2")
def cdc_file_state_final(spark, sf):
    return cdc.file_state(adapters.delta_items(spark, sf))


@query(f"WITH {_CHG} SELECT drive_id, change_type, count(*) AS n FROM chg WHERE drive_id NOT IN (SELECT drive_id FROM items WHERE seq % 997 = 5) GROUP BY 1, 2")
def cdc_drive_atomic(spark, sf):
    items = adapters.delta_items(spark, sf)
    good = cdc.atomic_drives(items, F.col("seq") % 997 == 5)
    return cdc.changes(good).groupBy("drive_id", "change_type").agg(F.count(F.lit(1)).alias("n"))


_PLAN = f"{_BLOB}, plan AS (SELECT seq, owner_id, storage_key, size_bytes, CASE WHEN seq = min(seq) OVER (PARTITION BY storage_key) AND storage_key NOT IN (SELECT storage_key FROM blob WHERE seq % 7 = 3) THEN 'stored' ELSE 'deduplicated' END AS outcome FROM blob)"


def _plan(spark, sf):
    blobs = adapters.blobs(spark, sf)
    return storage.store_plan(blobs, blobs.where(F.col("seq") % 7 == 3))


@query(f"WITH {_PLAN} SELECT * FROM plan")
def dedup_store_plan(spark, sf):
    return _plan(spark, sf)


@query(f"WITH {_PLAN} SELECT owner_id, count(*) FILTER (outcome = 'stored') AS stored, count(*) FILTER (outcome <> 'stored') AS deduplicated, CAST(coalesce(sum(size_bytes) FILTER (outcome = 'stored'), 0) AS BIGINT) AS stored_bytes, CAST(sum(size_bytes) AS BIGINT) AS logical_bytes FROM plan GROUP BY 1")
def dedup_ratio_by_owner(spark, sf):
    return storage.dedup_ratio(_plan(spark, sf))


@query(f"WITH {_ITEMS} SELECT drive_id, item_id, seq, path, name, row_number() OVER (PARTITION BY drive_id, item_id ORDER BY ts, seq) AS version FROM items WHERE kind = 'file' AND NOT deleted")
def version_history(spark, sf):
    return catalog.version_history(adapters.delta_items(spark, sf)).select("drive_id", "item_id", "seq", "path", "name", "version")


@query(f"WITH {_ITEMS} SELECT drive_id, item_id, count(*) - 1 AS earlier FROM items WHERE kind = 'file' AND NOT deleted GROUP BY 1, 2 HAVING count(*) > 1")
def earlier_versions(spark, sf):
    v = catalog.version_history(adapters.delta_items(spark, sf)).withColumn("position", F.col("version"))
    return catalog.earlier_versions(v, True).groupBy("drive_id", "item_id").agg(F.count(F.lit(1)).alias("earlier"))


_VERIFIED = f"{_BLOB}, v AS (SELECT owner_id, CASE WHEN seq % 41 = 5 THEN 'missing' WHEN seq % 50 = 7 THEN 'mismatch' ELSE 'ok' END AS status FROM blob)"


def _verified(spark, sf):
    """Blobs against a store that lost some and damaged some; every blob has a key of its own there."""
    entries = adapters.blobs(spark, sf).withColumn("storage_key", F.concat_ws("/", "storage_key", F.col("seq").cast("string")))
    objects = entries.where(F.col("seq") % 41 != 5).select("storage_key", F.when(F.col("seq") % 50 == 7, F.reverse("checksum")).otherwise(F.col("checksum")).alias("checksum"))
    return storage.verify(entries, objects)


@query(f"WITH {_VERIFIED} SELECT owner_id, count(*) AS total, count(*) FILTER (status <> 'ok') AS failed, count(*) FILTER (status = 'ok') AS passed, count(*) FILTER (status = 'missing') AS missing FROM v GROUP BY 1")
def verify_checksums(spark, sf):
    return storage.verification_summary(_verified(spark, sf))


@query(f"WITH {_BLOB} SELECT owner_id, count(*) AS issues FROM blob WHERE seq NOT IN (SELECT doc_id FROM labels) GROUP BY 1")
def verify_index_issues(spark, sf):
    index = adapters.table(spark, sf, "labels").select(F.col("doc_id").alias("seq"))
    return storage.index_issues(adapters.blobs(spark, sf), index).groupBy("owner_id").agg(F.count(F.lit(1)).alias("issues"))


_REFS = f"""{_ENT}, refs AS (SELECT o_custkey % 10 AS owner, object_id AS storage_key, size_bytes, snapshot_id * 1000000 + line * 100000 + size_bytes AS reference FROM ent JOIN orders ON o_orderkey = snapshot_id),
o AS (SELECT owner, size_bytes, CASE WHEN storage_key % 97 = 0 THEN 'failed' WHEN storage_key % 10 <> 3 OR reference <> min(reference) OVER (PARTITION BY storage_key) THEN 'skipped' ELSE 'copied' END AS outcome FROM refs)"""


@query(f"WITH {_REFS}, s AS (SELECT owner, count(*) FILTER (outcome = 'copied') AS copied, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed, CAST(coalesce(sum(size_bytes) FILTER (outcome = 'copied'), 0) AS BIGINT) AS bytes_copied FROM o GROUP BY 1) SELECT *, CASE WHEN failed = 0 THEN 'COMPLETED' WHEN copied > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM s")
def replicate_outcomes(spark, sf):
    e = adapters.flat_entries(spark, sf)
    keys = e.select((F.col("owner_id") % 10).alias("owner"), "object_id", F.col("object_id").cast("string").alias("storage_key"), "size_bytes", (F.col("snapshot_id") * 1_000_000 + F.col("line") * 100_000 + F.col("size_bytes")).alias("reference"))
    there = adapters.table(spark, sf, "part").where(F.col("p_partkey") % 10 != 3).select(F.col("p_partkey").cast("string").alias("storage_key"))
    return storage.replication_summary(storage.replicate(storage.object_keys(keys), there, F.col("object_id") % 97 == 0), "owner")


@query(f"WITH {_SNAP} SELECT owner_id, count(*) AS missing, min(created_at) AS oldest FROM snap WHERE snapshot_id % 10 = 3 GROUP BY 1")
def replicate_missing_snapshots(spark, sf):
    heads = adapters.heads(spark, sf)
    return storage.missing_snapshots(heads, heads.where(F.col("snapshot_id") % 10 != 3)).groupBy("owner_id").agg(F.count(F.lit(1)).alias("missing"), F.min("created_at").alias("oldest"))


@query(f"WITH {_ENT}, {_SNAP}, e AS (SELECT snapshot_id, count(*) AS n, sum(size_bytes) AS b FROM ent GROUP BY 1) SELECT owner_id, count(*) AS snapshots, CAST(coalesce(sum(n) FILTER (snapshot_id % 4 <> 0), 0) AS BIGINT) AS copied, count(*) FILTER (snapshot_id % 4 = 0) AS skipped, CAST(coalesce(sum(b) FILTER (snapshot_id % 4 <> 0), 0) AS BIGINT) AS bytes_copied, concat(count(*), '-snapshots') AS label FROM snap LEFT JOIN e USING (snapshot_id) GROUP BY 1")
def rehydrate_rollup(spark, sf):
    heads = adapters.heads(spark, sf)
    return storage.rehydration_summary(heads, heads.where(F.col("snapshot_id") % 4 == 0), adapters.entries(spark, sf))


@query("""WITH k AS (SELECT 'data/' || p_partkey AS key, CASE WHEN p_partkey % 13 = 0 THEN 'Object Lock: retention until 2030' WHEN p_partkey % 17 = 0 THEN 'AccessDenied' WHEN p_partkey % 19 = 0 THEN 'timeout' END AS error FROM part
 UNION ALL SELECT 'manifests/' || o_orderkey, CASE WHEN o_orderkey % 23 = 0 THEN 'WORM protected' END FROM orders)
SELECT CASE WHEN starts_with(key, 'manifests/') THEN 'manifest' ELSE 'object' END AS kind, count(*) FILTER (error IS NULL) AS deleted, count(*) FILTER (error IS NOT NULL AND error <> 'timeout') AS retained, count(*) FILTER (error = 'timeout') AS failed FROM k GROUP BY 1""")
def delete_summary(spark, sf):
    p, o = F.col("p_partkey"), F.col("o_orderkey")
    objects = adapters.table(spark, sf, "part").select(F.concat(F.lit("data/"), p.cast("string")).alias("key"), F.when(p % 13 == 0, "Object Lock: retention until 2030").when(p % 17 == 0, "AccessDenied").when(p % 19 == 0, "timeout").alias("error"))
    manifests = adapters.table(spark, sf, "orders").select(F.concat(F.lit("manifests/"), o.cast("string")).alias("key"), F.when(o % 23 == 0, "WORM protected").alias("error"))
    return storage.deletion_summary(objects.unionByName(manifests))


@query("""WITH p AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
s AS (SELECT c_nationkey, c_custkey % 9 <> 0 AS known, n FROM customer LEFT JOIN p ON o_custkey = c_custkey),
g AS (SELECT c_nationkey AS nation, count(*) AS sources, bool_and(known) AS all_backed_up, CAST(coalesce(sum(n) FILTER (known), 0) AS BIGINT) AS pending FROM s GROUP BY 1)
SELECT *, CASE WHEN NOT all_backed_up THEN 'never backed up' WHEN pending = 0 THEN 'up-to-date' ELSE concat(pending, ' change(s)') END AS status FROM g""")
def status_pending(spark, sf):
    c = F.col("c_custkey")
    sources = adapters.table(spark, sf, "customer").select(c.alias("source_id"), F.col("c_nationkey").alias("nation"))
    cursors = adapters.table(spark, sf, "customer").select(c.alias("source_id"), F.when(c % 9 == 0, "").otherwise(F.concat(F.lit("link-"), c.cast("string"))).alias("delta_link"))
    pending = adapters.table(spark, sf, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("source_id")).agg(F.count(F.lit(1)).alias("pending"))
    return storage.pending_status(sources, cursors, pending, "nation")


_IDENT = "ident AS (SELECT 'user' || (c_custkey % 50) || '@example.com' AS email, c_custkey AS object_id, c_custkey AS seq FROM customer)"


def _identities(spark, sf):
    c = F.col("c_custkey")
    return adapters.table(spark, sf, "customer").select(F.concat(F.lit("user"), (c % 50).cast("string"), F.lit("@example.com")).alias("email"), c.alias("object_id"), c.alias("seq"))


@query(f"WITH {_IDENT}, k AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'data/' || o_custkey || '/' || o_orderkey ELSE 'data/User' || (o_custkey % 60) || '@example.com/' || o_orderkey END AS key FROM orders), m AS (SELECT email, max(object_id) AS object_id FROM ident GROUP BY 1), l AS (SELECT key, lower(split_part(key, '/', 2)) AS email FROM k WHERE key LIKE '%@%') SELECT l.key, l.email, CASE WHEN object_id IS NOT NULL THEN 'data/' || object_id || '/' || split_part(key, '/', 3) END AS new_key, CASE WHEN object_id IS NOT NULL THEN 'migrated' ELSE 'unmapped' END AS action FROM l LEFT JOIN m USING (email)")
def migrate_keys(spark, sf):
    o, c = F.col("o_orderkey").cast("string"), F.col("o_custkey")
    key = F.when(F.col("o_orderkey") % 3 == 0, F.concat_ws("/", F.lit("data"), c.cast("string"), o)).otherwise(F.concat(F.lit("data/User"), (c % 60).cast("string"), F.lit("@example.com/"), o))
    return storage.migrate_keys(adapters.table(spark, sf, "orders").select(key.alias("key")), _identities(spark, sf))


@query(f"WITH {_IDENT}, r AS (SELECT *, lead(object_id) OVER (PARTITION BY email ORDER BY seq) AS successor FROM ident) SELECT email, object_id FROM r WHERE successor IS NULL")
def identity_active(spark, sf):
    return identity.registry(_identities(spark, sf)).where("status = 'active'").select("email", "object_id")


@query(f"WITH {_IDENT}, r AS (SELECT *, lead(object_id) OVER (PARTITION BY email ORDER BY seq) AS successor FROM ident) SELECT email, object_id, successor FROM r WHERE successor IS NOT NULL")
def identity_recycled(spark, sf):
    return identity.registry(_identities(spark, sf)).where("status = 'recycled'").select("email", "object_id", "successor")


@query(f"WITH {_IDENT}, a AS (SELECT email, max(object_id) AS cached FROM ident GROUP BY 1), q AS (SELECT DISTINCT 'user' || (c_custkey % 70) || '@example.com' AS email FROM customer), r AS (SELECT email, cached + 1000000 AS answer FROM a WHERE cached % 3 = 0) SELECT email, coalesce(answer, cached) AS object_id, CASE WHEN answer IS NOT NULL THEN 'remote' WHEN cached IS NOT NULL THEN 'cached' END AS origin FROM q LEFT JOIN r USING (email) LEFT JOIN a USING (email)")
def identity_resolve(spark, sf):
    registered = identity.registry(_identities(spark, sf))
    asked = adapters.table(spark, sf, "customer").select(F.concat(F.lit("user"), (F.col("c_custkey") % 70).cast("string"), F.lit("@example.com")).alias("email")).distinct()
    remote = registered.where((F.col("status") == "active") & (F.col("object_id") % 3 == 0)).select("email", (F.col("object_id") + 1_000_000).alias("object_id"))
    return identity.resolve(asked, remote, registered)


@query("""WITH u AS (SELECT 'u' || o_custkey || '@x.org' AS upn, arg_max(CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey * 10 END AS BIGINT), o_orderkey) AS mailbox_size_bytes, arg_max(CAST(o_orderkey % 100 AS BIGINT), o_orderkey) AS item_count FROM orders GROUP BY 1)
SELECT c_custkey AS user_id, 'U' || c_custkey || '@x.org' AS mail, c_custkey % 4 <> 0 AS licensed, CASE WHEN c_custkey % 4 <> 0 THEN 'Enabled' WHEN c_custkey % 8 = 0 THEN 'Suspended' END AS exchange_plan_status, mailbox_size_bytes, item_count FROM customer LEFT JOIN u ON upn = 'u' || c_custkey || '@x.org'""")
def discovery_usage_join(spark, sf):
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    plan = lambda service, status: F.struct(F.lit(service).alias("service"), status.alias("status"))
    plans = F.array(plan("teams", F.lit("Enabled")), plan("Exchange", F.lit("")), plan("EXCHANGE", F.when(c % 4 != 0, "Enabled").when(c % 8 == 0, "Suspended")))
    licensed, status = identity.license_status(plans)
    boxes = adapters.table(spark, sf, "customer").select(c.alias("user_id"), F.concat(F.lit("U"), c.cast("string"), F.lit("@x.org")).alias("mail"), licensed.alias("licensed"), status.alias("exchange_plan_status"))
    size = F.when(o % 5 == 0, "n/a").otherwise((o * 10).cast("string"))
    line = F.concat(F.lit('"U'), F.col("o_custkey").cast("string"), F.lit('@X.org","say ""hi"", twice",'), size, F.lit(","), (o % 100).cast("string"))
    usage = identity.usage_rows(adapters.table(spark, sf, "orders").select(o.alias("seq"), line.alias("line")), ["upn", "note", "size", "items"])
    return identity.with_usage(boxes, usage)


@query(f"WITH {_LOG} SELECT pool, count(*) AS requests, CAST(sum(cost) AS BIGINT) AS cost, CAST(sum(upload_bytes) AS BIGINT) AS upload_bytes FROM log GROUP BY 1")
def cost_by_pool(spark, sf):
    return limits.cost_by(adapters.request_log(spark, sf), "pool")


@query(f"WITH {_LOG} SELECT request_type, count(*) AS requests, CAST(sum(cost) AS BIGINT) AS cost, CAST(sum(upload_bytes) AS BIGINT) AS upload_bytes FROM log GROUP BY 1")
def cost_by_type(spark, sf):
    return limits.cost_by(adapters.request_log(spark, sf), "request_type")


@query(f'WITH {_LOG} SELECT seq, tenant_id, ts, CAST(sum(cost) OVER w AS BIGINT) AS window_cost, CAST(9600 - sum(cost) OVER w AS BIGINT) AS "left" FROM log WINDOW w AS (PARTITION BY tenant_id ORDER BY ts RANGE BETWEEN INTERVAL 10 MINUTES PRECEDING AND CURRENT ROW)')
def rate_sliding_window(spark, sf):
    return limits.sliding(adapters.request_log(spark, sf))


@query(f"WITH {_LOG} SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, pool, count(*) AS requests, CAST(sum(cost) AS BIGINT) AS cost FROM log GROUP BY 1, 2")
def rate_tumbling(spark, sf):
    return limits.tumbling(adapters.request_log(spark, sf))


@query(f"""WITH {_LOG}, n AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM log WINDOW w AS (PARTITION BY tenant_id ORDER BY ts, seq)), i AS (SELECT *, sum(new) OVER (PARTITION BY tenant_id ORDER BY ts, seq) AS island FROM n)
SELECT tenant_id, min(ts) AS "start", max(ts) + INTERVAL 30 MINUTES AS "end", count(*) AS raises FROM i GROUP BY tenant_id, island""")
def throttle_islands(spark, sf):
    return limits.throttle_islands(adapters.request_log(spark, sf))


@query("""WITH n AS (SELECT o_orderkey AS id, CAST(o_orderkey * o_orderkey * 37 AS BIGINT) AS b FROM orders)
SELECT id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0 + 1e-12) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0 + 1e-12) ELSE printf('%.1f GB', b / 1073741824.0 + 1e-12) END AS bytes,
 CASE WHEN b < 1000 THEN b || 'us' WHEN b < 1000000 THEN printf('%.2fms', b / 1000.0 + CASE WHEN b % 125 = 0 THEN 1e-9 ELSE 0 END) ELSE printf('%.2fs', b / 1000000.0 + CASE WHEN b % 125000 = 0 THEN 1e-9 ELSE 0 END) END AS micros,
 CASE WHEN id = 0 THEN '--' WHEN id < 60 THEN id || 's' WHEN id < 3600 THEN (id // 60) || 'm ' || (id % 60) || 's' ELSE (id // 3600) || 'h ' || (id % 3600 // 60) || 'm' END AS duration FROM n""")
def format_units(spark, sf):
    id_, b = F.col("o_orderkey"), F.col("o_orderkey") * F.col("o_orderkey") * 37
    return adapters.table(spark, sf, "orders").select(id_.alias("id"), scalars.format_bytes(b).alias("bytes"), scalars.format_microseconds(b).alias("micros"), scalars.format_duration(id_.cast("double")).alias("duration"))


@query("""WITH s AS (SELECT o_orderkey, o_orderdate, 'Re: <' || o_orderpriority || '> a/b  "' || o_orderstatus || '"?' AS subject FROM orders)
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d_%H%M%S') || '_' || left(regexp_replace(trim(regexp_replace(subject, '[<>:"/\\\\|?*\\x00-\\x1f]', '', 'g')), '\\s+', '_', 'g'), 80) || '.eml' AS file_name, CASE WHEN length(subject) > 16 THEN left(subject, 15) || '~' ELSE subject END AS cell FROM s""")
def subject_filename(spark, sf):
    subject = F.concat(F.lit("Re: <"), F.col("o_orderpriority"), F.lit('> a/b  "'), F.col("o_orderstatus"), F.lit('"?'))
    return adapters.table(spark, sf, "orders").select("o_orderkey", scalars.eml_filename(F.col("o_orderdate"), subject).alias("file_name"), scalars.truncate_cell(subject, 16).alias("cell"))


@query("""WITH n AS (SELECT p_partkey, CAST(p_size AS BIGINT) * 1000003 AS n FROM part), c AS (SELECT p_partkey, n, unnest(generate_series(CAST(0 AS BIGINT), n - 1, 4194304)) AS s FROM n WHERE n > 0)
SELECT p_partkey, s AS "start", least(s + 4194303, n - 1) AS "end", greatest(30000, CAST(ceil(n / 256.0) AS BIGINT)) AS timeout_ms FROM c""")
def chunk_plan(spark, sf):
    n = F.col("p_size").cast("long") * 1_000_003
    x = adapters.table(spark, sf, "part").select("p_partkey", n.alias("n")).select("p_partkey", "n", F.explode(scalars.byte_ranges(F.col("n"))).alias("r"))
    return x.select("p_partkey", "r.start", "r.end", scalars.chunk_timeout_ms(F.col("n")).alias("timeout_ms"))


#: Blocks that aren't text, comments, tags; then the entities that pages have, the ampersand last; then ends of lines and white space.
_TEXT = "html"
for _tag in ("script", "style", "head"):
    _TEXT = f"regexp_replace({_TEXT}, '(?is)<{_tag}\\b.*?</{_tag}\\s*>', '', 'g')"
_TEXT = f"regexp_replace(regexp_replace({_TEXT}, '(?s)<!--.*?-->', '', 'g'), '<[!/a-zA-Z][^>]*>', '', 'g')"
for _entity, _code in (("nbsp", 160), ("copy", 169), ("middot", 183), ("lt", 60), ("gt", 62), ("quot", 34), ("#39", 39), ("amp", 38)):
    _TEXT = f"regexp_replace({_TEXT}, '&{_entity};?', chr({_code}), 'g')"


@query(f"SELECT page_id, trim(regexp_replace({_TEXT}, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS text FROM pages")
def html_to_text_pages(spark, sf):
    return adapters.table(spark, sf, "pages").select("page_id", udfs.html_to_text("html").alias("text"))


@query("""WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_replace(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1), '/+$', '') AS path FROM pages)
SELECT page_id, CASE WHEN host = '' THEN url WHEN path = '' THEN host ELSE host || ':' || path END AS site FROM p""")
def site_reference(spark, sf):
    return adapters.table(spark, sf, "pages").select("page_id", scalars.site_reference(F.col("url")).alias("site"))


@query("SELECT p_partkey, '/' || replace(p_brand, '#', '/') || '/' || p_name AS path FROM part WHERE nfc_normalize(trim('/' || replace(p_brand, '#', '/'))) = '/Brand/13'")
def path_lookup(spark, sf):
    folder = F.concat(F.replace("p_brand", F.lit("#"), F.lit("\\")), F.lit(" "))
    files = adapters.table(spark, sf, "part").select("p_partkey", "p_name", udfs.nfc(scalars.normalize_path(folder)).alias("folder"))
    return catalog.find_by_path(files, "Brand\\13", "folder", "p_partkey").select("p_partkey", scalars.logical_path(F.col("folder"), F.col("p_name")).alias("path"))


@query("SELECT conv_id, turn, text AS body, role AS sender, 'turn ' || turn AS subject, CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS read_flag, false AS is_draft FROM conversations")
def message_sanitize(spark, sf):
    x = messages.sanitize(messages.message_json(adapters.table(spark, sf, "conversations")))
    f = F.col("fields")
    return x.select("conv_id", "turn", f["body"].alias("body"), f["from"].alias("sender"), f["subject"].alias("subject"), "read_flag", "is_draft")


@query("WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS n FROM conversations) SELECT conv_id AS folder_id, turn AS ordinal, role || '.eml' AS name, role || CASE WHEN n = 0 THEN '' ELSE '_' || n END || '.eml' AS file_name FROM r")
def archive_names(spark, sf):
    x = adapters.table(spark, sf, "conversations").select(F.col("conv_id").alias("folder_id"), F.col("turn").alias("ordinal"), F.concat("role", F.lit(".eml")).alias("name"))
    return messages.archive_names(x)


@query()
def eml_messages(spark, sf):
    c = adapters.table(spark, sf, "conversations")
    none = F.lit(None).cast("string")
    return c.select("conv_id", "turn", udfs.build_eml(F.concat("role", F.lit("@example.com")), F.lit("me@example.com"), F.concat(F.lit("turn "), F.col("turn").cast("string")), none, none, "text").alias("eml"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS plain_sha256, CAST(octet_length(encode(coalesce(text, ''))) + 28 AS BIGINT) AS blob_bytes, true AS tampered_is_null FROM documents")
def crypto_roundtrip(spark, sf):
    keys, key = crypto.key_table(spark, {"tenant": crypto.key_of("correct horse", "tenant", n=2**14)}), F.col("data_key")
    body = F.coalesce("text", F.lit("")).cast("binary")
    x = adapters.table(spark, sf, "documents").withColumn("tenant", F.lit("tenant")).join(keys, "tenant").select("doc_id", "data_key", crypto.encrypt(body, key).alias("blob"))
    bad = F.concat(F.col("blob"), F.lit(b"x"))
    return x.select("doc_id", F.sha2(crypto.decrypt(F.col("blob"), key), 256).alias("plain_sha256"), F.octet_length("blob").cast("long").alias("blob_bytes"), crypto.decrypt(bad, key).isNull().alias("tampered_is_null"))


_FUN = "f AS (SELECT p_partkey AS function_id, p_brand AS name, coalesce(CAST(s AS BIGINT), 0) AS self_us FROM part LEFT JOIN (SELECT l_partkey, sum(CAST(l_quantity AS BIGINT)) AS s FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"


def _functions(spark, sf):
    used = adapters.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum(F.col("l_quantity").cast("long")).alias("s"))
    return adapters.table(spark, sf, "part").join(used, "p_partkey", "left").select(F.col("p_partkey").alias("function_id"), F.col("p_brand").alias("name"), F.coalesce("s", F.lit(0)).cast("long").alias("self_us"))


@query(f"WITH {_FUN}, d AS (SELECT *, CASE WHEN name LIKE 'Brand#1%' THEN 'crypto' WHEN name LIKE 'Brand#2%' THEN 'storage' WHEN regexp_matches(name, 'Brand#[34]') THEN 'network' ELSE 'other' END AS domain FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY self_us DESC, function_id) AS k FROM d) SELECT domain, CAST(sum(self_us) AS BIGINT) AS self_us, count(*) AS functions, string_agg(CAST(function_id AS VARCHAR), ',' ORDER BY k) FILTER (k <= 5) AS top FROM r GROUP BY 1")
def profile_domains(spark, sf):
    return profile.by_domain(_functions(spark, sf))


@query(f"WITH {_FUN} SELECT function_id, name, self_us FROM f WHERE self_us > 0 ORDER BY self_us DESC, function_id LIMIT 30")
def profile_top_functions(spark, sf):
    return profile.top_functions(_functions(spark, sf))


@query(f"WITH RECURSIVE {_FUN}, t AS (SELECT function_id AS node, function_id AS place, self_us FROM f UNION ALL SELECT node, place // 16, self_us FROM t WHERE place > 0) SELECT place AS node, CASE WHEN place > 0 THEN place // 16 END AS parent, CAST(sum(t.self_us) AS BIGINT) AS total_us FROM t GROUP BY 1, 2")
def profile_total_time(spark, sf):
    n = F.col("function_id")
    nodes = _functions(spark, sf).select(n.alias("node"), F.when(n > 0, F.floor(n / 16)).alias("parent"), "self_us")
    return profile.total_time(nodes).select("node", "parent", "total_us")


@query(f"""WITH RECURSIVE {_FUN}, t AS (SELECT function_id AS node, function_id AS place, self_us FROM f UNION ALL SELECT node, place // 16, self_us FROM t WHERE place > 0),
tot AS (SELECT place AS node, CASE WHEN place > 0 THEN place // 16 END AS parent, CAST(sum(t.self_us) AS BIGINT) AS total_us FROM t GROUP BY 1, 2), heavy AS (SELECT parent AS node, arg_max(node, (total_us, -node)) AS child FROM tot WHERE parent IS NOT NULL GROUP BY 1),
top AS (SELECT node, total_us FROM tot WHERE parent = 0 ORDER BY total_us DESC, node LIMIT 8), w AS (SELECT node AS start, total_us, node AS here, CAST(node AS VARCHAR) AS path FROM top UNION ALL SELECT start, total_us, child, path || ',' || child FROM w JOIN heavy ON here = heavy.node)
SELECT start, total_us, path FROM w WHERE here NOT IN (SELECT node FROM heavy)""")
def profile_hot_paths(spark, sf):
    n = F.col("function_id")
    nodes = _functions(spark, sf).select(n.alias("node"), F.when(n > 0, F.floor(n / 16)).alias("parent"), "self_us")
    x = profile.hot_paths(profile.total_time(nodes))
    return x.select("start", "total_us", F.array_join(F.transform("path", lambda v: v.cast("string")), ",").alias("path"))


@query("SELECT doc_id, 'data/' || lang || '/' || sha256(coalesce(text, '')) AS storage_key, coalesce(lang, '') NOT IN ('', '.', '..') AS valid, CASE WHEN n_chars >= 536870912 THEN 'large' ELSE 'small' END AS route, left(sha256(coalesce(source, '') || '|' || coalesce(lang, '')), 16) AS target FROM documents")
def storage_keys(spark, sf):
    d = adapters.table(spark, sf, "documents")
    body = F.coalesce("text", F.lit("")).cast("binary")
    lang, source = F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    return d.select("doc_id", F.concat(F.lit("data/"), F.col("lang"), F.lit("/"), F.sha2(body, 256)).alias("storage_key"), scalars.valid_segment(lang).alias("valid"), scalars.storage_path(F.col("n_chars")).alias("route"), scalars.target_id(source, lang).alias("target"))


@query("""WITH e AS (SELECT event_id, CAST(event_id % 9 AS INTEGER) AS attempt, CASE event_id % 5 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 404 WHEN 3 THEN 200 ELSE 410 END AS status FROM events)
SELECT event_id, status IN (429, 503, 504) AS retryable, status IN (404, 410) AS unavailable, CAST(least(CASE WHEN event_id % 7 = 0 THEN 4321 ELSE 1000 * power(2, attempt) END, 300000) AS BIGINT) AS delay_ms FROM e""")
def retry_decisions(spark, sf):
    n = F.col("event_id")
    status = F.element_at(F.array(*(F.lit(x) for x in (429, 503, 404, 200, 410))), (n % 5 + 1).cast("int"))
    return adapters.table(spark, sf, "events").select("event_id", scalars.retryable(status).alias("retryable"), scalars.version_unavailable(status, F.lit(None).cast("string")).alias("unavailable"), scalars.retry_delay_ms(n % 9, F.when(n % 7 == 0, F.lit(4321).cast("long"))).alias("delay_ms"))
