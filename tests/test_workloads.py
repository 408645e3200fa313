"""Backups, archives and deletions on small tables, where the queries' tables have no such cases."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tessera.operators import cdc, mailbox, restore, scopes
from tessera.plans import composed

ITEMS = "drive_id long, item_id long, ts timestamp_ntz, seq long, kind string, deleted boolean, path string, name string, etag string, storage_key string, size_bytes long"


def items(spark, rows):
    return spark.createDataFrame([(d, i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=s), s, "file", gone, "/a", "f", e, k, n) for d, i, s, gone, e, k, n in rows], ITEMS)


def test_deleted_entries_count_with_their_sizes(spark):
    x = items(spark, [(1, 1, 0, False, "e", "k1", 10), (1, 1, 1, True, "e", "k1", 7), (2, 2, 2, False, "e", "k1", 5)])
    got = {r.drive_id: (r.entries, r.stored, r.deduplicated, r.deleted, r.size_bytes) for r in cdc.backup_plan(x, spark.createDataFrame([], "storage_key string"), F.lit(False)).collect()}
    assert got == {1: (2, 1, 0, 1, 17), 2: (1, 0, 1, 0, 5)}


def test_only_a_file_that_is_fetched_fails_its_drive(spark):
    """Drives 1 to 3 have a mark on a folder, a deletion and an unchanged file; drive 4 has one on a changed file."""
    rows = [(d, 10 * d + i, 10 * d + s, gone, e, f"k{d}{e}", 1) for d in (1, 2, 3, 4) for i, s, gone, e in ((0, 0, False, "e"), (1, 1, False, "e"), (1, 2, False, "e"), (1, 3, False, "x"), (1, 4, True, "x"))]
    x = items(spark, rows).withColumn("kind", F.when(F.col("item_id") % 10 == 0, "folder").otherwise("file"))
    plan = cdc.backup_plan(x, spark.createDataFrame([], "storage_key string"), F.col("seq").isin(10, 24, 32, 43))
    got = {r.drive_id: (r.entries, r.stored, r.deduplicated, r.deleted, r.size_bytes, r.snapshot, r.cursor_saved) for r in plan.collect()}
    assert got == {1: (3, 2, 0, 1, 3, True, True), 2: (3, 2, 0, 1, 3, True, True), 3: (3, 2, 0, 1, 3, True, True), 4: (0, 0, 0, 0, 0, False, False)}


def test_marks_on_folders_and_unchanged_files_of_the_tables_drop_no_drive(spark):
    """In drive 2 of sf0.001 only a folder is marked; of sf0.01, drives 0 and 7 have marks on unchanged files only."""
    small, large = ({r.drive_id: r.entries for r in composed.backup_drive_plan(spark, f"/root/testdata/{sf}").collect()} for sf in ("sf0.001", "sf0.01"))
    assert small == {0: 57, 1: 90, 2: 53, 3: 97, 4: 104, 5: 87, 6: 124, 7: 60}
    assert large == {0: 781, 1: 0, 2: 0, 3: 0, 4: 786, 5: 995, 6: 0, 7: 989}


def test_versions_only_where_the_blob_was_new(spark):
    x = items(spark, [(1, 1, 0, False, "e", "new", 1), (1, 2, 1, False, "e", "old", 1), (1, 3, 2, True, "e", "gone", 1)])
    versions = spark.createDataFrame([(1, f, f"v{f}{k}", "new" if k == 2 else f"b{k}", 10 * f + k, None) for f in (1, 2, 3) for k in range(3)], "drive_id long, file_id long, version_id string, storage_key string, seq long, status string")
    known = spark.createDataFrame([(1, "v11")], "file_id long, version_id string")
    r = cdc.backup_with_versions(x, spark.createDataFrame([("old",)], "storage_key string"), F.lit(False), versions, known).first()
    # Of file 1: v10 is new, v11 is known, and the key of v12 was stored by the run itself. Files 2 and 3 aren't asked for.
    assert (r.stored, r.deduplicated, r.deleted, r.versions_stored, r.versions_deduplicated, r.healthy) == (1, 1, 1, 1, 1, True)


def test_a_mailbox_without_anything_new_and_one_that_fails(spark):
    folders = spark.createDataFrame([(1, "a", "Inbox"), (1, "b", "Drafts"), (1, None, "x"), (2, "a", "Inbox"), (2, "c", None), (3, "d", "outbox")], "owner_id long, folder_id string, display_name string")
    feed = [(2, "a", 5, 0, "c1", 10, 2, False, False, "l0"), (2, "a", None, 1, "c1", 10, 2, False, False, "l1"), (2, "c", 6, 2, "c1", 10, 2, False, True, "l2"), (1, "b", 7, 3, "c1", 10, 2, False, False, "l3"), (2, "a", 8, 4, "c1", 1, 1, True, False, "l4"), (2, "a", 9, 5, "c1", 3, 1, False, False, None)]
    feed = spark.createDataFrame(feed, "owner_id long, folder_id string, message_id long, seq long, checksum string, size_bytes long, attachments long, removed boolean, failed boolean, delta_link string")
    previous = spark.createDataFrame([(1, 9, {"a": "old"}), (2, 1, None)], "owner_id long, total_objects long, delta_links map<string,string>")
    got = {r.owner_id: r for r in mailbox.backup(feed, folders, previous, spark.createDataFrame([], "storage_key string")).collect()}
    one, two = got[1], got[2]
    assert set(got) == {1, 2}  # owner 3 has excluded folders only
    assert (one.mode, one.stored, one.total_objects, one.delta_links, one.total_folders) == ("incremental", 0, 9, {"a": "old"}, 1)
    assert (two.mode, two.stored, two.deduplicated, two.attachments_stored, two.folder_errors, two.completed_folders, two.total_objects, two.total_size_bytes) == ("initial", 1, 1, 2, 1, 1, 2, 13)
    assert two.delta_links == {"a": "l4"}


def test_paths_in_archives_of_files(spark):
    entries = [(1, 1, "/", "a", "k", "c", 1, "created"), (1, 2, "/x//", "b", "k", "", 2, "moved"), (1, 3, "/x", "c", "k", "other", 3, "updated"), (1, 4, "/x", "d", "", "c", 4, "updated"), (1, 5, "/x", "e", "k", "c", 5, "deleted"), (1, 6, "y", "f", "gone", "c", 6, "created")]
    e = spark.createDataFrame(entries, "drive_id long, file_id long, parent_path string, file_name string, storage_key string, checksum string, size_bytes long, change_type string")
    objects = spark.createDataFrame([("k", "c")], "storage_key string, found string")
    plan = restore.file_save(e, objects)
    assert {(r.path, r.outcome) for r in plan.collect()} == {("a", "saved"), ("x/b", "saved"), ("x/c", "mismatch"), ("y/f", "missing")}
    r = restore.file_save_summary(plan).first()
    assert (r.files_saved, r.files_skipped, r.integrity_failures, r.total_bytes) == (2, 2, 1, 3)
    assert restore.file_save(e, objects, skip_check=True).where("outcome = 'mismatch'").isEmpty()


def test_targets_of_single_snapshots(spark):
    keys = spark.createDataFrame([(k,) for k in ("manifests/a/1.json", "manifests/b/1.json", "manifests/a/11.json", "data/a/1.json", "onedrive/manifests/a/1.json", "onedrive/manifests/b/1.json", "sharepoint/manifests/s/2.json")], "key string")
    asked = spark.createDataFrame([("mail", None, "1"), ("mail", "zz", "1"), ("drive", "a", "1"), ("site", "s", "3"), ("site", "s", "2")], "workload string, owner_id string, snapshot_id string")
    versions = spark.createDataFrame([("onedrive/manifests/a/1.json", "v1"), ("onedrive/manifests/a/1.json", "v2")], "key string, version_id string")
    got = sorted((r.key, r.version_id) for r in scopes.snapshot_targets(keys, versions, asked).collect())
    assert got == [("manifests/a/1.json", None), ("manifests/b/1.json", None), ("onedrive/manifests/a/1.json", "v1"), ("onedrive/manifests/a/1.json", "v2"), ("sharepoint/manifests/s/2.json", None)]


def test_raw_items_of_a_feed(spark):
    raw = [{"id": "1", "name": "é", "parentReference": {"path": "/d/root:/é"}, "file": {}, "size": 3, "webUrl": ""}, {"id": ""}, {"name": "x"}, {"id": "2", "@removed": {"reason": "deleted"}}, {"id": "3", "folder": {"childCount": 1}, "parentReference": {}, "eTag": "e"}]
    rows = cdc.map_items(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(raw)] + [(9, "{broken")], "seq long, json string")).collect()
    got = {r.item_id: (r.seq, r.kind, r.name, r.path, r.size_bytes, r.deleted, r.web_url, r.etag) for r in rows}
    assert got == {"1": (0, "file", "é", "/é", 3, False, None, None), "2": (3, "file", "", "/", 0, True, None, None), "3": (4, "folder", "", "/", 0, False, None, "e")}
