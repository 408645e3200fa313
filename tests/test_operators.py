"""Literal cases for the library's operators and functions."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import crypto, scalars, udfs
from tessera.operators import catalog, cdc, identity, limits, manifests, merge, messages, profile, stats, storage
from tessera.sources import adapters
from tessera.streaming import cdc_stream

SF = "/root/testdata/sf0.001"


def snapshot(owner, id_, at, sizes, attachments=None):
    entries = [(i, f"k{i}", "f", s, 1, [(a,) for a in attachments[i]] if attachments else None) for i, s in enumerate(sizes)]
    return (owner, id_, dt.datetime.fromisoformat(at), entries)


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, schemas.SNAPSHOTS)


def test_bucket_totals(frame):
    rows = [snapshot(1, 1, "2026-01-15", [200, 300]), snapshot(1, 2, "2026-03-10", [150]), snapshot(2, 3, "2026-01-20", [400])]
    assert tuple(stats.bucket(frame(rows)).first()) == (2, 3, 4, 1050, 0, 0)


def test_nested_attachments(frame):
    row = stats.bucket(frame([snapshot(1, 1, "2026-01-01", [100, 50], [[500, 300], []])])).first()
    assert (row.messages, row.size_bytes, row.attachments, row.attachment_bytes) == (2, 950, 2, 800)


def test_months_and_empty_snapshots(frame):
    rows = [snapshot(1, 1, "2026-01-15", [100]), snapshot(1, 2, "2026-03-10", [200]), snapshot(1, 3, "2026-01-20", [150]), snapshot(1, 4, "2026-02-01", [])]
    got = {r.month: (r.snapshots, r.messages, r.size_bytes) for r in stats.monthly(frame(rows)).collect()}
    assert got == {"2026-01": (2, 2, 250), "2026-03": (1, 1, 200), "2026-02": (1, 0, 0)}


def test_no_snapshots(frame):
    assert tuple(stats.bucket(frame([])).first()) == (0, 0, 0, 0, 0, 0)
    assert stats.monthly(frame([])).count() == stats.by_owner(frame([])).count() == stats.by_folder(frame([])).count() == 0


def test_owners_add_up_to_the_bucket(spark):
    s = adapters.snapshots(spark, SF)
    total = stats.bucket(s).first()
    sums = stats.by_owner(s).agg(*(F.sum(m).alias(m) for m in ("snapshots", *stats.MEASURES))).first()
    assert all(total[m] == sums[m] for m in ("snapshots", *stats.MEASURES))


def test_resolve_entry(frame):
    s = frame([snapshot(1, 1, "2026-01-01", [10, 20, 30])])
    pick = lambda ref: catalog.resolve_entry(s, F.lit(ref)).first().entry
    assert pick("2").size_bytes == 20 and pick("0").size_bytes == 10 and pick("9") is None and pick("x") is None


def test_date_range_includes_the_end_day(spark):
    rows = spark.createDataFrame([(i, dt.datetime(2026, 3, d, 12)) for i, d in enumerate((1, 5, 10), 1)], "id int, at timestamp_ntz")
    ids = lambda **k: {r.id for r in rows.where(merge.in_date_range(F.col("at"), **k)).collect()}
    assert ids(start=dt.date(2026, 3, 5)) == {2, 3} and ids(end=dt.date(2026, 3, 5)) == {1, 2} and ids() == {1, 2, 3}


def test_newest_wins(spark):
    at = {"new": dt.datetime(2026, 2, 1), "old": dt.datetime(2026, 1, 1)}
    rows = [(1, 2 if s == "new" else 1, at[s], ord(o), s, None, 1, 1, 0, 0) for s, o in (("new", "a"), ("new", "b"), ("old", "b"), ("old", "c"))]
    out = merge.newest_wins(spark.createDataFrame(rows, schemas.ENTRIES)).collect()
    assert {(chr(r.object_id), r.storage_key) for r in out} == {("a", "new"), ("b", "new"), ("c", "old")}


def test_folders(spark):
    dim = spark.createDataFrame([("2", "Inbox"), ("1", "INBOX"), ("3", "Drafts"), (None, "x")], "folder_id string, display_name string")
    e = spark.createDataFrame([("1",), ("2",), (None,)], "folder_id string")
    assert [r.folder_id for r in merge.in_folder(e, dim, "inbox").collect()] == ["1"] and merge.in_folder(e, dim, "none").count() == 0
    assert {r.folder_id for r in merge.exclude_folders(dim, schemas.EXCLUDED_FOLDERS).collect()} == {"1", "2"}


@pytest.mark.parametrize("seed", range(3))
def test_classification_is_the_same_as_a_loop(spark, seed):
    import random

    draw, rows = random.Random(seed), []
    for seq in range(200):
        rows.append((draw.randrange(2), draw.randrange(4), dt.datetime(2026, 1, 1) + dt.timedelta(minutes=draw.randrange(60)), seq, "file", draw.random() < 0.2, draw.choice(["/a", "/b", ""]), draw.choice(["f", "g", ""]), draw.choice([None, "", "e1", "e2"])))
    want, state = {}, {}
    for d, i, ts, seq, _, deleted, path, name, etag in sorted(rows, key=lambda r: (r[2], r[3])):
        pp, pn, pe = state.get((d, i), (None, None, None))
        moved, renamed = bool(pp) and pp != path, bool(pn) and pn != name
        if deleted:
            change = "deleted"
        elif not (pp or pn or pe):
            change = "created"
        elif not etag or not pe or etag != pe:
            change = "updated"
        else:
            change = "moved_and_renamed" if moved and renamed else "moved" if moved else "renamed" if renamed else None
        if not deleted:
            state[d, i] = (path, name, etag or pe)
        if change:
            want[seq] = change
    items = spark.createDataFrame(rows, schemas.DELTA_ITEMS)
    assert {r.seq: r.change_type for r in cdc.changes(items).collect()} == want
    got = {(r.drive_id, r.item_id): (r.path, r.name, r.etag) for r in cdc.file_state(items).collect()}
    assert got == state


def test_truth_table(spark):
    """Batch and stream against the rules, with missing and empty values on both sides."""
    kinds = list(itertools.product([False, True], [None, "", "/a"], [None, "", "f"], [None, "e", "x"], [None, "/a", "/b"], [None, "f", "g"], [None, "e"]))
    df = spark.createDataFrame(kinds, "deleted boolean, path string, name string, etag string, pp string, pn string, pe string")
    for r in df.select("*", cdc.change_type(*(F.col(c) for c in df.columns)).alias("change")).collect():
        moved, renamed = r.pp is not None and r.pp != r.path, r.pn is not None and r.pn != r.name
        if r.deleted:
            want = "deleted"
        elif r.pp is None and r.pn is None and r.pe is None:
            want = "created"
        elif r.etag is None or r.pe is None or r.etag != r.pe:
            want = "updated"
        else:
            want = "moved_and_renamed" if moved and renamed else "moved" if moved else "renamed" if renamed else None
        assert r.change == want
        assert r.deleted or cdc_stream._change((r.path, r.name, r.etag), (r.pp, r.pn, r.pe)) == want


def test_reset_forgets_files_only(spark):
    state = spark.createDataFrame([("file", "/a", "f", "e"), ("folder", "/b", "g", None)], "kind string, path string, name string, etag string")
    assert {tuple(r) for r in cdc.after_reset(state).collect()} == {("file", None, None, None), ("folder", "/b", "g", None)}


def test_replication_status(spark):
    x = spark.createDataFrame([(3, 0), (2, 1), (0, 2), (0, 0)], "copied int, failed int")
    assert [r[0] for r in x.select(storage.replication_status(F.col("copied"), F.col("failed"))).collect()] == ["COMPLETED", "PARTIAL", "FAILED", "COMPLETED"]


def test_deletion_outcomes(spark):
    x = spark.createDataFrame([(None,), ("Object Lock is on",), ("WORM protected",), ("no route",)], "error string")
    assert [r[0] for r in x.select(storage.deletion_outcome(F.col("error"))).collect()] == ["deleted", "retained", "retained", "failed"]


def test_recycled_addresses(spark):
    x = spark.createDataFrame([("a@x", 1, 1), ("a@x", 2, 2), ("b@x", 3, 3), ("a@x", 4, 4)], "email string, object_id long, seq long")
    assert {(r.object_id, r.status, r.successor) for r in identity.registry(x).collect()} == {(1, "recycled", 2), (2, "recycled", 4), (4, "active", None), (3, "active", None)}


def test_usage_lines(spark):
    lines = spark.createDataFrame([(1, '"A@x","say ""hi"", you",5,6'), (2, "a@X,n,bad,7"), (3, "b@x,n,,1")], "seq long, line string")
    got = {r.upn: (r.mailbox_size_bytes, r.item_count) for r in identity.usage_rows(lines, ["upn", "note", "size", "items"]).collect()}
    assert got == {"a@x": (0, 7), "b@x": (0, 1)}


def test_throttle_islands_meet_at_their_ends(spark):
    t0 = dt.datetime(2026, 1, 1)
    x = spark.createDataFrame([(1, i, t0 + dt.timedelta(minutes=m)) for i, m in enumerate((0, 10, 39, 69, 100))], "tenant_id long, seq long, ts timestamp_ntz")
    got = sorted(((r.start - t0).seconds // 60, r.raises) for r in limits.throttle_islands(x).collect())
    assert got == [(0, 3), (69, 1), (100, 1)]


def test_encryption(spark):
    key, other = crypto.key_of("pass", "t1", n=2**14), crypto.key_of("pass", "t2", n=2**14)
    x = spark.createDataFrame([(b"",), (b"hello",), (bytes(range(256)),)], "data binary").withColumn("blob", crypto.encrypt(F.col("data"), F.lit(key)))
    x = x.select("data", F.octet_length("blob").alias("n"), crypto.decrypt(F.col("blob"), F.lit(key)).alias("ok"), crypto.decrypt(F.col("blob"), F.lit(other)).alias("other"))
    assert all(bytes(r.ok) == bytes(r.data) and r.other is None and r.n == len(r.data) + 28 for r in x.collect())
    with pytest.raises(ValueError):
        crypto.key_of("p", "t", n=1000)
    known = spark.range(1).select(F.hex(crypto.encrypt(F.lit(bytes(16)), F.lit(bytes(32)), F.lit(bytes(12)))).alias("b")).first().b
    assert known == "00" * 12 + "D0D1C8A799996BF0265B98B5D48AB919" + "CEA7403D4D606B6E074EC5D3BAF39D18"


def test_html(spark):
    cases = {"<p>a</p>\n\n\n\n<p>b</p>": "a\n\nb", "<p>safe</p><script>x()</script><p>also safe</p>": "safealso safe", "word1&nbsp;word2": "word1 word2", "<head><title>t</title></head>x<br>y &amp; z": "xy & z", "<p>before</p><script >evil()</script ><p>after</p>": "beforeafter", "&amp;lt;script&amp;gt;": "&lt;script&gt;", "&#x3c;tag&#62;": "<tag>", '<a title="click > here">link</a>': "link", "   \n\n  ": "", "": ""}
    for html, text in cases.items():
        assert udfs.plain_text(html) == text
    assert udfs.plain_text(None) is None


def test_names_and_paths(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(scalars.normalize_path(F.lit("\\a\\b "))) == "/a/b" and one(scalars.normalize_path(F.lit("a/b"))) == "/a/b"
    assert one(scalars.parent_path(F.lit("/drives/1/root:/Docs"))) == "/Docs" and one(scalars.parent_path(F.lit("/drive/root:"))) == "/" and one(scalars.parent_path(F.lit("/x"))) == "/x"
    assert one(scalars.sanitize_segment(F.lit("..a<b>.."))) == "a_b_" and one(scalars.sanitize_segment(F.lit(" . "))) == "Unknown"
    assert one(scalars.site_reference(F.lit("https://h.com/sites/x/"))) == "h.com:/sites/x" and one(scalars.site_reference(F.lit("https://h.com/"))) == "h.com" and one(scalars.site_reference(F.lit("id,1"))) == "id,1"
    assert one(scalars.format_recipient(F.lit("N"), F.lit("a@x"))) == "N <a@x>" and one(scalars.format_recipient(F.lit(""), F.lit(None).cast("string"))) == "(unknown)"
    assert one(scalars.format_bytes(F.lit(1536).cast("long"))) == "1.5 KB" and one(scalars.format_bytes(F.lit(1023).cast("long"))) == "1023 B"
    assert one(scalars.format_duration(F.lit(3725.0))) == "1h 2m" and one(scalars.format_duration(F.lit(0.0))) == "--"
    assert [tuple(r) for r in one(scalars.byte_ranges(F.lit(10).cast("long"), 4))] == [(0, 3), (4, 7), (8, 9)] and one(scalars.byte_ranges(F.lit(0).cast("long"))) == []
    assert one(scalars.mask_subject(F.lit("s"))) == "HIDDEN" and one(scalars.mask_subject(F.lit(""), True)) == "(no subject)"


def test_preview_and_sanitize(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    none = F.lit(None).cast("string")
    assert one(messages.preview(F.lit("text"), none, none)) == "(no body)" and one(messages.preview(F.lit("text"), F.lit(" "), none)) == "(empty body)" and one(messages.preview(F.lit("HTML"), F.lit("<p>x"), F.lit("x"))) == "x"
    got = messages.sanitize(spark.createDataFrame([('{"subject":"s","@odata.etag":"e","isDraft":true,"isRead":false}',)], "json string")).first()
    assert dict(got.fields) == {"subject": "s", "isRead": "false"} and got.is_draft is False and got.read_flag == 0


def test_profile_tree(spark):
    nodes = spark.createDataFrame([(0, None, 1), (1, 0, 2), (2, 0, 3), (3, 1, 10)], "node long, parent long, self_us long")
    total = profile.total_time(nodes)
    assert {r.node: r.total_us for r in total.collect()} == {0: 16, 1: 12, 2: 3, 3: 10}
    assert {r.node: r.child for r in profile.hot_children(total).collect()} == {0: 1, 1: 3}


def test_hot_paths(spark):
    nodes = spark.createDataFrame([(0, None, 1), (1, 0, 2), (2, 0, 30), (3, 1, 10), (4, 3, 1), (5, 1, 3)], "node long, parent long, self_us long")
    assert {r.start: (r.total_us, r.path) for r in profile.hot_paths(profile.total_time(nodes)).collect()} == {1: (16, [1, 3, 4]), 2: (30, [2])}
    chain = spark.range(200).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(1).cast("long").alias("self_us"))
    assert {r.node: r.total_us for r in profile.total_time(chain).collect()} == {i: 200 - i for i in range(200)}


def test_wrapped_keys(spark):
    data, n = bytes(range(32)), 2**14
    blob = crypto.wrap_key(spark, data, "pass", "t", n=n)
    assert crypto.unwrap_key(spark, blob, "pass", "t") == data and len(blob) == 10 + 28 + 32
    assert crypto.unwrap_key(spark, blob, "other", "t") is None and crypto.unwrap_key(spark, blob, "pass", "u") is None
    changed = blob[:9] + bytes([2]) + blob[10:]
    assert crypto.unwrap_key(spark, changed, "pass", "t") is None
    for bad in (b"", blob[:20], b"\x02" + blob[1:]):
        with pytest.raises(ValueError):
            crypto.parse_wrapped(bad)
    assert crypto.keys_match(spark, blob, None, "pass", "t") and crypto.keys_match(spark, blob, crypto.wrap_key(spark, data, "pass", "t", n=n), "pass", "t")
    assert not crypto.keys_match(spark, blob, crypto.wrap_key(spark, data[::-1], "pass", "t", n=n), "pass", "t")


def test_small_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(scalars.rate(F.lit(10), F.lit(4.0))) == 2.5 and one(scalars.rate(F.lit(10), F.lit(0.0))) == 0 and one(scalars.eta(F.lit(30), F.lit(10), F.lit(4.0))) == 5
    assert one(scalars.pad_cell(F.lit("ab"), 4)) == "ab  " and one(scalars.content_md5(F.lit(b"a"))) == "DMF1ucDxtqgxw5niaXcmYQ=="
    assert one(merge.missing_after_restore(F.lit(5), F.lit(3))) == 2 and one(merge.missing_after_restore(F.lit(3), F.lit(5))) == 0
    assert one(cdc.stale_link(F.lit("https://x?a=1"))) is True and one(cdc.stale_link(F.lit("x?$select=id"))) is False and one(cdc.stale_link(F.lit(None).cast("string"))) is True
    kept, more = scalars.first_errors(F.array(*(F.lit(str(i)) for i in range(12))))
    assert len(one(kept)) == 10 and one(more) == "... and 2 more" and one(scalars.first_errors(F.array(F.lit("a")))[1]) is None
    pairs = F.array(F.struct(F.lit("N").alias("name"), F.lit("a@x").alias("address")), F.struct(F.lit("").alias("name"), F.lit("b@x").alias("address")))
    assert one(messages.recipients(pairs)) == "N <a@x>, b@x" and one(messages.recipients(F.lit(None).cast("array<struct<name:string,address:string>>"))) == ""
    assert one(scalars.sanitize_subject(F.lit(None).cast("string"))) == "no-subject"
    mixed = spark.createDataFrame([("u1", "U1"), ("u2", "u1")], "owner_id string, other string")
    assert [r.owner_id for r in manifests.of_owner(mixed, "U1").collect()] == ["u1"] and manifests.of_owner(mixed, "U1", "other").count() == 1
    versions = spark.createDataFrame([("f", "1", 1), ("f", "2", 2)], "file_id string, version_id string, position int")
    assert [r.version_id for r in catalog.earlier_versions(versions, False).collect()] == ["2"] and [r.version_id for r in catalog.earlier_versions(versions, True).collect()] == ["2"]
    boxes = spark.createDataFrame([("A@x", True), ("b@x", False)], "mail string, licensed boolean")
    usage = spark.createDataFrame([("a@x", 5)], "upn string, items int")
    assert [(r.mail, r["items"]) for r in identity.with_usage(boxes, usage, True).collect()] == [("A@x", 5)]


def test_attachments_and_stored_messages(spark):
    rows = [("#microsoft.graph.fileAttachment", "a", "aGk=", None), ("#microsoft.graph.fileAttachment", "b", None, 9), ("#microsoft.graph.itemAttachment", "c", "aGk=", 1)]
    got = messages.file_attachments(spark.createDataFrame(rows, "type string, name string, contentBytes string, size long")).collect()
    assert [(r.name, bytes(r.content), r.size_bytes) for r in got] == [("a", b"hi", 2), ("b", b"", 9)]
    m = messages.stored_message(spark.createDataFrame([('{"subject":"é"}',)], "json string")).first()
    assert (m.subject, m.folder_id, m.size_bytes) == ("é", "", 16)


def test_stream_in_batches_equals_batch(spark, tmp_path):
    """State left by earlier micro-batches gives the changes of one batch."""
    from collections import Counter

    sf = "/root/testdata/sf0.001"
    rows = lambda df: Counter((r.drive_id, r.item_id, r.seq, r.change_type) for r in df.select("drive_id", "item_id", "seq", "change_type").collect())
    from tessera.sources import adapters

    # The events in files by time, of which each micro-batch takes two.
    for quarter in range(5):
        part = spark.read.parquet(f"{sf}/events.parquet").where(F.floor((F.dayofmonth("ts") - 1) / 7) == quarter)
        part.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/events")
    assert rows(cdc_stream.run_available(spark, f"file://{tmp_path}/events", "test-stream", 2)) == rows(cdc.changes(adapters.delta_items(spark, sf)))


def test_the_entry_module_works_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
