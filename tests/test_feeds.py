"""Delta source, ordered commit, tracker with resets, object store: restarts, crashes and pruning."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.sources import delta_feed, object_store
from tessera.streaming import commit, tracking

ITEMS = "drive_id long, item_id long, ts timestamp_ntz, seq long, kind string, deleted boolean, path string, name string, etag string"


def made(n, drives=3, seed=1):
    dice = random.Random(seed)
    at = dt.datetime(2024, 1, 1)
    return [
        (dice.randrange(drives), dice.choice([None, 1, 2, 3, 4]), at + dt.timedelta(hours=5 * i), i, dice.choice(["file", "file", "folder"]), dice.random() < 0.2, dice.choice(["/a", "/b"]), dice.choice(["f", "g", ""]), dice.choice([None, "", "e1", "e2"]))
        for i in range(n)
    ]


def saved_rows(spark, folder):
    docs = Counter((r.drive_id, r.item_id, r.seq, r.page, r.epoch) for r in commit.saved(spark, folder, "documents", "drive_id bigint, item_id bigint, seq bigint, page bigint, epoch bigint").collect())
    index = Counter((r.drive_id, r.item_id, r.versions, r.last_seq) for r in commit.saved(spark, folder, "indexes", "drive_id bigint, item_id bigint, versions bigint, last_seq bigint").groupBy("drive_id", "item_id").agg(F.sum("versions").alias("versions"), F.max("last_seq").alias("last_seq")).collect())
    return docs, index, commit.cursor_links(spark, folder)


def start(spark, pages, folder, per_batch, links=None, before=None):
    stream = delta_feed.read_feed(spark, pages, per_batch, links)
    sink = commit.OrderedCommit(folder, commit.feed_tables(), before)
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def test_a_feed_that_is_stopped_killed_and_grows(spark, tmp_path):
    """Each try dies ahead of another step; pages come in between. Nothing is lost, and nothing is there twice."""
    rows, pages, folder, whole = made(120), f"file://{tmp_path}/pages", f"file://{tmp_path}/saved", f"file://{tmp_path}/whole"
    delta_feed.write_pages(spark.createDataFrame(rows[:90], ITEMS), pages, 10)
    deaths = [("documents", 0), ("indexes", 0), ("cursor", 0), None, ("cursor", 1), None, ("indexes", 2), None, None]

    for k, death in enumerate(deaths):
        def before(step, batch, death=death):
            if (step, batch) == death:
                raise RuntimeError("killed")

        run = start(spark, pages, folder, 1 if k < 6 else 0, before=before)
        if death:
            with pytest.raises(Exception, match="killed"):
                run.awaitTermination()
            assert commit.committed(spark, folder) == list(range(death[1]))
        else:
            run.awaitTermination()
    start(spark, pages, whole, 0).awaitTermination()
    assert saved_rows(spark, folder) == saved_rows(spark, whole)
    docs = saved_rows(spark, folder)[0]
    assert Counter((d, i, s) for d, i, s, _, _ in docs) == Counter((r[0], r[1], r[3]) for r in rows[:90] if r[1] is not None)
    # New pages of the same drives, after the ones that are there.
    for drive in range(3):
        late = [(*r[:3], 1000 + r[3], *r[4:]) for r in rows[90:] if r[0] == drive]
        last = len(list((tmp_path / f"pages/drive_id={drive}").glob("page=*"))) - 1
        x = spark.createDataFrame(late, ITEMS).drop("drive_id")
        x.write.parquet(f"{pages}/drive_id={drive}/page={last + 1}")
    start(spark, pages, folder, 0).awaitTermination()
    more = saved_rows(spark, folder)[0] - docs
    assert Counter((d, i, s) for d, i, s, _, _ in more) == Counter((r[0], r[1], 1000 + r[3]) for r in rows[90:] if r[1] is not None)


def test_pages_that_share_folders(spark, tmp_path):
    """The same rows, links and epochs as from a folder for each page, by few tasks; a batch may end amid a folder, and pages come in later."""
    rows, one, few = made(600, seed=9), f"file://{tmp_path}/one", f"file://{tmp_path}/few"
    items = spark.createDataFrame(rows, ITEMS)
    delta_feed.write_pages(items, one, 10)
    delta_feed.write_pages(items, few, 10, 8)
    saved = {"1": delta_feed.link(1, 3), "2": "/drives/2/root/delta?page=1"}
    for k, per_batch in enumerate((0, 5, 8)):
        for name, pages in (("one", one), ("few", few)):
            start(spark, pages, f"file://{tmp_path}/{name}-{k}", per_batch, saved).awaitTermination()
        assert saved_rows(spark, f"file://{tmp_path}/few-{k}") == saved_rows(spark, f"file://{tmp_path}/one-{k}")
    reader = delta_feed.DeltaFeedReader({"path": few})
    end = reader.latestOffset()
    assert end == delta_feed.DeltaFeedReader({"path": one}).latestOffset()
    parts, pages = reader.partitions(reader.initialOffset(), end), len(list((tmp_path / "one").glob("drive_id=*/page=*")))
    assert pages == sum(p.last - p.page + 1 for p in parts) and len(parts) <= pages / 8 + 3
    (tmp_path / "few/drive_id=0" / f"page={delta_feed.page_of(end['links']['0'])}").mkdir()
    late = [(p.drive, p.page, p.last) for p in reader.partitions(end, reader.latestOffset())]
    assert late == [("0", delta_feed.page_of(end["links"]["0"]), delta_feed.page_of(end["links"]["0"]))]


def test_links_that_are_stale_or_saved(tmp_path):
    for drive, n in (("0", 3), ("1", 2), ("10", 1)):
        for page in range(n):
            (tmp_path / f"drive_id={drive}" / f"page={page}").mkdir(parents=True)
    reader = delta_feed.DeltaFeedReader({"path": f"file://{tmp_path}", "pages_per_batch": "2", "links": '{"0": "%s", "1": "/drives/1/delta?page=2"}' % delta_feed.link(0, 1)})
    begin = reader.initialOffset()
    end = reader.latestOffset()
    assert reader.latestOffset() == end == {"links": {"0": delta_feed.link(0, 3), "1": delta_feed.link(1, 2), "10": delta_feed.link(10, 1)}, "epoch": 1}
    assert [(p.drive, p.page, p.epoch) for p in reader.partitions(begin, end)] == [("0", 1, 1), ("0", 2, 1), ("1", 0, 1), ("1", 1, 1), ("10", 0, 1)]
    assert reader.latestOffset() == end and reader.partitions(end, end) == []
    again = delta_feed.DeltaFeedReader({"path": f"file://{tmp_path}", "pages_per_batch": "1"})
    assert again.partitions(end, end) == [] and again.latestOffset() == end
    assert delta_feed.DeltaFeedReader({"path": f"file://{tmp_path}/none"}).latestOffset() == {"links": {}, "epoch": 0}


def loop(rows, epoch_of):
    """Changes by the reference rule, item by item, with resets."""
    state, out = {}, Counter()
    for drive, item, ts, seq, kind, deleted, path, name, etag in sorted(rows, key=lambda r: (r[2], r[3])):
        s = state.setdefault((drive, item), {"kind": None, "p": None, "n": None, "e": None, "epoch": epoch_of(ts)})
        if epoch_of(ts) > s["epoch"]:
            if s["kind"] == "file":
                s.update(p=None, n=None, e=None)
            s["epoch"] = epoch_of(ts)
        if ((s["kind"] or kind) if deleted and kind == "file" else kind) != "file":
            if not deleted:
                s["kind"] = kind
            continue
        if deleted:
            out[drive, item, seq, "deleted"] += 1
            continue
        pp, pn, pe, e = s["p"] or None, s["n"] or None, s["e"], etag or None
        if (pp, pn, pe) == (None, None, None):
            change = "created"
        elif e is None or pe is None or e != pe:
            change = "updated"
        else:
            moved, renamed = pp is not None and pp != path, pn is not None and pn != name
            change = "moved_and_renamed" if moved and renamed else "moved" if moved else "renamed" if renamed else None
        if change:
            out[drive, item, seq, change] += 1
            s.update(p=path, n=name, e=e or s["e"], kind="file")
    return out


def test_tracker_with_resets_over_batches_and_a_restart(spark, tmp_path):
    rows = [r for r in made(500, seed=4) if r[1] is not None]
    schema = spark.createDataFrame([], ITEMS).schema
    source = f"file://{tmp_path}/in"
    for k in range(3):
        part = rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3]
        spark.createDataFrame(part, ITEMS).coalesce(1).write.mode("append").parquet(source)
        stream = tracking.weekly_epochs(spark.readStream.schema(schema).parquet(source))
        out = tracking.run_available(spark, tracking.tracked_changes(stream), f"file://{tmp_path}/run")
    got = Counter((r.drive_id, r.item_id, r.seq, r.change_type) for r in out.collect())
    assert got == loop(rows, lambda ts: (ts - dt.datetime(2024, 1, 1)).days // 7)
    assert got != loop(rows, lambda ts: 0)


def test_object_store(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    data = [(f"m/{i % 5}/{i}.json", bytes([i % 256]) * i) for i in range(300)] + [("m/5", b"file"), ("top", b""), ("n/x y/é.json", b"z")]
    object_store.put(spark.createDataFrame(data, "key string, body binary").repartition(3), root)
    object_store.put(spark.createDataFrame([("m/1/1.json", b"new"), ("m/1/new", None)], "key string, body binary"), root)
    there = dict(data) | {"m/1/1.json": b"new", "m/1/new": b""}
    (tmp_path / "store/m/1/.half").write_bytes(b"not an object")
    read = lambda x: {r.key: bytes(r.body) for r in x.collect()}
    store = lambda *narrow: object_store.objects(spark, root, *narrow)
    assert read(store()) == there
    for prefix in ("m/3/", "m/3/1", "m/5", "m/9/x", "m", "n/", ""):
        assert read(store(prefix)) == {k: v for k, v in there.items() if k.startswith(prefix)}, prefix
    assert read(store("", ["n/x y/é.json"])) == {"n/x y/é.json": b"z"}
    assert read(store("t", ["top", "gone", "../x", "m/1/1.json"])) == {"top": b""} and read(store("", [])) == {}
    # Frames that are narrowed differently don't disturb each other in one plan.
    a, b, whole = store("m/3/"), store("m/4/"), store()
    assert a.union(b).union(whole).count() == sum(k.startswith(("m/3/", "m/4/")) for k in there) + len(there) and a.count() < whole.count()
    assert {(r.key, r.size, r.body) for r in object_store.objects(spark, root, "n", bodies=False).collect()} == {("n/x y/é.json", 1, None)}
    got = {r.k: r.body for r in object_store.get(spark.createDataFrame([("top",), ("gone",), ("../store/top",), (None,), ("m/0/5.json",)], "k string"), root, "k").collect()}
    assert got == {"top": b"", "gone": None, "../store/top": None, None: None, "m/0/5.json": b"\x05" * 5}
    for bad in ("../x", "/x", "a//b", "a/.b", ""):
        with pytest.raises(Exception, match="not a key"):
            object_store.put(spark.createDataFrame([(bad, b"")], "key string, body binary"), root)
    assert read(object_store.objects(spark, f"file://{tmp_path}/nowhere")) == {}


def test_only_folders_of_a_prefix_are_listed(tmp_path):
    for key in ("a/1/x", "a/2/y", "b/1/z"):
        (tmp_path / key).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / key).write_bytes(b"")
    listed = lambda **options: object_store.ObjectStoreReader({"path": f"file://{tmp_path}", **options}).partitions()
    assert listed() == [object_store.Listed(folders=("a", "b"))]
    assert listed(prefix="a/2") == [object_store.Listed(folders=("a/2",))]
    assert listed(prefix="c/") == [object_store.Listed()]
    assert listed(keys='["a/1/x", "b/1/z"]', prefix="a") == [object_store.Listed(keys=("a/1/x",))]
