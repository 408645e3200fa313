"""Places over range partitions, locale order, distinct names, documents, bodies, statistics in one aggregate."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import bodies, documents, messages, names, ordering, stats


def test_places_and_sums_without_gathering_a_group(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with rows enough for several partitions
    dice = random.Random(2)
    rows = [(dice.choice([None, "hot", "hot", "hot", "a", "b"]), i, dice.randrange(-3, 9)) for i in range(4000)]
    dice.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(7)
    got = {(r.g, r.o): (r.place, r.total) for r in ordering.running(ordering.numbered(df, ["g"], [F.col("o")]), ["g"], [F.col("o")], {"total": "v"}).collect()}
    want, count, total = {}, {}, {}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        count[g], total[g] = count.get(g, 0) + 1, total.get(g, 0) + v
        want[g, o] = (count[g], total[g])
    assert got == want
    spread = ordering.spread(df, [F.col("g"), F.col("o")])
    assert spread.where("g = 'hot'").select("_part").distinct().count() > 1  # the hot group is in several tasks
    assert ordering.numbered(df.limit(0), ["g"], [F.col("o")]).count() == 0
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_locale_order_in_a_listing(spark):
    words = ["z", "Z", "é", "e", "E", "É", "f", "a-b", "ab", "_", "1", "", "é"]
    rows = ordering.listing(spark.createDataFrame([(w, i) for i, w in enumerate(words)], "w string, i long"), [ordering.locale_key(F.col("w")), F.col("i")]).collect()
    assert [r.w for r in sorted(rows, key=lambda r: r.place)] == ["", "_", "1", "a-b", "ab", "e", "E", "é", "é", "É", "f", "z", "Z"]


def test_first_of_each(spark):
    rows = [("a", i) for i in range(25)] + [("b", 3), (None, 1)]
    x = ordering.first_of_each(spark.createDataFrame(rows, "g string, i long"), ["g"], F.col("i"), F.col("i") * 2, 10)
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert {r.g: (list(r.first), r["size"]) for r in x.collect() if r.g} == {"a": ([2 * i for i in range(10)], 25), "b": ([6], 1)}


def loop(rows):
    used, out = set(), {}
    for f, o, n in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        name, dot = n, n.rfind(".")
        base, end = (n[:dot], n[dot:]) if dot > 0 else (n, "")
        k = 0
        while (f, name) in used:
            k += 1
            name = f"{base}_{k}{end}"
        used.add((f, name))
        out[f, o] = name
    return out


POOL = ["a", "a.x", "a_1.x", "a_2.x", "a_1_1.x", "a_1", "a_2", "a_1_1", "a_1_2", "a_01", "a_0", ".x", ".x_1", "", "_1", "b_3.y", "b.y", "b_1.y", "b_2.y", "b_4.y", "b_1_1.y", "b_1_1_1.y", "a.\n", "a_1.\n", "c_99999999999999999999"]


def test_names_as_a_loop_gives_them(spark):
    dice = random.Random(1)
    rows = [(f, o, dice.choice(POOL)) for f in range(8) for o in range(dice.choice([5, 40, 90]))]
    df = spark.createDataFrame(rows, "folder_id long, ordinal long, name string").repartition(5)
    got = {(r.folder_id, r.ordinal): r.file_name for r in names.distinct_names(df).collect()}
    assert got == loop(rows)
    assert messages.archive_names(df.limit(0)).count() == 0


def test_a_million_equal_names_with_clashes(spark):
    """No folder and no family of names is gathered; numbers that others hold are passed over."""
    n = 1_000_000
    i = F.col("id")
    clash = F.when(i % 1000 == 500, F.concat(F.lit("same_"), (F.floor(i / 7) + 1).cast("string"), F.lit(".eml"))).otherwise("same.eml")
    df = spark.range(n).select(F.lit(1).cast("long").alias("folder_id"), i.alias("ordinal"), clash.alias("name"))
    out = names.distinct_names(df)
    rows = [(1, k, f"same_{k // 7 + 1}.eml" if k % 1000 == 500 else "same.eml") for k in range(n)]
    used, free, want = set(), 1, []
    for _, k, name in rows:  # the loop, with the place from which numbers can be free
        if name != "same.eml" and name not in used:
            used.add(name)
            want.append(name)
            continue
        if name != "same.eml":
            base, at = name[:-4], 1
            while f"{base}_{at}.eml" in used:
                at += 1
            used.add(f"{base}_{at}.eml")
            want.append(f"{base}_{at}.eml")
            continue
        if name not in used:
            used.add(name)
            want.append(name)
            continue
        while f"same_{free}.eml" in used:
            free += 1
        used.add(f"same_{free}.eml")
        want.append(f"same_{free}.eml")
    digest = hashlib.md5("\n".join(want).encode()).hexdigest()
    got = out.orderBy("ordinal").select("file_name").toPandas()["file_name"]
    assert len(got) == n and hashlib.md5("\n".join(got).encode()).hexdigest() == digest


CHANGES = "drive_id long, item_id long, ts timestamp_ntz, seq long, path string, name string, etag string, size_bytes long, storage_key string, checksum string, change_type string"


def test_documents_of_deleted_and_other_entries(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, 7, at, 0, "/a", "f", "e", 10, "k", "c", "created"), (1, 7, at, 1, "/a", "f", None, 4, "k", "c", "deleted")]
    changes = spark.createDataFrame(rows, CHANGES)
    import json

    docs = {r.seq: json.loads(r.document) for r in documents.entry_documents(changes, ["seq"]).collect()}
    assert docs[0] == {"file_id": "7", "drive_id": "1", "file_name": "f", "parent_path": "/a", "size_bytes": 10, "storage_key": "k", "checksum": "c", "change_type": "created", "etag": "e"}
    assert docs[1] == {"file_id": "7", "drive_id": "1", "file_name": "f", "parent_path": "/a", "size_bytes": 4, "change_type": "deleted"}
    whole = json.loads(documents.snapshot_documents(changes, ["drive_id"]).first().document)
    assert (whole["total_files"], whole["total_size_bytes"], [e["change_type"] for e in whole["entries"]]) == (2, 14, ["created", "deleted"])
    bad = documents.as_variant(spark.createDataFrame([("{",), (None,), ("[1]",)], "document string"))
    assert [documents.field(F.col("document"), "$.x").isNull() for _ in [0]] and [r[0] for r in bad.select(documents.field(F.col("document"), "$.x")).collect()] == [None, None, None]


@pytest.mark.parametrize("text,state,links", [(None, "none", {}), ("", "corrupt", {}), ("{", "corrupt", {}), ('{"delta_link_by_drive": 3}', "corrupt", {}), ('{"delta_link_by_drive": {"a": "b"}, "more": 1}', "loaded", {"a": "b"}), ("{}", "loaded", {}), ("[]", "corrupt", {})])
def test_corrupt_documents_count_as_none(spark, text, state, links):
    r = documents.saved_links(spark.createDataFrame([(1, text)], "owner_id long, document string"), "owner_id").first()
    assert (r.state, r.links) == (state, links)


def test_bodies_are_hashed_in_order(spark):
    data = [(i, bytes([i % 251]) * (i * 37 % 900)) for i in range(60)] + [(100, None), (101, b"")]
    x = bodies.chunks(spark.createDataFrame(data, "body_id long, body binary"), 64).orderBy(F.rand(3)).repartition(9)
    got = {r.body_id: (r.sha256, r.size_bytes, r.chunks) for r in bodies.chunked_sha256(x).collect()}
    assert got == {i: (hashlib.sha256(b or b"").hexdigest(), len(b or b""), max(1, -(-len(b or b"") // 64))) for i, b in data}


def test_mailbox_statistics_take_one_shuffle(spark):
    heads = spark.createDataFrame([(1, 1, dt.datetime(2024, 1, 5)), (1, 2, dt.datetime(2024, 2, 5)), (2, 3, dt.datetime(2024, 1, 7))], "owner_id long, snapshot_id long, created_at timestamp_ntz")
    entries = spark.createDataFrame([(1, dt.datetime(2024, 1, 5), "x", 10, 1, 5), (1, dt.datetime(2024, 1, 5), None, 20, 0, 0), (1, dt.datetime(2024, 2, 5), "x", 1, 2, 2)], "owner_id long, created_at timestamp_ntz, folder_id string, size_bytes long, att_count long, att_bytes long")
    x = stats.mailbox(heads, entries)
    assert x._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r.grain, r.owner_id, r.name): (r.snapshots, r.messages, r.size_bytes, r.attachments, r.attachment_bytes) for r in x.collect()}
    assert got == {
        ("owner", 1, None): (2, 3, 38, 3, 7), ("owner", 2, None): (1, 0, 0, 0, 0), ("folder", 1, "x"): (None, 2, 18, 3, 7), ("folder", 1, "unknown"): (None, 1, 20, 0, 0),
        ("month", 1, "2024-01"): (1, 2, 35, 1, 5), ("month", 1, "2024-02"): (1, 1, 3, 2, 2), ("month", 2, "2024-01"): (1, 0, 0, 0, 0),
    }
