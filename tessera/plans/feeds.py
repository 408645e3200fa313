"""Queries of feeds, stores, documents and listings, with DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import bodies, cdc, documents, identity, ordering, stats
from tessera.plans.registry import _CHG, _ENT, _IDENT, _ITEMS, _SNAP, _identities, query
from tessera.session import cut, shared_dir
from tessera.sources import adapters, delta_feed
from tessera.streaming import cdc_stream, commit, tracking


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of a page of the feeds that the queries write, and pages of a folder.
PAGE, SHARED = 400, 256
#: Links of a saved cursor: one drive goes on with its second page, one has a link that doesn't name its columns.
SAVED = {"2": delta_feed.link(2, 1), "5": "/drives/5/root/delta?page=1"}


def _committed_feed(spark, sf):
    """A feed written from events, taken as a stream in three parts, with a stop and a new start between them; gives the folder of what it saved."""
    pages, out = _folder(spark, "feed-pages"), _folder(spark, "feed-saved")
    items = adapters.delta_items(spark, sf).withColumn("item_id", F.when(F.col("seq") % 101 != 7, F.col("item_id")))
    delta_feed.write_pages(items, pages, PAGE, SHARED)
    most = spark.read.parquet(pages).agg(F.max("page")).first()[0]
    per_batch = ((0 if most is None else most) + 3) // 3
    while True:
        stream = delta_feed.read_feed(spark, pages, per_batch, SAVED)
        before = len(commit.committed(spark, out))
        run = stream.writeStream.foreachBatch(commit.OrderedCommit(out, commit.feed_tables())).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
        if len(commit.committed(spark, out)) == before:
            return out


_PAGES = f"""{_ITEMS}, paged AS (SELECT *, (row_number() OVER (PARTITION BY drive_id ORDER BY ts, seq) - 1) // {PAGE} AS page FROM items),
fed AS (SELECT * FROM paged WHERE seq % 101 <> 7 AND (drive_id <> 2 OR page >= 1))"""


@query(f"WITH {_PAGES} SELECT drive_id, item_id, seq, page, CAST(1 AS BIGINT) AS epoch FROM fed")
def delta_feed_resumed(spark, sf):
    """Items that a stream over a feed saved, over several starts: none lost, none twice; a stale link reads its drive anew."""
    return commit.saved(spark, _committed_feed(spark, sf), "documents", "drive_id bigint, item_id bigint, seq bigint, page bigint, epoch bigint").drop("batch")


@query(f"""WITH {_PAGES}, files AS (SELECT * FROM fed WHERE kind = 'file' AND NOT deleted)
SELECT drive_id, '/drives/' || drive_id || '/root/delta?$select={delta_feed.SELECT}&page=' || (max(page) + 1) AS delta_link, count(DISTINCT CASE WHEN kind = 'file' AND NOT deleted THEN item_id END) AS files, count(*) FILTER (kind = 'file' AND NOT deleted) AS versions, max(CASE WHEN kind = 'file' AND NOT deleted THEN seq END) AS last_seq FROM fed GROUP BY 1""")
def delta_feed_cursor(spark, sf):
    """The cursor and the version indexes that were saved with the items, merged over batches."""
    out = _committed_feed(spark, sf)
    index = commit.saved(spark, out, "indexes", "drive_id bigint, item_id bigint, versions bigint, last_seq bigint")
    index = index.groupBy("drive_id").agg(F.count_distinct("item_id").alias("files"), F.sum("versions").alias("versions"), F.max("last_seq").alias("last_seq"))
    cursor = commit.latest(commit.saved(spark, out, "cursor", "drive_id bigint, delta_link string"), "drive_id")
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return cursor.join(index, "drive_id", "left").select("drive_id", "delta_link", n("files"), n("versions"), "last_seq")


_EPOCHS = f"""{_ITEMS}, ep AS (SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 AS epoch FROM items WHERE kind = 'file'),
prev AS (SELECT *, last_value(CASE WHEN NOT deleted THEN path END IGNORE NULLS) OVER w AS pp, last_value(CASE WHEN NOT deleted THEN name END IGNORE NULLS) OVER w AS pn, last_value(CASE WHEN NOT deleted THEN etag END IGNORE NULLS) OVER w AS pe
 FROM ep WINDOW w AS (PARTITION BY drive_id, item_id, epoch ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chg AS (SELECT * FROM (SELECT *, CASE WHEN deleted THEN 'deleted' WHEN pp IS NULL AND pn IS NULL AND pe IS NULL THEN 'created' WHEN pe IS NULL OR etag IS NULL OR pe <> etag THEN 'updated'
 WHEN pp <> path AND pn <> name THEN 'moved_and_renamed' WHEN pp <> path THEN 'moved' WHEN pn <> name THEN 'renamed' END AS change_type FROM prev) WHERE change_type IS NOT NULL)"""


@query(f"WITH {_EPOCHS} SELECT drive_id, item_id, seq, change_type FROM chg")
def stream_resets(spark, sf):
    """Changes of a stream whose feed is reset each week: files start anew."""
    events = cdc_stream.table_stream(spark, f"{sf}/events.parquet")
    return tracking.run_available(spark, tracking.tracked_changes(tracking.weekly_epochs(adapters.delta_columns(events))), _folder(spark, "resets"))


@query(f"WITH {_EPOCHS} SELECT drive_id, epoch, change_type, count(*) AS n FROM chg GROUP BY ALL")
def batch_resets(spark, sf):
    """The same in batch: the previous state is that of the same epoch."""
    items = tracking.weekly_epochs(adapters.delta_items(spark, sf))
    return cdc.changes(items, ["epoch"]).groupBy("drive_id", "epoch", "change_type").agg(F.count(F.lit(1)).alias("n"))


_DOCS = f"""{_CHG}, docs AS (SELECT *, seq % 1000 AS size_bytes, CASE WHEN change_type <> 'deleted' THEN 'data/' || item_id || '/' || coalesce(etag, 'none') END AS storage_key, CASE WHEN change_type <> 'deleted' THEN md5(path || name) END AS checksum, CASE WHEN seq % 3 = 0 THEN 'https://x/' || seq END AS web_url FROM chg)"""


def _changes(spark, sf):
    """Changes with sizes, keys and one more optional field."""
    x = cdc.changes(adapters.delta_items(spark, sf)).withColumn("size_bytes", F.col("seq") % 1000)
    key = F.concat_ws("/", F.lit("data"), F.col("item_id").cast("string"), F.coalesce("etag", F.lit("none")))
    return x.withColumn("storage_key", key).withColumn("checksum", F.md5(F.concat("path", "name").cast("binary"))).withColumn("web_url", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("https://x/"), F.col("seq").cast("string"))))


@query(f"WITH {_DOCS} SELECT drive_id, seq, CAST(item_id AS VARCHAR) AS file_id, change_type, size_bytes, storage_key, checksum, etag, web_url FROM docs")
def drive_entry_documents(spark, sf):
    """Entries of both kinds, written as documents, kept as variants in a table, and read back field by field."""
    kept = cut(documents.as_variant(documents.entry_documents(_changes(spark, sf), ["drive_id", "seq"])), "entry-documents")
    d = F.col("document")
    text = lambda f: documents.field(d, f"$.{f}").alias(f)
    return kept.select("drive_id", "seq", text("file_id"), text("change_type"), documents.field(d, "$.size_bytes", "bigint").alias("size_bytes"), *map(text, ("storage_key", "checksum", "etag", "web_url")))


@query(f"""WITH {_DOCS}, f AS (SELECT change_type = 'deleted' AS gone, unnest(list_filter(['file_id', 'drive_id', 'file_name', 'parent_path', 'size_bytes', 'change_type', CASE WHEN storage_key IS NOT NULL THEN 'storage_key' END, CASE WHEN checksum IS NOT NULL THEN 'checksum' END, CASE WHEN web_url IS NOT NULL THEN 'web_url' END, CASE WHEN etag IS NOT NULL THEN 'etag' END], lambda x: x IS NOT NULL)) AS field FROM docs)
SELECT gone, field, count(*) AS n FROM f GROUP BY ALL""")
def drive_document_fields(spark, sf):
    """How many documents of deleted and of other entries have each field."""
    docs = documents.as_variant(documents.entry_documents(_changes(spark, sf), ["change_type"]))
    x = documents.field_names(docs, ["change_type"])
    return x.groupBy((F.col("change_type") == "deleted").alias("gone"), "field").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_DOCS} SELECT drive_id, CAST(ts AS DATE) AS day, count(*) AS total_files, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes, count(*) FILTER (change_type = 'deleted') AS without_key, arg_min(CAST(item_id AS VARCHAR), (ts, seq)) AS first_file FROM docs GROUP BY 1, 2")
def drive_snapshot_documents(spark, sf):
    """Totals of each drive's daily snapshot documents: deleted entries count, with their sizes."""
    docs = documents.as_variant(documents.snapshot_documents(_changes(spark, sf).withColumn("day", F.col("ts").cast("date")), ["drive_id", "day"]))
    d = F.col("document")
    entries = documents.field(d, "$.entries", "array<variant>")
    gone = F.size(F.filter(entries, lambda e: documents.field(e, "$.storage_key").isNull())).cast("long")
    number = lambda f: documents.field(d, f"$.{f}", "bigint").alias(f)
    return docs.select("drive_id", "day", number("total_files"), number("total_size_bytes"), gone.alias("without_key"), documents.field(d, "$.entries[0].file_id").alias("first_file"))


_CURSORS = """c AS (SELECT c_custkey AS owner_id, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '{"owner_id":' WHEN 2 THEN '{"owner_id":"x","delta_link_by_drive":[1]}' WHEN 3 THEN '' ELSE 'ok' END AS document, c_nationkey FROM customer)"""


def _cursor_documents(spark, sf):
    c = F.col("c_custkey")
    good = F.to_json(F.struct(c.cast("string").alias("owner_id"), F.create_map(F.lit("a"), F.lit("l1"), F.lit("b"), F.concat(F.lit("l"), c.cast("string"))).alias("delta_link_by_drive")))
    text = F.when(c % 7 == 0, F.lit(None)).when(c % 7 == 1, F.lit('{"owner_id":')).when(c % 7 == 2, F.lit('{"owner_id":"x","delta_link_by_drive":[1]}')).when(c % 7 == 3, F.lit("")).otherwise(good)
    return adapters.table(spark, sf, "customer").select(c.alias("owner_id"), "c_nationkey", text.alias("document"))


@query(f"WITH {_CURSORS} SELECT owner_id, CASE WHEN document IS NULL THEN 'none' WHEN document = 'ok' THEN 'loaded' ELSE 'corrupt' END AS state, CASE WHEN document = 'ok' THEN 2 ELSE 0 END AS links, CASE WHEN document = 'ok' THEN 'l' || owner_id END AS last_link FROM c")
def cursor_load(spark, sf):
    """Saved links of each owner; a cursor that is missing or can't be parsed gives none."""
    x = documents.saved_links(_cursor_documents(spark, sf), "owner_id")
    return x.select("owner_id", "state", F.size("links").alias("links"), F.try_element_at("links", F.lit("b")).alias("last_link"))


@query(f"WITH {_CURSORS} SELECT c_nationkey AS nation, count(*) FILTER (document = 'ok') AS good, count(*) FILTER (document <> 'ok') AS bad, count(*) FILTER (document IS NULL) AS missing FROM c GROUP BY 1")
def corrupt_documents(spark, sf):
    """Good, corrupt and missing documents by nation."""
    x = documents.parsed(_cursor_documents(spark, sf), documents.CURSOR)
    return x.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count_if(F.col("parsed").isNotNull()).alias("good"), F.count_if(F.col("corrupt").isNotNull()).alias("bad"), F.count_if(F.col("document").isNull()).alias("missing"))


@query("WITH r AS (SELECT c_nationkey AS tenant, c_nationkey % 5 = 2 AS bad, c_custkey FROM customer) SELECT tenant, CAST(c_custkey AS VARCHAR) AS object_id, 'user' || c_custkey || '@x.org' AS email, CASE WHEN c_custkey % 3 = 0 THEN 'recycled' ELSE 'active' END AS status FROM r WHERE NOT bad")
def registry_load(spark, sf):
    """Identities of each tenant's registry document; a corrupt one counts as none."""
    c = F.col("c_custkey")
    one = F.struct(c.cast("string").alias("object_id"), F.concat(F.lit("user"), c.cast("string"), F.lit("@x.org")).alias("email"), F.when(c % 3 == 0, "recycled").otherwise("active").alias("status"))
    grouped = adapters.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("tenant")).agg(F.collect_list(one).alias("identities"))
    text = F.to_json(F.struct(F.lit(1).alias("version"), "identities"))
    return documents.registry_rows(grouped.select("tenant", F.when(F.col("tenant") % 5 == 2, F.substring(text, 2, 10_000_000)).otherwise(text).alias("document")), "tenant")


_WORD = r"regexp_extract(text, '[^\x20\x09-\x0D]+', 0)"


@query(rf"WITH w AS (SELECT {_WORD} AS word, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT word, n, row_number() OVER (ORDER BY icu_sort_key(word, 'und'), word) AS place FROM w WHERE word <> ''")
def locale_listing(spark, sf):
    """The first words of all documents in the order of a locale, with cases and accents after letters, and their places in it."""
    word = F.regexp_extract("text", r"[^\x20\x09-\x0D]+", 0)
    x = adapters.table(spark, sf, "documents").where("text is not null").groupBy(word.alias("word")).agg(F.count(F.lit(1)).alias("n")).where("word <> ''")
    return ordering.listing(x, [ordering.locale_key(F.col("word")), F.col("word")])


@query(f"WITH {_SNAP}, s AS (SELECT owner_id, count(*) AS snapshots FROM snap GROUP BY 1), n AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'É' WHEN c_custkey % 4 = 1 THEN 'e' WHEN c_custkey % 4 = 2 THEN 'E' ELSE 'f' END || c_custkey AS name FROM customer) SELECT owner_id, name, snapshots, row_number() OVER (ORDER BY icu_sort_key(name, 'und'), owner_id) AS place FROM s JOIN n ON c_custkey = owner_id")
def catalog_owner_listing(spark, sf):
    """Owners with snapshots, listed by their names in the order of a locale."""
    c = F.col("c_custkey")
    names = adapters.table(spark, sf, "customer").select(c.alias("owner_id"), F.concat(F.when(c % 4 == 0, "É").when(c % 4 == 1, "e").when(c % 4 == 2, "E").otherwise("f"), c.cast("string")).alias("name"))
    x = adapters.heads(spark, sf).groupBy("owner_id").agg(F.count(F.lit(1)).alias("snapshots")).join(names, "owner_id")
    return ordering.listing(x, [ordering.locale_key(F.col("name")), F.col("owner_id")]).select("owner_id", "name", "snapshots", "place")


@query(f"WITH {_IDENT}, r AS (SELECT *, CASE WHEN lead(object_id) OVER (PARTITION BY email ORDER BY seq) IS NULL THEN 'active' ELSE 'recycled' END AS status FROM ident) SELECT email, object_id, status, row_number() OVER (ORDER BY status, icu_sort_key(email, 'und'), seq) AS place FROM r")
def identity_listing(spark, sf):
    """All identities as they are listed: active ones first, then by address in the order of a locale."""
    x = identity.registry(_identities(spark, sf))
    return ordering.listing(x, [F.col("status"), ordering.locale_key(F.col("email")), F.col("seq")]).select("email", "object_id", "status", "place")


@query(f"""WITH {_ENT}, {_SNAP}, e AS (SELECT owner_id, strftime(created_at, '%Y-%m') AS month, coalesce(folder_id, 'unknown') AS folder, 0 AS snapshot, 1 AS entry, size_bytes + att_bytes AS size_bytes, att, att_bytes FROM ent JOIN snap USING (snapshot_id) UNION ALL SELECT owner_id, strftime(created_at, '%Y-%m'), NULL, 1, 0, 0, 0, 0 FROM snap),
m AS (SELECT owner_id, sum(snapshot) AS s, sum(entry) AS n, sum(size_bytes) AS b, sum(att) AS a, sum(att_bytes) AS ab FROM e GROUP BY 1), f AS (SELECT owner_id, folder, sum(entry) AS n, sum(size_bytes) AS b, sum(att) AS a, sum(att_bytes) AS ab FROM e WHERE folder IS NOT NULL GROUP BY 1, 2), t AS (SELECT owner_id, month, sum(snapshot) AS s, sum(entry) AS n, sum(size_bytes) AS b, sum(att) AS a, sum(att_bytes) AS ab FROM e GROUP BY 1, 2)
SELECT grain, owner_id, name, CAST(s AS BIGINT) AS snapshots, CAST(n AS BIGINT) AS messages, CAST(b AS BIGINT) AS size_bytes, CAST(a AS BIGINT) AS attachments, CAST(ab AS BIGINT) AS attachment_bytes
FROM (SELECT 'owner' AS grain, owner_id, NULL AS name, s, n, b, a, ab FROM m UNION ALL SELECT 'folder', owner_id, folder, NULL, n, b, a, ab FROM f UNION ALL SELECT 'month', owner_id, month, s, n, b, a, ab FROM t)""")
def stats_mailbox(spark, sf):
    """Each owner's statistics, its folders' and its months', with all measures."""
    return stats.mailbox(adapters.heads(spark, sf), adapters.flat_entries(spark, sf))


@query("""WITH b AS (SELECT doc_id AS body_id, coalesce(text, '') AS t, coalesce(lang, 'none') AS owner FROM documents), h AS (SELECT *, 'data/' || owner || '/' || sha256(t) AS storage_key FROM b)
SELECT body_id, owner, sha256(t) AS sha256, CAST(octet_length(encode(t)) AS BIGINT) AS size_bytes, CAST(greatest(ceil(octet_length(encode(t)) / 64), 1) AS BIGINT) AS chunks, CASE WHEN body_id = min(body_id) OVER (PARTITION BY storage_key) AND storage_key NOT IN (SELECT storage_key FROM h WHERE body_id % 10 = 3) THEN 'stored' ELSE 'deduplicated' END AS outcome FROM h""")
def chunked_bodies(spark, sf):
    """Bodies in chunks of 64 bytes, hashed in order as they stream by; every tenth body's key is in the store before."""
    docs = adapters.table(spark, sf, "documents").select(F.col("doc_id").alias("body_id"), F.coalesce("text", F.lit("")).cast("binary").alias("body"), F.coalesce("lang", F.lit("none")).alias("owner"))
    hashed = bodies.chunked_sha256(bodies.chunks(docs, 64)).join(docs.select("body_id", "owner"), "body_id")
    stored = docs.where("body_id % 10 = 3").select(F.concat_ws("/", F.lit("data"), "owner", F.sha2("body", 256)).alias("storage_key"))
    return bodies.store_outcomes(hashed, F.col("owner"), stored).drop("storage_key")


@query("WITH e AS (SELECT c_nationkey AS nation, list('error ' || c_custkey ORDER BY c_custkey) AS errors FROM customer GROUP BY 1) SELECT nation, array_to_string(errors[1:10], ';') AS first, CASE WHEN len(errors) > 10 THEN '... and ' || (len(errors) - 10) || ' more' END AS more FROM e")
def error_lists(spark, sf):
    """The first ten errors of each nation and how many more there are; a task sends ten of a nation at most."""
    key = F.col("c_custkey")
    x = ordering.first_of_each(adapters.table(spark, sf, "customer").withColumnRenamed("c_nationkey", "nation"), ["nation"], key, F.concat(F.lit("error "), key.cast("string")), 10)
    more = F.when(F.col("size") > 10, F.concat(F.lit("... and "), (F.col("size") - 10).cast("string"), F.lit(" more")))
    return x.select("nation", F.array_join("first", ";").alias("first"), more.alias("more"))


@query(f"WITH {_CHG} SELECT drive_id, change_type, count(*) AS n FROM chg GROUP BY 1, 2")
def stream_cdc_equals_batch(spark, sf):
    """Change classification as a stream over the given table."""
    return cdc_stream.run_available(spark, f"{sf}/events.parquet", "cdc-stream").groupBy("drive_id", "change_type").agg(F.count(F.lit(1)).alias("n"))
