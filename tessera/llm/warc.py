"""WARC fixity audit with Merkle trees.

Records of an archive file are hashed in order of their ids. Each id has a slot in its file, and a node of the tree
covers FAN slots or nodes of the level below, thus an ordered range of offsets: it hashes its level and place, and
the slot, length and hash of each child, so a child's offset in the range is hashed too, and a lost or added record
changes its own branch only. An audit compares the roots of two replicas of a file, then only the children of nodes
that differ. In slots that differ, records are matched by id and content, so that the audit says which are changed,
missing or extra.

Files hold a bounded number of ids, so trees have a fixed depth. An id that more records have than a file holds
(a null id among them) has files of its own, over which its records are dealt by their content; so a group grows with
the copies of one record only, as narrow rows. Nulls: a null text is empty, records without an id are in file -1 or such files. Repeated ids are
ordered by content and share a slot. An empty table gives no trees.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tessera.llm.common import small
from tessera.session import cut

FAN, PER_FILE = 16, 1000


def record_bytes(uri: Column, body: Column) -> Column:
    """A response record: header lines, a blank line, the body and two line ends."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html", per_file: int = PER_FILE) -> DataFrame:
    """Columns file, slot, record, id, start, length, hash: the records of archive files of per_file ids each, in order of ids.

    Ids are whole numbers; other ids are told by a hash. Bodies are hashed where they are read; only these narrow
    rows, which are written once, are sorted.
    """
    record = record_bytes(F.col(uri_col), F.col(body_col)).cast("binary")
    number = F.col(id_col) if pages.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long") else F.shiftright(F.xxhash64(id_col), 1)
    x = pages.select(F.when(F.col(id_col).isNotNull(), number).cast("long").alias("id"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("hash"))
    x = cut(x, "warc-hashes")
    often = cut(x.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > per_file).select(F.col("id").alias("often"), F.ceil(F.col("n") / per_file).alias("parts")), "warc-often")
    x = x.join(small(often, 32), F.col("id").eqNullSafe(F.col("often")) & F.col("parts").isNotNull(), "left")
    dealt = F.xxhash64("hash")
    apart = -2 - (F.pmod(F.xxhash64(F.coalesce(F.col("id"), F.lit(-1)), F.col("id").isNull()), F.lit(1 << 31)) * (1 << 20) + F.pmod(dealt, F.least(F.col("parts"), F.lit(1 << 20))))
    file = F.when(F.col("parts").isNotNull(), apart).otherwise(F.coalesce(F.floor(F.col("id") / per_file), F.lit(-1)))
    slot = F.when(F.col("parts").isNotNull() | F.col("id").isNull(), F.pmod(F.shiftright(dealt, 20), F.lit(per_file))).otherwise(F.pmod("id", F.lit(per_file)))
    x = x.select(file.cast("long").alias("file"), slot.cast("long").alias("slot"), "id", "length", "hash")
    order = Window.partitionBy("file").orderBy("slot", "id", "hash")
    start = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.select("file", "slot", (F.row_number().over(order) - 1).cast("long").alias("record"), "id", start.alias("start"), "length", "hash")


def depth(per_file: int = PER_FILE) -> int:
    """Levels above the slots, until one node covers a file."""
    n, levels = per_file, 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return max(1, levels)


def tree(records: DataFrame, levels: int | None = None) -> DataFrame:
    """Columns file, level, node, start, length, hash: the slots (level 0) and all nodes above.

    A slot of one record has its hash; one of more hashes their number and the sums of the parts of their hashes, so
    that they are never gathered. A node's children are sorted in the node; there are FAN of them at most.
    """
    levels = levels or depth()
    lanes = [F.sum(F.conv(F.substring("hash", i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(1, 64, 15)]
    one = F.when(F.count(F.lit(1)) == 1, F.min("hash")).otherwise(F.sha2(F.concat_ws(",", F.count(F.lit(1)).cast("string"), *lanes).cast("binary"), 256))
    level = records.groupBy("file", F.col("slot").alias("node")).agg(F.min("start").alias("start"), F.sum("length").alias("length"), one.alias("hash"))
    level = level.select("file", F.lit(0).alias("level"), "node", "start", "length", "hash")
    out = level
    for k in range(1, levels + 1):
        parent = F.floor(F.col("node") / FAN) if k < levels else F.lit(0).cast("long")
        children = F.transform(F.array_sort(F.collect_list(F.struct("node", "length", "hash"))), lambda c: F.concat_ws(":", c["node"].cast("string"), c["length"].cast("string"), c["hash"]))
        text = F.concat_ws("|", F.lit(str(k)), F.col("up").cast("string"), F.array_join(F.col("children"), ","))
        level = level.groupBy("file", parent.alias("up")).agg(F.min("start").alias("start"), F.sum("length").alias("length"), children.alias("children"))
        level = level.select("file", F.lit(k).alias("level"), F.col("up").alias("node"), "start", "length", F.sha2(text.cast("binary"), 256).alias("hash"))
        out = out.unionByName(level)
    return out


def differing_slots(left: DataFrame, right: DataFrame, levels: int | None = None) -> DataFrame:
    """Columns file, slot where two trees differ. Below the roots, only children of nodes that differ are read."""
    levels = levels or depth()

    def differing(level: int, within: DataFrame | None) -> DataFrame:
        sides = []
        for name, side in (("left", left), ("right", right)):
            side = side.where(F.col("level") == level)
            if within is not None:
                up = F.floor(F.col("node") / FAN) if level + 1 < levels else F.lit(0).cast("long")
                side = side.withColumn("up", up).join(within, ["file", "up"], "left_semi")
            sides.append(side.select("file", "node", F.col("hash").alias(f"hash_{name}"), F.col("length").alias(f"length_{name}")))
        both = sides[0].join(sides[1], ["file", "node"], "full")
        return both.where(~F.col("hash_left").eqNullSafe(F.col("hash_right")) | ~F.col("length_left").eqNullSafe(F.col("length_right")))

    bad = differing(levels, None)
    for level in range(levels - 1, -1, -1):
        bad = differing(level, bad.select("file", F.col("node").alias("up")))
    return bad.select("file", F.col("node").alias("slot"))


def audit(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame], levels: int | None = None) -> DataFrame:
    """Columns file, slot, id, status, start, length, hash_left, hash_right, copies of the records that differ between two replicas, each of (records, tree).

    Records of equal id and content are whole, wherever they are in the slot, as often as both replicas have them; copies
    is how many more one replica has. Of these, contents of equal id are paired in the order of their hashes as changed;
    who has no counterpart is missing (in right) or extra.
    """
    bad = cut(differing_slots(left[1], right[1], levels), "warc-differ")
    key = ["file", "slot", F.coalesce(F.col("id"), F.lit(-1)).alias("_id"), F.col("id").isNull().alias("_none")]
    sides = []
    for name, (records, _) in (("left", left), ("right", right)):
        x = records.join(bad, ["file", "slot"], "left_semi").groupBy(*key, "hash", "length").agg(F.count(F.lit(1)).alias(f"n_{name}"), F.min("start").alias(f"start_{name}"))
        sides.append(x)
    both = sides[0].join(sides[1], ["file", "slot", "_id", "_none", "hash", "length"], "full")
    rest = F.coalesce("n_left", F.lit(0)) - F.coalesce("n_right", F.lit(0))
    both = both.withColumn("rest", rest).where("rest <> 0")
    both = both.withColumn("side", F.when(F.col("rest") > 0, "left").otherwise("right"))
    both = both.withColumn("place", F.row_number().over(Window.partitionBy("file", "slot", "_id", "_none", "side").orderBy("hash")))
    take = lambda side: both.where(F.col("side") == side).select("file", "slot", "_id", "_none", "place", F.abs("rest").alias(f"copies_{side}"), F.col("hash").alias(f"hash_{side}"), F.col("length").alias(f"length_{side}"), F.col(f"start_{side}"))
    x = take("left").join(take("right"), ["file", "slot", "_id", "_none", "place"], "full")
    status = F.when(F.col("hash_right").isNull(), "missing").when(F.col("hash_left").isNull(), "extra").otherwise("changed")
    return x.select("file", "slot", F.when(~F.col("_none"), F.col("_id")).alias("id"), status.alias("status"), F.coalesce("start_left", "start_right").alias("start"), F.coalesce("length_left", "length_right").alias("length"), "hash_left", "hash_right", F.coalesce("copies_left", "copies_right").alias("copies"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or gzip, under a path: path, record, start, length, warc_type, uri, body, intact.

    Offsets are of the uncompressed file, which is inflated piece by piece. A record that is cut off, or whose length is no
    number, has intact false and the bytes there are, up to the next record; so has the last record of a gzip file that
    is cut or corrupt, where reading ends. A file is one row of Spark's binaryFile source, thus 2 GB at most as stored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for number, row in enumerate(parse(inflate(content.as_buffer()))):
                    yield pa.RecordBatch.from_pylist([{"path": name, "record": number} | row], schema=target)

    target = pa.schema([("path", pa.string()), ("record", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("warc_type", pa.string()), ("uri", pa.string()), ("body", pa.binary()), ("intact", pa.bool_())])
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, record long, start long, length long, warc_type string, uri string, body binary, intact boolean")


#: A record's first line, that of a later record, and the end of a head.
START, NEXT, BLANK = re.compile(rb"WARC/\d\.\d\r\n"), re.compile(rb"\nWARC/\d\.\d\r\n"), re.compile(rb"\r\n\r\n")
#: Bytes that are inflated at a time.
PIECE = 1 << 20


def inflate(content: memoryview | bytes) -> Iterator[bytes]:
    """The bytes of a plain or gzip file in pieces; a member that is cut or corrupt ends them."""
    view = memoryview(content)
    if bytes(view[:2]) != b"\x1f\x8b":
        for at in range(0, len(view), PIECE):
            yield bytes(view[at : at + PIECE])
        return
    at = 0
    while at < len(view):
        member = zlib.decompressobj(31)
        try:
            while not member.eof and at < len(view):
                piece = bytes(view[at : at + (PIECE >> 4)])
                at += len(piece)
                yield member.decompress(piece)
            at -= len(member.unused_data)
        except zlib.error:
            return


def parse(pieces: Iterable[bytes]) -> Iterator[dict]:
    """Records of an uncompressed WARC file that comes in pieces."""
    pieces, have, base, done = iter(pieces), bytearray(), 0, False

    def fill(n: int) -> bool:
        """Have n bytes or more, if there are so many."""
        nonlocal done
        while len(have) < n and not done:
            piece = next(pieces, None)
            if piece is None:
                done = True
            else:
                have.extend(piece)
        return len(have) >= n

    def find(mark: re.Pattern, start: int) -> int:
        """Place of a mark of 20 bytes at most, or -1 at the end of the file."""
        while not (found := mark.search(have, start)) and not done:
            start = max(start, len(have) - 20)
            fill(len(have) + 1)
        return found.start() if found else -1

    def drop(n: int) -> None:
        nonlocal base
        del have[:n]
        base += n

    while fill(1):
        fill(10)
        if not START.match(have):
            at = find(NEXT, 0)
            if at < 0:
                return
            drop(at + 1)
        end = find(BLANK, 0)
        head = {}
        for line in bytes(have if end < 0 else have[:end]).split(b"\r\n")[1:]:
            key, _, value = line.partition(b":")
            head[key.strip().lower()] = value.strip().decode("utf-8", "replace")
        said = head.get(b"content-length", "")
        start, n = (len(have) if end < 0 else end + 4), int(said) if said.isascii() and said.isdigit() else -1
        whole = end >= 0 and n >= 0 and fill(start + n + 4) and have[start + n : start + n + 4] == b"\r\n\r\n"
        if whole:
            stop = start + n + 4
        else:  # up to the next record
            stop = find(NEXT, max(0, start - 1))
            stop = len(have) if stop < 0 else stop + 1
            n = stop - start
        yield {"start": base, "length": stop, "warc_type": head.get(b"warc-type"), "uri": head.get(b"warc-target-uri"), "body": bytes(have[start : start + n]), "intact": whole}
        drop(stop)


def damaged(pages: DataFrame) -> DataFrame:
    """A replica in which known pages have rotted: a first byte is changed, the last bytes are lost, a record is lost, or one is added under a page's id."""
    text = F.coalesce("html", F.lit(""))
    rotten = F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("#"), F.substring(text, 2, 2**31 - 1))).when(F.col("page_id") % 211 == 7, F.concat(F.substring(text, 1, 40), F.lit("\u0000"))).otherwise(F.col("html"))
    kept = pages.where(F.coalesce(F.col("page_id") % 89 != 20, F.lit(True))).select("page_id", "url", rotten.alias("html"))
    return kept.unionAll(pages.where("page_id % 83 = 31 and page_id % 97 <> 13 and page_id % 211 <> 7 and page_id % 89 <> 20").select("page_id", "url", F.lit("added").alias("html")))


def op9_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of pages' archive with its place, its file's root, and what the audit of a damaged replica says; and the replica's extra records."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    mine, other = cut(leaves(pages), "warc-records"), cut(leaves(damaged(pages)), "warc-records")
    trees = cut(tree(mine), "warc-tree"), cut(tree(other), "warc-tree")
    found = cut(audit((mine, trees[0]), (other, trees[1])), "warc-found")
    roots = trees[0].where(F.col("level") == depth()).select("file", F.col("hash").alias("root_sha256"))
    # Of records that are alike in all, so many of the first ones are bad as the replica lacks.
    nth = F.row_number().over(Window.partitionBy("file", "slot", F.coalesce("id", F.lit(-1)), F.col("id").isNull(), "hash").orderBy("record"))
    bad = found.where("status <> 'extra'").select(F.col("file").alias("_file"), F.col("slot").alias("_slot"), F.col("id").alias("_id"), F.col("hash_left").alias("_hash"), "copies", "status", F.col("hash_right").alias("replica"))
    same = (F.col("file") == F.col("_file")) & (F.col("slot") == F.col("_slot")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    x = mine.withColumn("nth", nth).join(bad, same & (F.col("nth") <= F.col("copies")), "left").join(roots, "file")
    status = F.coalesce("status", F.lit("ok"))
    x = x.select(F.col("id").alias("page_id"), "file", "record", F.col("start").alias("offset"), "length", F.col("hash").alias("record_sha256"), "root_sha256", status.alias("status"), F.when(status == "ok", F.col("hash")).otherwise(F.col("replica")).alias("replica_sha256"))
    none = lambda kind: F.lit(None).cast(kind)
    extra = found.where("status = 'extra'").join(roots, "file", "left").select("id", "file", none("long"), none("long"), "length", none("string"), "root_sha256", "status", "hash_right")
    return x.unionAll(extra)


#: The same rows without a tree walk: records are compared one by one, and roots folded level by level.
ORACLE = """
WITH p AS (
  SELECT page_id, url, html, CASE WHEN page_id % 97 = 13 THEN '#' || substr(html, 2) WHEN page_id % 211 = 7 THEN substr(html, 1, 40) || chr(0) ELSE html END AS html2 FROM pages
), r AS (
  SELECT page_id, CAST(floor(page_id / 1000) AS BIGINT) AS file,
    encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(html)) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10)) AS a,
    encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(html2)) || chr(13) || chr(10) || chr(13) || chr(10) || html2 || chr(13) || chr(10) || chr(13) || chr(10)) AS b,
    encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: 5' || chr(13) || chr(10) || chr(13) || chr(10) || 'added' || chr(13) || chr(10) || chr(13) || chr(10)) AS c
  FROM p
), l AS (
  SELECT page_id, file, page_id % 1000 AS slot, row_number() OVER w - 1 AS record, octet_length(a) AS length, CAST(coalesce(sum(octet_length(a)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", sha256(a) AS record_sha256, sha256(b) AS rotten, sha256(c) AS added, octet_length(c) AS added_length
  FROM r WINDOW w AS (PARTITION BY file ORDER BY page_id)
), n1 AS (SELECT file, slot // 16 AS node, sum(length) AS length, sha256('1|' || slot // 16 || '|' || string_agg(slot || ':' || length || ':' || record_sha256, ',' ORDER BY slot)) AS h FROM l GROUP BY file, slot // 16),
n2 AS (SELECT file, node // 16 AS node2, sum(length) AS length, sha256('2|' || node // 16 || '|' || string_agg(node || ':' || length || ':' || h, ',' ORDER BY node)) AS h FROM n1 GROUP BY file, node // 16),
n3 AS (SELECT file, sha256('3|0|' || string_agg(node2 || ':' || length || ':' || h, ',' ORDER BY node2)) AS root_sha256 FROM n2 GROUP BY file)
SELECT page_id, file, record, "offset", length, record_sha256, root_sha256, CASE WHEN page_id % 89 = 20 THEN 'missing' WHEN record_sha256 = rotten THEN 'ok' ELSE 'changed' END AS status, CASE WHEN page_id % 89 <> 20 THEN rotten END AS replica_sha256
FROM l JOIN n3 USING (file)
UNION ALL
SELECT page_id, file, NULL, NULL, added_length, NULL, root_sha256, 'extra', added FROM l JOIN n3 USING (file) WHERE page_id % 83 = 31 AND page_id % 97 <> 13 AND page_id % 211 <> 7 AND page_id % 89 <> 20
"""
