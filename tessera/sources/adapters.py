"""The driver's tables as the library's logical tables. Only projections, joins on keys, and grouping into arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entry(c: Callable[[str], Column]) -> list[Column]:
    """An entry's columns from those of lineitem, which c gives by name."""
    line = c("l_linenumber")
    return [
        c("l_partkey").alias("object_id"),
        F.concat_ws(":", c("l_partkey").cast("string"), c("l_suppkey").cast("string")).alias("storage_key"),
        F.nullif(c("l_returnflag"), F.lit("A")).alias("folder_id"),
        (c("l_quantity").cast("long") * 1000 + line).alias("size_bytes"),
        line.alias("line"),
        (line - 1).cast("long").alias("att_count"),
        ((line - 1) * (c("l_suppkey") + 1)).cast("long").alias("att_bytes"),
        (c("l_suppkey") + 1).cast("long").alias("att_each"),
    ]


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each entry of a snapshot, without the snapshot's own columns."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("snapshot_id"), *_entry(F.col))


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each snapshot: owner_id, snapshot_id, created_at."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner_id"), F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("created_at"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots with their entries as an ordered array; a snapshot without entries has an empty one."""
    raw = F.struct("l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_linenumber")
    grouped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("snapshot_id")).agg(F.collect_list(raw).alias("_raw"))

    def entry(r: Column) -> Column:
        *plain, count, _, each = _entry(lambda c: r[c])
        return F.struct(*plain, F.array_repeat(F.struct(each.alias("size_bytes")), count.cast("int")).alias("attachments"))

    # Entries are made after the shuffle, as their keys and attachments are the most of them.
    out = heads(spark, sf_dir).join(grouped, "snapshot_id", "left").withColumn("_all", F.array_sort(F.transform("_raw", entry)))
    return out.select("owner_id", "snapshot_id", "created_at", F.coalesce("_all", F.array().cast(out.schema["_all"].dataType)).alias("entries"))


def flat_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with their snapshot's owner and time."""
    return entries(spark, sf_dir).join(heads(spark, sf_dir), "snapshot_id")


#: The folder dimension: id and name.
FOLDERS = [("N", "Notes"), ("R", "Reports"), ("A", "Archive")]


def folders(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FOLDERS, "folder_id string, display_name string")


def delta_columns(events: DataFrame) -> DataFrame:
    """Delta items from events; works on a stream as well."""
    n = F.col("event_id")
    return events.select(
        (F.col("user_id") % 8).alias("drive_id"),
        F.col("user_id").alias("item_id"),
        "ts",
        n.alias("seq"),
        F.when(F.col("user_id") % 10 == 0, "folder").otherwise("file").alias("kind"),
        (F.col("event_type") == "error").alias("deleted"),
        F.when(F.col("event_type").isin("view", "click", "signup"), "/a").otherwise("/b").alias("path"),
        F.when(n % 5 == 0, "g").otherwise("f").alias("name"),
        F.when(n % 11 == 0, F.lit(None)).when(n % 4 == 0, F.concat(F.lit("e"), (n % 3).cast("string"))).otherwise("e0").alias("etag"),
    )


def delta_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_columns(table(spark, sf_dir, "events"))


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs by owner: seq (order of arrival), owner_id, bytes, checksum, storage_key."""
    body = F.coalesce("text", F.lit(""))
    checksum = F.sha2(body.cast("binary"), 256)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("lang").alias("owner_id"), F.octet_length(body).cast("long").alias("size_bytes"), checksum.alias("checksum"), F.concat(F.lit("data/"), F.col("lang"), F.lit("/"), checksum).alias("storage_key"))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by pool and type with their costs in resource units and bytes."""
    kind = F.col("event_type")
    pool = F.when(kind.isin("view", "click"), "mail").when(kind == "purchase", "drive").otherwise("identity")
    return table(spark, sf_dir, "events").select("ts", F.col("event_id").alias("seq"), F.col("user_id").alias("tenant_id"), pool.alias("pool"), kind.alias("request_type"), F.when(pool == "identity", 2).otherwise(1).cast("long").alias("cost"), F.floor(F.col("value") * 100).cast("long").alias("upload_bytes"))
