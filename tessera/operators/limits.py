"""Request accounting: costs by pool and type, sliding and tumbling windows, throttle fences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Operation, pool, resource units, tokens of the limiter (none where the operation isn't limited), and whether its bytes are an upload.
COSTS = [
    ("list_users", "identity", 2, None, False), ("mailbox_exists", "identity", 1, None, False), ("list_folders", "outlook", 1, 1, False), ("delta_sync", "outlook", 1, 2, False), ("delta_sync_link", "outlook", 1, 1, False),
    ("fetch_message", "outlook", 1, 1, False), ("fetch_attachments", "outlook", 1, 1, False), ("create_folder", "outlook", 1, None, False), ("create_message", "outlook", 1, None, False), ("add_attachment", "outlook", 1, None, True),
    ("upload_chunk", "outlook", 1, None, True),
]


def cost_table(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(COSTS, "operation string, pool string, cost bigint, tokens bigint, upload boolean"))


def request_costs(requests: DataFrame) -> DataFrame:
    """By pool and request type: requests, resource units, limiter tokens and uploaded bytes.

    requests: operation, has_link (a delta query with a link takes one token, without one two), size_bytes. Bytes count where the operation uploads them. The cost table is eleven rows.
    """
    named = F.when((F.col("operation") == "delta_sync") & F.col("has_link"), "delta_sync_link").otherwise(F.col("operation"))
    x = requests.withColumn("request_type", F.col("operation")).withColumn("operation", named).join(cost_table(requests.sparkSession), "operation")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return x.groupBy("pool", "request_type").agg(F.count(F.lit(1)).alias("requests"), total("cost").alias("cost"), total("tokens").alias("tokens"), total(F.when(F.col("upload"), F.col("size_bytes"))).alias("upload_bytes"))


def cost_by(log: DataFrame, by: str) -> DataFrame:
    return log.groupBy(by).agg(F.count(F.lit(1)).alias("requests"), F.sum("cost").cast("long").alias("cost"), F.sum("upload_bytes").cast("long").alias("upload_bytes"))


def sliding(log: DataFrame, minutes: int = 10, budget: int = 9600) -> DataFrame:
    """Per request the cost its tenant has in the window that ends with it, and what the budget leaves."""
    w = Window.partitionBy("tenant_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-minutes * 60 * 1_000_000, 0)
    used = F.sum("cost").over(w).cast("long")
    return log.select("seq", "tenant_id", "ts", used.alias("window_cost"), (F.lit(budget) - used).alias("left"))


def tumbling(log: DataFrame, width: str = "1 hour") -> DataFrame:
    """Requests and cost by pool and window; on a stream, with a watermark before it, the windows close."""
    return log.groupBy(F.window("ts", width).alias("w"), "pool").agg(F.count(F.lit(1)).alias("requests"), F.sum("cost").cast("long").alias("cost")).select(F.col("w.start").alias("window_start"), "pool", "requests", "cost")


def throttle_islands(raises: DataFrame, minutes: int = 30) -> DataFrame:
    """Unions of the intervals [raise, raise + minutes) of each tenant: start, end, raises."""
    at, width = F.unix_micros(F.col("ts").cast("timestamp")), minutes * 60 * 1_000_000
    w = Window.partitionBy("tenant_id").orderBy("ts", "seq")
    x = raises.withColumn("new", (F.coalesce(at - F.lag(at).over(w), F.lit(width)) >= width).cast("int"))
    x = x.withColumn("island", F.sum("new").over(w))
    return x.groupBy("tenant_id", "island").agg(F.min("ts").alias("start"), (F.max("ts") + F.make_dt_interval(mins=F.lit(minutes))).alias("end"), F.count(F.lit(1)).alias("raises")).drop("island")


def concurrency(requests: DataFrame, limit: int = 4) -> DataFrame:
    """Per tenant: the most requests at once, and how many began while `limit` or more were under way, as a limiter would have made them wait.

    requests: tenant_id, seq, start_us, end_us (an end isn't part of the request). Starts and ends are one ordered list with a
    running sum over range partitions, so a busy tenant is in many tasks.
    """
    from tessera.operators.ordering import running

    start = requests.select("tenant_id", F.col("start_us").alias("at"), F.lit(1).alias("kind"), "seq", F.lit(1).cast("long").alias("step"))
    end = requests.select("tenant_id", F.col("end_us").alias("at"), F.lit(0).alias("kind"), "seq", F.lit(-1).cast("long").alias("step"))
    x = running(start.unionAll(end), ["tenant_id"], [F.col("at"), F.col("kind"), F.col("seq")], {"open": "step"}, "concurrency")
    return x.where("kind = 1").groupBy("tenant_id").agg(F.max("open").alias("most"), F.count_if(F.col("open") > limit).alias("waiting"))
