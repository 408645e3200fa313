"""Large bodies in chunks: hashing in order without gathering a body, and deduplication on the result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Fixed value: bodies of so many bytes or more take the path in chunks.
LARGE = 512 << 20


def chunks(bodies: DataFrame, chunk_bytes: int, id_col: str = "body_id", body_col: str = "body") -> DataFrame:
    """body_id, number (from 0), chunk of each body (binary); an empty or null body is one empty chunk."""
    body = F.coalesce(F.col(body_col), F.lit(b""))
    last = F.greatest(F.ceil(F.octet_length(body) / chunk_bytes).cast("int") - 1, F.lit(0))
    x = bodies.select(F.col(id_col).alias("body_id"), body.alias("_body"), F.explode(F.sequence(F.lit(0), last)).alias("number"))
    return x.select("body_id", "number", F.substring(F.col("_body"), F.col("number") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("chunk"))


def _fold(kind: pa.DataType):
    """Rows body_id, chunk, ordered, to body_id, sha256, size_bytes, chunks; only a hash's state and a batch are held."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, size, count = None, None, 0, 0

        def row(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.string(), pa.int64(), pa.int64()))], names=["body_id", "sha256", "size_bytes", "chunks"])

        for batch in batches:
            done = []
            for i in range(batch.num_rows):
                body = batch.column(0)[i].as_py()
                if state is None or body != last:
                    if state is not None:
                        done.append((last, state.hexdigest(), size, count))
                    last, state, size, count = body, hashlib.sha256(), 0, 0
                data = batch.column(1)[i].as_buffer()
                state.update(data)
                size, count = size + len(data), count + 1
            yield row(done)
        if state is not None:
            yield row([(last, state.hexdigest(), size, count)])

    return run


def chunked_sha256(chunk_rows: DataFrame) -> DataFrame:
    """body_id, sha256, size_bytes, chunks, from rows body_id, number, chunk in any order.

    Chunks are sorted by body and number and hashed one after the other as they stream by: a body of any size takes the memory of a
    batch. A hash depends on the order of all its bytes, so one body's chunks are read by one task.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = chunk_rows.schema["body_id"].dataType
    x = chunk_rows.repartition("body_id").sortWithinPartitions("body_id", "number").select("body_id", "chunk")
    return x.mapInArrow(_fold(to_arrow_type(kind)), f"body_id {kind.simpleString()}, sha256 string, size_bytes bigint, chunks bigint")


def store_outcomes(hashed: DataFrame, owner: Column, stored: DataFrame) -> DataFrame:
    """hashed with storage_key and outcome: staged bodies are promoted to the key of their hash (stored) unless the store has it or a body before them (by body_id) took it (deduplicated)."""
    x = hashed.withColumn("storage_key", F.concat_ws("/", F.lit("data"), owner, F.col("sha256")))
    first = x.groupBy("storage_key").agg(F.min("body_id").alias("_first")).join(stored.select("storage_key").distinct(), "storage_key", "left_anti")
    x = x.join(first, "storage_key", "left")
    return x.withColumn("outcome", F.when(F.col("body_id") == F.col("_first"), "stored").otherwise("deduplicated")).drop("_first")
