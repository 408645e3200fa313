"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Maps A-Z to a-z and leaves every other byte of UTF-8 alone.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

#: Rows of a batch that become Python objects at once, to bound memory on long texts.
STEP = 256


def lower_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text with A-Z lower-cased, as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def map_rows(df: DataFrame, per_row: Callable[[], Callable], schema: str) -> DataFrame:
    """mapInArrow with a function of one row's values that returns a tuple of output values.

    per_row() is called once in each task and returns the function, so tables it needs are built once.
    Where the function returns None, the row goes.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = per_row()
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                rows = [r for r in (function(*values) for values in zip(*(c.to_pylist() for c in part.columns))) if r is not None]
                columns = zip(*rows) if rows else [()] * len(target)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, target.types)], schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(run, schema)


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def read_documents(spark, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes up to which small() sends a table to all tasks.
SENT_BYTES = 16 << 20


def small(df: DataFrame, row_bytes: int | Column) -> DataFrame:
    """df with the hint to broadcast it if its rows, summed up now, take SENT_BYTES at most; else df, to be joined by a shuffle.

    row_bytes is a bound for each row. df must be cheap to read, such as a table that was written.
    """
    total = df.agg(F.coalesce(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes), F.lit(0)).cast("long")).first()[0]
    return F.broadcast(df) if total <= SENT_BYTES else df


def name_of(*columns: str) -> Column:
    """128-bit name of what is in some columns; null differs from empty."""
    marked = lambda c: F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(*map(marked, columns)).cast("binary")))
