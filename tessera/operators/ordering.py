"""Locale order, and numbers and running sums in a global order without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.session import cut


def locale_key(text: Column, collation: str = "UNICODE") -> Column:
    """The text under a collation, to be ordered or grouped by: letters first, accents and cases after them."""
    return F.collate(text, collation)


def spread(df: DataFrame, order: list[Column], name: str = "spread") -> DataFrame:
    """df in a global order over range partitions, written once; the column _part numbers them in that order.

    A range may split a group of equal leading keys, so that no group has to be in one partition. Only rows
    that are equal in all of order are together in one.
    """
    return cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)


def numbered(df: DataFrame, by: list[str], order: list[Column], column: str = "place", name: str = "numbered") -> DataFrame:
    """df with column: the place from 1 of each row in its group of by, ordered by order. by may be empty: then all rows are one group.

    order must tell the rows of a group apart for the numbers to be the same on each run. The rows are range partitioned
    by by and order; rows are numbered within a partition, and a partition's offset is the sum of
    what the ones before it have of the same group: a row for each group and partition it is in.
    """
    return running(df.withColumn("_one", F.lit(1).cast("long")), by, order, {column: "_one"}, name=name).drop("_one")


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, str], name: str = "running") -> DataFrame:
    """df with running sums, each row's own value included, of columns (sums: new column to summed one) within groups of by, as numbered() counts."""
    keys = [F.col(c) for c in by]
    x = spread(df, [*keys, *order], name)
    within = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.select("*", *(F.sum(s).over(within).alias(c) for c, s in sums.items()))
    parts = x.groupBy("_part", *by).agg(*(F.sum(s).alias(f"_sum_{c}") for c, s in sums.items()))
    # Groups of rows that are all in one partition need no offset, so the windows of parts are as wide as a group has partitions.
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("_part").alias("_p"), *(F.col(c).alias(f"_by_{c}") for c in by), *(F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).cast("long").alias(f"_before_{c}") for c in sums))
    parts = parts.where(" or ".join(f"_before_{c} <> 0" for c in sums))
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    x = x.join(parts, same, "left")
    kept = [c for c in df.columns if c not in sums]
    return x.select(*kept, *((F.col(c) + F.coalesce(f"_before_{c}", F.lit(0))).cast("long").alias(c) for c in sums))


def listing(df: DataFrame, order: list[Column], column: str = "place") -> DataFrame:
    """df with each row's place in one global order, as a listing shows it."""
    return numbered(df, [], order, column, "listing")


def first_of_each(df: DataFrame, by: list[str], order: Column, value: Column, n: int) -> DataFrame:
    """The first n values of each group in an order, and the number of all: by, first (array), size.

    Spark applies the window's limit before the exchange as well, so a task sends n rows of a group at most.
    """
    ranked = df.select(*by, order.alias("_order"), value.alias("_value"))
    top = ranked.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_order"))).where(F.col("_n") <= n)
    firsts = top.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_value"))), lambda x: x["_value"]).alias("first"))
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(firsts, by)
