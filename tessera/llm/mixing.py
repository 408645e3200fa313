"""Mixing sources to target weights by the cube method.

Each source has a target of words. Its documents get the inclusion rate target / source size: the whole part
is that many sure copies, the fraction is an inclusion probability. The flight phase moves the fractions along
directions that leave the source's number of documents and number of words as they are, until they are 0 or 1.
It runs in blocks of bounded size; the two fractions that a block may keep go to blocks of the next level, and
only a dozen of a source remain for landing, which rounds them all at once.

Nulls: a null source is a source of its own, last in order; a null text has size 0. Rows that are alike in id, source and
text are one unit with a multiplicity: k of them with a fraction f have the whole part of k * f as sure copies and the rest as
fraction, so however many there are, no block holds more than one. Empty tables give empty results.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.common import name_of, small
from tessera.operators.ordering import numbered
from tessera.session import cut

WORDS = r"[^\x20\x09-\x0D]+"
#: Units in a block of the flight phase, and blocks whose rests meet in one of the next level.
BLOCK, FAN = 4096, 1024
#: Fractions that are left for landing, besides the two that the flight leaves.
LANDING = 12


def size_of(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """Columns source, units, source_size, target: sources in code point order share all words by the repeating weights.

    A target stops at `most` times its source's size; the excess is shared again by weight. In order of
    cap / weight, the sources up to some place are capped and the rest get weight times a common level.
    The table has one row for each source.
    """
    by_source = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("units"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    x = by_source.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    before, after, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    x = x.withColumn("level", level).withColumn("rank", F.row_number().over(order))
    # The first place whose level keeps it below its cap; all after it stay below theirs.
    x = x.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("rank", "level"))).over(everything)["level"])
    return x.select("source", "units", "source_size", F.least("cap", F.coalesce(F.col("w") * F.col("level"), "cap")).alias("target"))


def fly(p: np.ndarray, size: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Flight phase over one block: the sum of p and of p * size stay; at most two fractions remain."""
    p = p.astype(float).copy()
    live: list[int] = []
    for unit in np.flatnonzero((p > 0) & (p < 1)).tolist():
        live.append(unit)
        if len(live) == 3:
            a, b, c = live
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            _move(p, live, u if any(u) else (1.0, -1.0, 0.0), draw)
            live = [k for k in live if 0 < p[k] < 1]
    if len(live) == 2 and size[live[0]] == size[live[1]]:
        _move(p, live, (1.0, -1.0), draw)
    return p


def _move(p: np.ndarray, units: list[int], u: tuple, draw: np.random.Generator) -> None:
    """Step along u or against it, as far as the first fraction that becomes 0 or 1; each p keeps its expectation."""
    up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(units, u) if x)
    down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(units, u) if x)
    step = up if draw.random() * (up + down) < down else -down
    for k, x in zip(units, u):
        p[k] += step * x
        if p[k] < 1e-9 or p[k] > 1 - 1e-9:
            p[k] = round(p[k])


def land(p: np.ndarray, size: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Landing of a source: LANDING fractions of spread sizes stay out of the flight; of the ways to round these and
    the two that the flight leaves, take the one nearest to the source's words, then to its number of documents."""
    live = np.flatnonzero((p > 0) & (p < 1))
    order = live[np.argsort(size[live], kind="stable")]
    spared = order[np.unique(np.linspace(0, len(order) - 1, min(LANDING, len(order))).round().astype(int))]
    held = p[spared]
    out = p.copy()
    out[spared] = 0
    out = fly(out, size, draw)
    out[spared] = held
    live = np.flatnonzero((out > 0) & (out < 1))
    ways = (np.arange(1 << len(live))[:, None] >> np.arange(len(live))) & 1
    words, units = ways @ size[live] - out[live] @ size[live], ways.sum(axis=1) - out[live].sum()
    out[live] = ways[np.lexsort((np.abs(units), np.abs(words)))[0]]
    return out


def _flight(seed: int, level: int, last: bool):
    """The flight phase of one block, and on the last level the landing of its source."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["unit", "size"], kind="stable").reset_index(drop=True)
        name = f"{seed}/{level}/{group['source'].iloc[0]}/{group['block'].iloc[0]}"
        draw, size = np.random.default_rng(zlib.crc32(name.encode("utf-8", "surrogatepass"))), group["size"].to_numpy(float)
        return group.assign(p=(land if last else fly)(group["p"].to_numpy(float), size, draw))

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 0) -> DataFrame:
    """Columns id, source, unit, size, source_size, target, copies for each row of docs.

    unit is a hash (16 bytes) of the row's id, source and text, for joining copies back to the rows.
    """
    unit = name_of(id_col, source_col, text_col)
    sizes = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), unit.alias("unit"), size_of(F.col(text_col)).alias("size")), "mix-sizes")
    plan = cut(targets(sizes, weights, most), "mix-targets")
    largest = plan.agg(F.max("units")).first()[0] or 0
    units = sizes.groupBy("unit").agg(F.first("id").alias("id"), F.first("source").alias("source"), F.first("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    rows = units.alias("s").join(plan.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    block = F.pmod(F.xxhash64("unit"), F.ceil(F.col("units") / BLOCK))
    rows = rows.select("id", "s.source", "unit", "size", "rows", "source_size", "target", F.floor(rate).alias("whole"), (F.col("rows") * (rate - F.floor(rate))).alias("p"), block.alias("block"))
    rows = rows.withColumn("sure", F.floor("p")).withColumn("p", F.col("p") - F.floor("p"))
    schema = rows.schema
    done, open_, blocks, level = [rows.where("p = 0")], rows.where("p > 0"), -(-largest // BLOCK), 0
    while True:
        last = blocks <= 1
        flown = cut(open_.groupBy("source", "block").applyInPandas(_flight(seed, level, last), schema), f"mix-flight-{level}")
        closed = F.col("p").isin(0.0, 1.0)
        done.append(flown.where(closed))
        if last:
            break
        open_, blocks, level = flown.where(~closed).withColumn("block", F.floor(F.col("block") / FAN)), -(-blocks // FAN), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    # Of a unit's rows, `more` have one copy beyond the whole part.
    out = cut(out.withColumn("more", (F.col("sure") + F.col("p")).cast("long")), "mix-units")
    single = out.where("rows = 1").withColumn("copies", F.col("whole") + F.col("more"))
    columns = [F.col("id").alias(id_col), "source", "unit", "size", "source_size", "target", F.col("copies").cast("long").alias("copies")]
    repeated = out.where("rows > 1")
    if repeated.isEmpty():
        return single.select(*columns)
    # Equal rows can't be told apart, so any of them may be the ones with more; they are counted over range partitions.
    again = sizes.select("unit").join(small(repeated.select("unit"), 16), "unit", "left_semi").withColumn("_any", F.rand(seed))
    again = numbered(again, ["unit"], [F.col("_any")], "_place", "mix-repeated").drop("_any")
    again = again.join(small(repeated, 192), "unit").withColumn("copies", F.col("whole") + (F.col("_place") <= F.col("more")).cast("long"))
    return single.select(*columns).unionAll(again.select(*columns))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents that the mix takes, with their number of copies; rows that are alike in id, source and text become one.

    The list of units taken is sent to the documents if it is small; else it is joined by a shuffle.
    """
    taken = mix(docs, id_col, text_col, source_col, **options).groupBy("unit").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    taken = cut(taken.where("_copies > 0"), "mix-taken")
    keep = [c for c in docs.columns if c not in ("unit", "copies")]
    named = docs.select(*keep, name_of(id_col, source_col, text_col).alias("unit"))
    out = named.join(small(taken.where("_rows = 1"), 48), "unit")
    repeated = taken.where("_rows > 1")
    if not repeated.isEmpty():
        out = out.unionByName(named.join(small(repeated, 48), "unit").dropDuplicates(["unit"]))
    return out.select(*keep, F.col("_copies").alias("copies"))


def op4_cube_mix(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, copies counted."""
    x = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return x.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
