"""Distinct file names in folders: the first row with a name keeps it, later ones get _1, _2 and so on before the extension, passing over names that are taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.ordering import numbered, running
from tessera.session import cut, drop

#: Extension: from the last dot on, unless that is the first character.
_SPLIT = r"(?s)^(.+?)(\.[^.]*)?\z"


def _stem(name: Column) -> Column:
    return F.when(name == "", name).otherwise(F.regexp_extract(name, _SPLIT, 1))


def _end(name: Column) -> Column:
    return F.when(name == "", name).otherwise(F.regexp_extract(name, _SPLIT, 2))


def suffixed(name: Column, number: Column) -> Column:
    """A name with a number before its extension."""
    return F.concat(_stem(name), F.lit("_"), number.cast("string"), _end(name))


def distinct_names(rows: DataFrame, by: str = "folder_id", order: str = "ordinal", name: str = "name") -> DataFrame:
    """rows (by, order, name, which tell rows apart) with file_name, as a loop over each folder's rows in order gives it.

    The rows of one name in a folder are a family. The n-th of them that finds its name taken gets number n, plus the numbers that
    others have taken from the family's row: those of rows whose own name is such a numbered name. A family is
    settled after the one whose numbers can take its name, so families go in rounds by how many suffixes
    their names end with; within a round, a number is taken by the row that comes first. All places are counts over
    range partitions, so no family and no folder is gathered in one task.
    """
    base = rows.select(F.col(by).alias("_f"), F.col(order).alias("_o"), F.coalesce(F.col(name), F.lit("")).alias("_name"))
    base = numbered(base, ["_f", "_name"], [F.col("_o")], "_at", "names-rows")
    firsts = cut(base.where("_at = 1").select("_f", "_name", F.col("_o").alias("_first")), "names-families")
    # The family whose numbers can be this name: stem without its last suffix, same extension, and a number without leading zeros.
    number = F.regexp_extract(_stem(F.col("_name")), r"(?s)^.*_([1-9][0-9]{0,17})\z", 1)
    parent = F.concat(F.regexp_extract(_stem(F.col("_name")), r"(?s)^(.*)_[1-9][0-9]{0,17}\z", 1), _end(F.col("_name")))
    links = firsts.where(number != "").select("_f", F.col("_name"), "_first", parent.alias("_parent"), number.cast("long").alias("_k"))
    links = links.join(firsts.select("_f", F.col("_name").alias("_parent"), F.col("_first").alias("_parent_first")), ["_f", "_parent"])
    links = cut(links.where(suffixed(F.col("_parent"), F.col("_k")) == F.col("_name")), "names-links")

    # Families that have no such parent are settled at once; their children next, and so on.
    free = firsts.select("_f", "_name", F.lit(False).alias("_lost")).join(links.select("_f", "_name"), ["_f", "_name"], "left_anti")
    open_links, settled, shifts = links, cut(free, "names-settled"), None
    while not open_links.isEmpty():
        ready = cut(open_links.join(settled.select("_f", F.col("_name").alias("_parent"), F.col("_lost").alias("_parent_lost")), ["_f", "_parent"]), "names-ready")
        blocked, lost = _settle(ready, base)
        shifts = blocked if shifts is None else cut(shifts.unionByName(blocked), "names-shifts")
        settled = cut(settled.unionByName(lost), "names-settled")
        open_links = cut(open_links.join(ready.select("_f", "_name"), ["_f", "_name"], "left_anti"), "names-open")

    # The n-th duplicate of a family gets the n-th number that isn't blocked.
    x = base.join(settled, ["_f", "_name"]).withColumn("_n", F.col("_at") - F.when(F.col("_lost"), 0).otherwise(1))
    if shifts is None:
        x = x.withColumn("_number", F.col("_n"))
    else:
        x = _number_of(x, shifts, "_n")
    file_name = F.when(F.col("_n") == 0, F.col("_name")).otherwise(suffixed(F.col("_name"), F.col("_number")))
    out = x.select(F.col("_f").alias(by), F.col("_o").alias(order), F.col("_name").alias(name), file_name.alias("file_name"))
    return out


def _number_of(x: DataFrame, blocked: DataFrame, n: str) -> DataFrame:
    """x with _number: the n-th number from 1 of each family that isn't blocked. blocked: _f, _name, _k, in which a family has each number once.

    A blocked number k that has j blocked ones below it stands before the (k - j)-th free one; the n-th free number is n plus
    the blocked ones that stand before it or at it: a running count over both tables in one order.
    """
    ranked = numbered(blocked, ["_f", "_name"], [F.col("_k")], "_j", "names-ranked")
    rows = x.select("_f", "_name", F.col(n).alias("_pos"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_tie"), F.lit(0).cast("long").alias("_one"), F.struct("*").alias("_row"))
    no_row = F.lit(None).cast(rows.schema["_row"].dataType).alias("_row")
    marks = ranked.select("_f", "_name", (F.col("_k") - F.col("_j") + 1).alias("_pos"), F.lit(0).alias("_kind"), F.col("_k").alias("_tie"), F.lit(1).cast("long").alias("_one"), no_row)
    # Only families with a blocked number take part; the others' numbers are their places.
    hit = blocked.select("_f", "_name").distinct()
    both = running(marks.unionByName(rows.join(hit, ["_f", "_name"], "left_semi")), ["_f", "_name"], [F.col("_pos"), F.col("_kind"), F.col("_tie")], {"_shift": "_one"}, "names-shift")
    shifted = both.where("_kind = 1").select("_row.*", (F.col("_pos") + F.col("_shift")).alias("_number"))
    return shifted.unionByName(x.join(hit, ["_f", "_name"], "left_anti").withColumn("_number", F.col(n)))


def _settle(ready: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For families whose parents are settled: the numbers that their first rows block in the parent (_f, _name: the parent's, _k), and which of them lost their own name (_f, _name, _lost).

    A first row keeps its name if the parent's row that would take number k comes later, or there is none. Which row that is
    depends on the lower numbers that are blocked: with j of them, it is the duplicate number k - j. Rounds go on until one changes
    nothing. Each round is right for one more number of each parent at least, and as a rule for all whose row comes clearly earlier or later.
    """
    dups = base.join(ready.select("_f", F.col("_parent").alias("_name"), "_parent_lost").distinct(), ["_f", "_name"], "left_semi")
    parents = ready.select("_f", F.col("_parent").alias("_name"), "_parent_lost").distinct()
    dups = dups.join(parents, ["_f", "_name"]).select("_f", F.col("_name").alias("_parent"), (F.col("_at") - F.when(F.col("_parent_lost"), 0).otherwise(1)).alias("_n"), F.col("_o").alias("_taker")).where("_n > 0")
    dups = cut(dups, "names-duplicates")
    blocked = None
    while True:
        if blocked is None:
            guess = ready.select("_f", "_parent", "_name", "_first", "_k", F.col("_k").alias("_n"))
        else:
            # Number k falls to the row number k less the blocked ones below it.
            marks = ready.join(blocked.select("_f", "_name", F.lit(1).cast("long").alias("_one")), ["_f", "_name"], "left").withColumn("_one", F.coalesce("_one", F.lit(0)).cast("long"))
            marks = running(marks, ["_f", "_parent"], [F.col("_k")], {"_below": "_one"}, "names-below")
            guess = marks.select("_f", "_parent", "_name", "_first", "_k", (F.col("_k") - F.col("_below") + F.col("_one")).alias("_n"))
        found = guess.join(dups, ["_f", "_parent", "_n"], "left")
        keeps = cut(found.where(F.col("_taker").isNull() | (F.col("_taker") > F.col("_first"))).select("_f", "_parent", "_name", "_k"), "names-blocked")
        same = blocked is not None and keeps.count() == blocked.count() and keeps.join(blocked, ["_f", "_name"], "left_anti").isEmpty()
        if blocked is not None:
            drop(blocked)
        blocked = keeps
        if same:
            break
    lost = ready.join(blocked.select("_f", "_name", F.lit(True).alias("_kept")), ["_f", "_name"], "left")
    lost = lost.select("_f", "_name", F.col("_kept").isNull().alias("_lost"))
    return blocked.select("_f", F.col("_parent").alias("_name"), "_k"), lost
