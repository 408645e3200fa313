"""Run a query and its oracle side by side and compare rows, order aside."""

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


def compare(spark, con, function, sql, sf_dir):
    """A message about the first difference, or None."""
    ours = function(spark, sf_dir)
    theirs = con.sql(sql)
    names = sorted(ours.columns)
    if names != sorted(theirs.columns):
        return f"columns {names} and {sorted(theirs.columns)}"
    a = Counter(tuple(plain(r[n]) for n in names) for r in ours.collect())
    order = [theirs.columns.index(n) for n in names]
    b = Counter(tuple(plain(r[i]) for i in order) for r in theirs.fetchall())
    return None if a == b else f"{sum(a.values())} and {sum(b.values())} rows; ours only {list((a - b).items())[:2]}; oracle only {list((b - a).items())[:2]}"
