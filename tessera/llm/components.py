"""Connected components of links, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.session import cut


def components(links: DataFrame) -> DataFrame:
    """Columns node, root (the least node that can be reached) for each end of links, a table with columns a and b.

    Each round hooks every node to its least neighbour, follows the hooks to their ends, and contracts the
    links. A round at least halves the nodes that still have links, so the rounds grow with the logarithm
    of the links. All state is in tables of the shared folder. Loops and
    repeated links do no harm; links with a null end are passed over; no links give no rows.
    """
    links = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-links")
    roots = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("root", F.col("node"))
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = cut(both.groupBy("a").agg(F.min("b").alias("up")).where("up < a"), "cc-hooks")
        while True:
            onward = hooks.select(F.col("a").alias("via"), F.col("up").alias("top"))
            jumped = cut(hooks.join(onward, hooks["up"] == onward["via"], "left").select("a", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "cc-jump")
            hooks = jumped.select("a", "up")
            if jumped.where("moved").isEmpty():
                break
        to = hooks.select(F.col("a").alias("from"), "up")
        roots = cut(roots.join(to, roots["root"] == to["from"], "left").select("node", F.coalesce("up", "root").alias("root")), "cc-roots")
        for end in ("a", "b"):
            links = links.join(to, links[end] == to["from"], "left").withColumn(end, F.coalesce("up", end)).select("a", "b")
        links = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-links")
    return roots
