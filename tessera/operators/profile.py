"""CPU-profile analysis: self and total time, domains, top functions, hot path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.session import cut

#: Rules of the profile in the driver's tables: domain by pattern, the first that matches counts.
DOMAINS = [("crypto", "Brand#1"), ("storage", "Brand#2"), ("network", "Brand#[34]")]


#: Domains of scripts that aren't a project's own, by pattern, the first that matches counts; a project's rules go before them.
SCRIPTS = [
    ("node:crypto", "node:crypto"), ("node:streams", "node:internal/streams"), ("node:internals", "node:internal/"), ("node:network", "node:net|node:tls|node:https|node:http"), ("node:fs", "node:fs|node:path"), ("node:other", "node:"),
    ("aws-sdk", "@aws-sdk/"), ("ms-graph-sdk", "@microsoft/microsoft-graph-client"), ("dependencies", "node_modules/"),
]


def script_domain(url: Column, project: list[tuple[str, str]]) -> Column:
    """Domain of a script's URL: by the project's rules, then by SCRIPTS."""
    return domain(F.when(url != "(unknown)", url), project + SCRIPTS, "(other)", "(runtime)")


def domain(name: Column, rules: list[tuple[str, str]] = DOMAINS, other: str = "other", none: str = "runtime") -> Column:
    """The first rule's domain whose pattern is found in a name; `none` for no name, `other` for no rule."""
    out = F.lit(other)
    for label, pattern in reversed(rules):
        out = F.when(name.rlike(pattern), label).otherwise(out)
    return F.when(F.coalesce(name, F.lit("")) == "", none).otherwise(out)


def total_time(nodes: DataFrame) -> DataFrame:
    """Nodes (node, parent, self_us) with total_us, the sum over their subtrees, for trees of any height.

    Each round doubles how far down the sums reach and how far up the pointers point, so the rounds grow with the
    logarithm of the height. All rounds are written to the shared folder.
    """
    x = nodes.select("node", F.col("parent").alias("up"), F.col("self_us").cast("long").alias("total_us"))
    while True:
        x = cut(x, "profile-round")
        if x.where("up is not null").isEmpty():
            break
        below = x.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("total_us").cast("long").alias("more"))
        above = x.select(F.col("node").alias("up"), F.col("up").alias("next"))
        x = x.join(below, "node", "left").join(above, "up", "left").select("node", F.col("next").alias("up"), (F.col("total_us") + F.coalesce("more", F.lit(0))).alias("total_us"))
    return nodes.join(x.select("node", "total_us"), "node")


def hot_paths(nodes: DataFrame, limit: int = 8) -> DataFrame:
    """From each of the heaviest children of the roots, down to the heaviest child again and again: start, total_us, path.

    At most `limit` paths are walked, a level of all of them in each round.
    """
    heavy = hot_children(nodes).select(F.col("node").alias("at"), "child")
    roots = nodes.where(F.col("parent").isNull()).select(F.col("node").alias("root"))
    top = nodes.join(roots, nodes["parent"] == roots["root"]).orderBy(F.desc("total_us"), "node").limit(limit)
    walk, done = cut(top.select(F.col("node").alias("start"), "total_us", F.col("node").alias("at"), F.array("node").alias("path")), "profile-walk"), None
    while not walk.isEmpty():
        x = cut(walk.join(heavy, "at", "left"), "profile-walk")
        ended = x.where("child is null").select("start", "total_us", "path")
        done = ended if done is None else done.unionByName(ended)
        walk = x.where("child is not null").select("start", "total_us", F.col("child").alias("at"), F.concat("path", F.array("child")).alias("path"))
    return done if done is not None else walk.select("start", "total_us", "path")


def by_domain(functions: DataFrame, top: int = 5) -> DataFrame:
    """Self time and count of functions by domain, and the functions with most of it."""
    x = functions.withColumn("domain", domain(F.col("name")))
    w = Window.partitionBy("domain").orderBy(F.desc("self_us"), "function_id")
    x = x.withColumn("rank", F.row_number().over(w))
    return x.groupBy("domain").agg(F.sum("self_us").cast("long").alias("self_us"), F.count(F.lit(1)).alias("functions"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "function_id")))), lambda t: t["function_id"].cast("string")), ",").alias("top"))


def top_functions(functions: DataFrame, n: int = 30) -> DataFrame:
    return functions.where(F.col("self_us") > 0).orderBy(F.desc("self_us"), "function_id").limit(n)


def hot_children(nodes: DataFrame) -> DataFrame:
    """The heaviest child of each node, for walking the hot path."""
    return nodes.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.max_by(F.struct("node", "total_us"), F.struct(F.col("total_us"), -F.col("node"))).alias("c")).select(F.col("parent").alias("node"), F.col("c.node").alias("child"), F.col("c.total_us").alias("child_us"))
