"""Prefix trie of conversations from mergeable partial tries.

A node is a sequence of turns, named by a 128-bit hash that goes on from its parent's. Each task walks its
conversations and combines them into a node table of bounded size: members, the least of them, and the list of those
that end there, in ranges of ids. Tables are merged by node, first within groups of tasks, then over all; end lists are
merged by node and range of ids, so that none grows beyond the width of a range.

The rollup needs no pass for each depth. A node belongs to its least member, so each conversation owns a
chain of nodes that goes up from its end, and chains make up the trie. Sums run along each chain, and a chain's total
goes to the nodes above it through one more merge, over the members of nodes: a subtree is what its members own, less
what the node's own chain has above it.

Rows without a conversation id are passed over. A null turn comes first; null roles and texts are empty; equal turns are
ordered by role and text; repeated rows are repeated turns. An empty table has no node, not even a root.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm.common import read_documents
from tessera.session import cut

#: Name of the root.
ROOT = bytes(16)
#: Nodes and ends that a task combines before it emits them; bits of the range of ids of an end list; groups of tasks of the first merge.
NODES, RANGE_BITS, GROUPS = 50_000, 16, 64
#: Parents with more than one in so many of all nodes as children are hot; there are at most so many.
HOT = 10_000
TURNS = "conv_id long, place long, role string, text string"
PARTIAL = "conv_id long, node binary, parent binary, depth long, words long, members long, least long, range long, ends array<bigint>"
_ARROW = pa.schema([("conv_id", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("words", pa.int64()), ("members", pa.int64()), ("least", pa.int64()), ("range", pa.int64()), ("ends", pa.list_(pa.int64()))])
_EMPTY = hashlib.sha256(b"").hexdigest()


def head_turns(conv_id: int) -> int:
    """Turns that a conversation takes from the first one of its block."""
    return zlib.crc32(str(conv_id).encode()) % 4


def _share_heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows base, conv_id, role, text, ordered by base, then the base's own, then conversation and turn, to TURNS; place 0 opens each conversation."""
    base, heads, conv, own, place, take, opened = None, [], None, 0, 0, 0, False
    for batch in batches:
        out: list[tuple] = []
        for b, c, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if not opened or b != base:
                base, heads, opened, conv = b, [], True, None
            if conv is None or c != conv:
                conv, own, place = c, 0, 0
                out.append((c, 0, "", ""))
                take = 0 if c == b else head_turns(c)
                for head in heads[:take]:
                    place += 1
                    out.append((c, place, *head))
            if c == b and len(heads) < 3:
                heads.append((role, text))
            own += 1
            if own > take:
                place += 1
                out.append((c, place, role, text))
        columns = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["conv_id", "place", "role", "text"])


def with_shared_heads(conversations: DataFrame, block: int = 20) -> DataFrame:
    """Rows of TURNS: every conversation with its first turns taken from conversation c - c % block. Rows of a conversation stay together, in order."""
    turns = _turns(conversations)
    base = F.col("conv_id") - F.col("conv_id") % block
    x = turns.withColumn("base", base).repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return x.select("base", "conv_id", "role", "text").mapInArrow(_share_heads, TURNS)


def _turns(conversations: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", empty("role"), empty("text"))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """Rows of TURNS from rows conv_id, turn, role, text, as prefix_trie() takes them."""
    x = _turns(conversations).withColumn("base", F.col("conv_id"))
    x = x.repartition("base").sortWithinPartitions("base", F.col("turn").asc_nulls_first(), "role", "text")
    return x.select("base", "conv_id", "role", "text").mapInArrow(_share_heads, TURNS)


def _partial_tries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of TURNS, in order, to PARTIAL: the path of each conversation, and combined nodes and end lists."""
    nodes: dict[bytes, list] = {}
    ends: dict[tuple[bytes, int], list[int]] = {}
    conv, node, waiting = None, ROOT, 0

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _ARROW], schema=_ARROW)

    def end() -> None:
        if conv is not None:
            ends.setdefault((node, conv >> RANGE_BITS), []).append(conv)

    def flush() -> Iterator[pa.RecordBatch]:
        rows = [{"node": k, "parent": v[0], "depth": v[1], "words": v[2], "members": v[3], "least": v[4]} for k, v in nodes.items()]
        rows += [{"node": k, "range": r, "ends": v} for (k, r), v in ends.items()]
        nodes.clear()
        ends.clear()
        for at in range(0, len(rows), 10_000):
            yield batch_of(rows[at : at + 10_000])

    for batch in batches:
        path_conv, path_node = [], []
        for c, place, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if place == 0:
                end()
                conv, parent, node, words = c, None, ROOT, 0
                waiting += 1
            else:
                parent, role, text = node, role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
                node, words = xxhash.xxh3_128_digest(b"%b%d:%b%b" % (parent, len(role), role, text)), len(text.split())
            path_conv.append(c)
            path_node.append(node)
            known = nodes.get(node)
            if known is None:
                nodes[node] = [parent, place, words, 1, c]
            else:
                known[3] += 1
                known[4] = min(known[4], c)
        if path_conv:
            yield pa.RecordBatch.from_arrays([pa.array(path_conv, pa.int64()), pa.array(path_node, pa.binary()), *(pa.nulls(len(path_conv), f.type) for f in list(_ARROW)[2:])], schema=_ARROW)
        if len(nodes) >= NODES or waiting >= NODES:
            yield from flush()
            waiting = 0
    end()
    yield from flush()


def _merged(partial: DataFrame, keys: list[str], merge: list) -> DataFrame:
    """Tables of nodes, merged within groups of the tasks that emitted them, and then over all."""
    grouped = partial.groupBy(*keys, (F.spark_partition_id() % GROUPS).alias("_group")).agg(*merge)
    return grouped.groupBy(*keys).agg(*merge)


def _hash_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows node, range, ends, ordered, to node and the hash of its ids; a list is as long as a range at most, and only one is held."""
    last, state, first = None, None, True
    for batch in batches:
        done = []
        for i in range(batch.num_rows):
            node = batch.column(0)[i].as_py()
            if node != last:
                if last is not None:
                    done.append((last, state.hexdigest()))
                last, state, first = node, hashlib.sha256(), True
            ids = ",".join(map(str, batch.column(2)[i].as_py())).encode()
            state.update(ids if first else b"," + ids)
            first = False
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["node", "ends_sha256"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["node", "ends_sha256"])


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row for each node: node and parent (128-bit names), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns are those of ordered_turns() or with_shared_heads(): each conversation's rows together in one partition, in order.
    """
    partial = cut(turns.mapInArrow(_partial_tries, PARTIAL), "trie-partial")
    paths = partial.where("conv_id is not null").select("conv_id", "node")
    # Equal nodes have equal parents, depths and words, so the least of each is the one there is.
    same = [F.min(c).alias(c) for c in ("parent", "depth", "words")]
    nodes = _merged(partial.where("members is not null"), ["node"], [*same, F.sum("members").alias("members"), F.min("least").alias("least")])
    nodes = cut(nodes, "trie-nodes")
    ends = _merged(partial.where("range is not null"), ["node", "range"], [F.array_sort(F.flatten(F.collect_list("ends"))).alias("ends")])
    hashed = ends.repartition("node").sortWithinPartitions("node", "range").select("node", "range", "ends").mapInArrow(_hash_ends, "node binary, ends_sha256 string")

    counts = nodes.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "node")
    x = nodes.join(counts, "node", "left").join(hashed, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    x = x.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("members") - 1) * F.col("words"))
    chain = Window.partitionBy("least").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("leaf_above", F.coalesce(F.sum("leaf").over(chain), F.lit(0))).withColumn("saved_above", F.coalesce(F.sum("saved").over(chain), F.lit(0)))
    x = cut(x, "trie-chains")
    totals = x.groupBy(F.col("least").alias("conv_id")).agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved_tokens"))
    below = paths.join(totals, "conv_id").groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    x = x.join(below, "node")

    # Of the parents, the hot ones are few and sent to all tasks; their children are dealt by their own names then, so no key of the join is hot.
    n, hot = nodes.count(), F.col("n_children") * HOT
    parents = x.where("n_children > 0").select(F.col("node").alias("above"), F.col("least").alias("parent_conv"), "n_children")
    few = parents.where(hot > n).select(F.col("above").alias("above_0"), F.col("parent_conv").alias("conv_0"))
    x = x.join(F.broadcast(few), x["parent"] == few["above_0"], "left")
    rest = parents.where(hot <= n).select(F.col("above").alias("above_1"), F.col("parent_conv").alias("conv_1"))
    x = x.join(rest, F.when(F.col("conv_0").isNull(), x["parent"]).otherwise(x["node"]) == F.col("above_1"), "left")
    return x.select(
        "node",
        "parent",
        F.col("least").alias("conv_id"),
        "depth",
        F.coalesce("conv_0", "conv_1").alias("parent_conv_id"),
        F.col("members").alias("n_convs"),
        "n_children",
        (F.col("leaves") - F.col("leaf_above")).alias("n_leaves"),
        (F.col("saved_tokens") - F.col("saved_above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, whose first turns are shared within blocks of twenty."""
    x = prefix_trie(with_shared_heads(read_documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    return x.drop("node", "parent")


ORACLE = r"""
WITH RECURSIVE crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place FROM conversations WHERE conv_id IS NOT NULL),
heads AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 AS BIGINT) + 1])), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
pieces AS (SELECT h.conv_id, 0 AS own, t.place, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.conv_id - h.conv_id % 20 AND t.place <= h.h
 UNION ALL SELECT h.conv_id, 1, t.place, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.place > h.h),
rebuilt AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS d FROM pieces),
paths AS (SELECT conv_id, d AS depth, sha256(string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY d)) AS node, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM rebuilt
 UNION ALL SELECT conv_id, 0, 'root', 0 FROM heads),
linked AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, max(depth) OVER (PARTITION BY conv_id) AS last FROM paths),
nodes AS (SELECT node, min(parent) AS parent, min(conv_id) AS conv_id, min(depth) AS depth, min(words) AS words, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = last), '') AS ends FROM linked GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (node)),
below AS (SELECT p.node, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.words) AS saved FROM paths p JOIN full_nodes v ON v.conv_id = p.conv_id AND v.depth >= p.depth GROUP BY p.node)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, x.n_convs, x.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM full_nodes x JOIN below b USING (node) LEFT JOIN nodes u ON u.node = x.parent"""
