"""Undirected weighted graphs as edge tables (u, v, weight)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import keep_last, materialize, scope


def _stars(edges: DataFrame) -> bool:
    """Whether every node points to one smaller node, which points to none."""
    pointed = edges.select(F.col("v").alias("u")).distinct()
    if not edges.where("v > u").isEmpty() or not edges.join(pointed, "u", "left_semi").isEmpty():
        return False
    return edges.groupBy("u").count().where("count > 1").isEmpty()


#: Nodes with more edges than this, and than one in SHARE of all, are hubs. There are less than 2 * SHARE of them, so they can be broadcast.
LARGE, SHARE = 100_000, 10_000


def _sent_on(edges: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """Edges (u, v) -> (v, m), with m of the node u. Edges of a hub, which are many and of one key, get it by broadcast, all others by a shuffle."""
    if n_edges > LARGE:
        hubs = least.where(F.col("n") > max(LARGE, n_edges // SHARE)).select("u", F.col("m").alias("hub_m"))
        edges = edges.join(F.broadcast(hubs), "u", "left")
        of_hubs = edges.where("hub_m is not null").select(F.col("v").alias("u"), F.col("hub_m").alias("v"))
        rest = edges.where("hub_m is null").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return of_hubs.unionByName(rest)
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


#: Edges that one task contracts.
CHUNK = 1 << 20


def _least(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, and the least node that each is connected with by them."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if (low == high).all():
            return nodes, nodes[root]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def _contracted(edges: DataFrame) -> DataFrame:
    """(node, root): each task's edges, CHUNK at a time, as stars around the least node."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches):
        held, n = [], 0

        def star():
            table = pa.Table.from_batches(held)
            node, root = _least(table["u"].to_numpy(), table["v"].to_numpy())
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                yield star()
                held, n = [], 0
        if held:
            yield star()

    return edges.select("u", "v").mapInArrow(run, f"node {kind}, root {kind}")


def _roots(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of edges, u <> v, by contraction: ranges of edges become stars, and only what joins two stars goes on. Small graphs are
    one task's. Tables are made in the scope around."""
    n = edges.count()
    if n <= CHUNK:
        return materialize(_contracted(edges.coalesce(1)), "graph-roots")
    stars = materialize(_contracted(edges.repartitionByRange(-(-n // CHUNK) + 1, "u", "v")), "graph-chunks").distinct()
    least = stars.groupBy("node").agg(F.min("root").alias("m"))
    # a node of several stars joins their roots
    joins = materialize(stars.join(least, "node").where("root <> m").select(F.col("root").alias("u"), F.col("m").alias("v")).distinct(), "graph-joins")
    roots = _roots(joins) if joins.count() <= n // 2 else _alternated(joins)
    own = least.join(roots.select(F.col("node").alias("m"), F.col("root").alias("far")), "m", "left")
    return materialize(own.select("node", F.coalesce("far", "m").alias("root")), "graph-roots")


def _alternated(now: DataFrame) -> DataFrame:
    """(node, root): large-star and small-star steps alternate until edges, u <> v, are stars; every round is two aggregates and two joins over edges."""
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _sent_on(both.where("v > u"), least, now.count()).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        now = materialize(large.join(least, "u").select(F.explode(star).alias("e")).select("e.*").where("u <> v").distinct(), "graph-stars")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node is connected with. Whole numbers are contracted chunk by chunk; where that does not halve the edges,
    and for other nodes, large-star and small-star steps alternate."""
    loops = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
    whole = all(edges.schema[c].dataType.simpleString() in ("bigint", "int") for c in "uv") and edges.schema["u"].dataType == edges.schema["v"].dataType
    with scope(edges.sparkSession) as made:
        now = materialize(edges.where("u <> v").select("u", "v").distinct(), "graph-edges")
        roots = _roots(now) if whole else materialize(_alternated(now), "graph-roots")
        keep_last(made)
    return loops.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def is_connected(edges: DataFrame) -> bool:
    return components(edges).select("root").distinct().limit(2).count() <= 1


def has_path(edges: DataFrame, a, b) -> bool:
    return components(edges).where(F.col("node").isin(a, b)).agg(F.countDistinct("root"), F.countDistinct("node")).first()[0:2] == (1, 1 if a == b else 2)


def edges_of(edges: DataFrame, node) -> DataFrame:
    return edges.where((F.col("u") == node) | (F.col("v") == node))


#: Edges that a task of a spanning forest takes.
EDGES = 1 << 18


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The minimum spanning tree of each group (group_id, u, v, weight); ties by (u, v).

    Edges of a large group are dealt into chunks: what is not in the forest of its chunk is not in the group's, so each round leaves at most a chunk's
    nodes of each, until a group is one chunk, or chunks do not shrink any more. A task so holds EDGES edges, or those of a forest.
    """

    def tree(part):
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        part = part.sort_values(["weight", "u", "v"])
        keep = []
        for u, v in zip(part["u"].tolist(), part["v"].tolist()):
            a, b = find(u), find(v)
            keep.append(a != b)
            root[a] = b
        return part[keep]

    rows = edges.select("group_id", "u", "v", "weight")
    largest = rows.groupBy("group_id").count().agg(F.max("count")).first()[0] or 0
    while largest > EDGES:
        sizes = rows.groupBy("group_id").agg(F.ceil(F.count(F.lit(1)) / EDGES).alias("parts")).withColumnRenamed("group_id", "__g")
        dealt = rows.join(sizes, F.col("group_id") == F.col("__g")).withColumn("__part", F.pmod(F.xxhash64("u", "v"), F.col("parts")))
        rows = materialize(dealt.groupBy("group_id", "__part").applyInPandas(lambda part: tree(part[["group_id", "u", "v", "weight"]]), rows.schema), "forest")
        left = rows.groupBy("group_id").count().agg(F.max("count")).first()[0]
        if left > 0.9 * largest:
            break
        largest = left
    return rows.groupBy("group_id").applyInPandas(tree, rows.schema)
