"""Connected components: forests of blocks of edges, then alternating large-star / small-star rounds over what links the blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.lineage import cut, forget, stored
from tessera.plans.skew import fits, split_join

#: Edges up to which the minima of their nodes are broadcast. Each round sends two such tables, and the driver holds them until they
#: are cleaned: some MB each.
EDGES = 50_000
#: Edges of a block, whose forest a task finds in memory (some 100 bytes an edge).
BLOCK = 1 << 20


def _sum_of(edges: DataFrame) -> tuple:
    """Number of edges and a sum of their hashes: equal when nothing has changed."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _to_minimum(edges: DataFrame, low: DataFrame, n_edges: int) -> DataFrame:
    """edges with the minimum of their u. There are at most two nodes an edge, so that few edges mean a small broadcast."""
    if n_edges <= EDGES:
        return edges.join(F.broadcast(low.drop("n")), "u")
    return split_join(edges, cut(low), "u", "n", 2 * EDGES)


def block_roots(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of the component of each of n nodes that the edges x-y connect."""
    root = np.arange(n)
    while len(x):
        a, b = root[x], root[y]
        apart = a != b
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))  # roots only: each follows the smallest of its smaller neighbours
        while (root != (up := root[root])).any():
            root = up
    return root


def _forest(edges: DataFrame) -> DataFrame:
    """(u, v): links that connect what the edges connect. Each block of edges of a partition is replaced by links of its nodes to the
    smallest of their component there, one a node, so that there are never more; nodes of self-loops only are linked to themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= BLOCK:
                yield from block(held)
                held, n = [], 0
        if n:
            yield from block(held)

    def block(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = pa.Table.from_batches(held).columns
        both = pa.chunked_array([*u.chunks, *v.chunks])
        names = pc.unique(both)
        names = names.take(pc.sort_indices(names))  # strings by their bytes, as Spark orders them
        at = pc.index_in(both, names).to_numpy()
        x, y = at[: len(u)], at[len(u) :]
        root = block_roots(x, y, len(names))
        keep = np.union1d(np.nonzero(root != np.arange(len(names)))[0], x[x == y])
        yield from pa.table([names.take(pa.array(keep)), names.take(pa.array(root[keep]))], names=["u", "v"]).to_batches(max_chunksize=1 << 16)

    return edges.mapInArrow(run, edges.schema)


def _contracted(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of links (u, v) from `_forest`: (node, r), a row a node, its smallest v; and the edges (u, v) between those v that have nodes in
    common, which are all that is left to connect. A node has at most a link a block, so that no window is large."""
    rows = links.union(links.select("v", "v").distinct())
    w = W.partitionBy("u").orderBy("v")
    got, _ = stored(rows.select("u", "v", F.row_number().over(w).alias("i"), F.first("v").over(w).alias("r")), "contracted")
    return got.where("i = 1").select(F.col("u").alias("node"), "r"), got.where("v <> r").select(F.col("v").alias("u"), F.col("r").alias("v"))


def _named(nodes: DataFrame, comp: DataFrame) -> DataFrame:
    """(node, component) of nodes (node, r): the component that comp (node, component) gives to r, else r."""
    comp = cut(comp.select(F.col("node").alias("r"), "component"))
    if not fits(comp, 2 * EDGES):  # all r with their numbers of nodes, so that those of many nodes are dealt
        comp = cut(nodes.groupBy("r").agg(F.count("*").alias("n")).join(comp, "r", "left"))
        out = split_join(nodes, comp, "r", "n", 2 * EDGES)
    else:
        out = nodes.join(F.broadcast(comp), "r", "left")
    return out.select("node", F.coalesce("component", "r").alias("component"))


def _starred(e: DataFrame, max_rounds: int) -> DataFrame:
    """(node, component) for every node of the edges (u, v), without loops, by star rounds."""
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = cut(e.select("u").union(e.select(F.col("v"))).distinct())
    before = _sum_of(e)
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _to_minimum(both.where("v > u"), low, before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        if before[0] > EDGES:
            large = cut(large)
        low2 = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _to_minimum(large, low2, before[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = _sum_of(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    label = e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
    return nodes.join(label, nodes.u == label.k, "left").select(F.col("u").alias("node"), F.coalesce("m", "u").alias("component"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges; component is the smallest node reachable.

    Blocks of edges become forests where they lie. While many links are left, those that share nodes are put together by ranges
    of keys, and nodes give way to the smallest node that a block links them to: only the links of such nodes go on. What
    that leaves is connected in rounds, which link nodes to smaller neighbours (large star), then to the smallest (small star); the
    number of rounds grows with the logarithm of the longest path. Nodes are only ever aggregated with a map-side min or by
    block, never gathered, and minima are joined back apart for nodes of many edges, so that none of them is one task.
    Tables between the steps are Parquet and are removed as soon as the next is written.
    Null ends and self-loops are dropped. Raises if it has not converged after max_rounds.
    """
    spark = edges.sparkSession
    a, b = F.col(src), F.col(dst)
    links, path = stored(_forest(edges.where(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))), "forest")
    n, levels = links.count(), []
    while n > EDGES:
        near, near_path = stored(_forest(links.repartitionByRange("u", "v")), "forest")
        forget(spark, path)
        nodes, left = _contracted(near)
        levels.append(nodes)
        forget(spark, near_path)
        links, path = stored(_forest(left), "forest")
        before, n = n, links.count()
        if n * 2 > before:
            break
    out = _starred(links.where("u <> v"), max_rounds)
    if not levels:
        loops = links.where("u = v").select(F.col("u").alias("node")).distinct()
        return out.union(loops.join(out, "node", "left_anti").select("node", "node"))
    forget(spark, path)
    for nodes in reversed(levels):
        out = _named(nodes, out)
    return out
