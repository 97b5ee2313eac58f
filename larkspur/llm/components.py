"""Connected components: each task replaces its links by a spanning forest of them; what one task cannot hold
is joined by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import claim_worker, release_shuffles

#: Links that a task holds at once (two numbers each). Up to this checked number one task joins the forests of all others;
#: beyond it star steps do, each of some 15 stages.
LINKS = 1 << 20
#: A node with more links than this, and than one in HUBS of all links, is a hub. There are at most 2 * HUBS of them.
HUB_LINKS, HUBS = 1000, 50_000


def lowest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a, b), and for each the smallest node reachable."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        # Roots are hooked to smaller roots that they are linked with, then all paths are shortened to their roots.
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while not np.array_equal(root, up := root[root]):
            root = up
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    return nodes, nodes[root]


def _forest(links: DataFrame, most: int, roots: bool = False) -> DataFrame:
    """Links (a, b) from each node to the smallest that its task's links lead to; with `roots` those link to themselves.

    A task that has more than `most` links gives the forests of several blocks of them, if one forest does not shrink.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("components")

        def joined(held: list[pa.RecordBatch], roots: bool = False) -> pa.RecordBatch:
            nodes, low = lowest_reachable(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b")))
            own = slice(None) if roots else nodes != low
            return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(low[own])], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) > most:
                held = [joined(held)]
                if 2 * held[0].num_rows > most:
                    yield held.pop()
        if held:
            yield joined(held, roots)

    return links.mapInArrow(run, "a long, b long")


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """One star step over n links (a, b) with a > b; each node's lowest neighbour takes over its other links.

    Links of hubs stay where they are and find their lowest neighbour in a broadcast of the hubs, so no task
    gets all links of one node.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count(F.lit(1)).alias("n"))
    most = max(HUB_LINKS, n // HUBS)
    hubs = F.broadcast(lowest.where(F.col("n") > most).select("a", "low"))
    rest = both.join(hubs.select("a"), "a", "left_anti").join(lowest.where(F.col("n") <= most).select("a", "low"), "a")
    met = both.join(hubs, "a").select("a", "b", "low").unionByName(rest.select("a", "b", "low"))
    if large:
        moved = met.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = met.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(lowest.select("a", F.col("low").alias("b")))
    return moved.where("a > b").distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link in (a, b).

    Links may come in any direction, repeated, and with loops. The tasks' forests are written to the shared checkpoint
    folder. Up to LINKS links, one more task joins them; beyond, star steps do: each round writes its links there,
    so lost executors cost one round at most, and rounds grow with the logarithm of the longest chain.
    """
    most = LINKS
    edges = _forest(links.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a > b"), most).checkpoint()
    if edges.count() <= most:
        return _forest(edges.coalesce(1), most, roots=True).toDF("node", "component")
    edges = edges.distinct().checkpoint()
    state = lambda: edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = state()
    for _ in range(max_rounds if seen[0] else 0):
        edges = _star(edges, True, seen[0]).checkpoint()
        edges = _star(edges, False, seen[0]).checkpoint()
        before, seen = seen, state()
        release_shuffles(links.sparkSession)
        if before == seen:
            break
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
