"""Connected components of links: a forest for each task's share of them, then alternating star rounds of joins and minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, written

#: Links that a task ties at once. Tasks are as many as the links ask for, so that few links aren't dealt to hundreds of files.
LINKS_A_TASK = 1 << 16


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the ends of each link the smaller of their labels, until every link agrees."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        if not len(a):
            return
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label[:] = jumped


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a task's links tied to the smallest one that it reaches by them; so many links at once that memory is bounded."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def tied() -> pa.RecordBatch:
        u, v = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)  # ascending, so the smallest place is the smallest node
        label = np.arange(len(nodes))
        unite(label, at[: len(u)], at[len(u) :])
        leaf = label != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(nodes[label[leaf]])], ["u", "v"])

    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        if sum(len(u) for u, _ in held) >= 4 * LINKS_A_TASK:
            yield tied()
    if held:
        yield tied()


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; a component is named by its smallest node.

    The links are dealt to tasks by their number, and each task gives a forest of its share; one task's forest of all is the
    result. Then each round ties every larger neighbour of a node to the node's smallest neighbour (large star),
    then every smaller one (small star). Only minima are gathered per node, so a node with very many
    neighbours needs no more memory than others. It ends when a round changes nothing; links of
    nulls and of a node to itself say nothing and are left out.
    """
    ends = [f("a", "b").cast("long").alias(c) for f, c in ((F.greatest, "u"), (F.least, "v"))]
    links = written(edges.filter("a != b").select(*ends).distinct())
    tasks = -(-links.count() // LINKS_A_TASK) or 1
    links = cut(links.repartition(tasks).mapInArrow(_forest, "u long, v long"))
    release(links.sparkSession)
    before = _signature(links)
    while before[0] and tasks > 1:  # one task has seen all links
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("w").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("w"))
        small = large.join(least, "u").filter("v != w").select(F.col("v").alias("u"), F.col("w").alias("v"))
        links = cut(small.union(least.select("u", F.col("w").alias("v"))).distinct().coalesce(tasks))
        release(links.sparkSession)
        after = _signature(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
