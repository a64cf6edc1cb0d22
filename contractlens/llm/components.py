"""Connected components of a graph given as a table of edges.

Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce
and Beyond"), after a local union-find that leaves at most a spanning forest of each partition.
Every round is written to the shared folder, which cuts lineage; only two numbers a round come to
the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractlens.llm.common import Scratch


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component), for nodes that are not the smallest."""
    if not len(a):
        return a, b
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        open_ = rx != ry
        if not open_.any():
            break
        x, y, rx, ry = x[open_], y[open_], rx[open_], ry[open_]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while True:  # halve the paths until they are flat
            up = root[root]
            if (up == root).all():
                break
            root = up
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a = b = np.zeros(0, dtype=np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)])
        b = np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(a) > 1 << 20:
            a, b = forest(a, b)
    a, b = forest(a, b)
    for i in range(0, len(a), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(a[i : i + (1 << 16)]), pa.array(b[i : i + (1 << 16)])], ["u", "v"])


def _minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written, so that the join has shuffles of its own, whose large partitions Spark splits
    least = scratch.table(_minimum(both).select("u", F.least("u", "m").alias("m")), f"least{k}")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = _minimum(down)
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: two long columns.  Returns (u, v): each node but the smallest of a component, and that smallest node.

    No edges: an empty table.  Nulls, loops and repeated edges are ignored.
    """
    a, b = edges.columns[:2]
    clean = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v")
    now = scratch.table(clean.mapInArrow(_local, "u long, v long"), "edges0")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    was, k = state(now), 0
    if not was[0]:
        return now
    while True:
        k += 1
        now = scratch.table(_small_star(_large_star(now, scratch, k)), f"edges{k}")
        got = state(now)
        scratch.drop(f"edges{k - 1}")
        scratch.drop(f"least{k}")
        if got == was:
            return now
        was = got
