"""Connected components of an edge table by alternating large-star and small-star steps, all in joins and partial aggregates.

Every step is over edges alone, often few against the session's shuffle partitions. So stages read the shuffled
partitions in as few tasks as keep about ROWS edges in each; the number follows the count of edges, and a large table
keeps all its partitions. A table of at most ROWS edges, which is one task's share, is united in that task at once: steps of many
small jobs would cost the driver memory and time. The centre of a large star is a hot key: its edges are not gathered, its least neighbour goes to them.

Defined results: edges with a null end and loops are left out; repeated edges and either direction count once; an empty
table gives an empty result; ends that are the least of their component have no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted, release

ROWS = 100_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large(edges: DataFrame, tasks: int, total: int) -> DataFrame:
    """Every neighbour above a node is led to the least of the node and its neighbours."""
    around = _both(edges)
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return join_counted(around.where("v > u"), least, "u", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks)


def _small(edges: DataFrame, tasks: int, total: int) -> DataFrame:
    """A node and its neighbours below it are led to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_counted(down, least, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").coalesce(tasks).distinct().coalesce(tasks)


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node leads to one centre and no centre leads on."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("leads"), F.lit(0).alias("led")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("id").agg(F.sum("leads").alias("leads"), F.max("led").alias("led"))
    return nodes.agg(F.count_if((F.col("leads") > 1) | ((F.col("leads") > 0) & (F.col("led") > 0)))).first()[0] == 0


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, root) of all edges: roots are led to the least root that an edge joins them to, until no edge joins two."""
    ends = [np.stack([np.asarray(b.column(c)) for c in ("u", "v")]) for b in batches if b.num_rows]
    if not ends:
        return
    ids, at = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    up = np.arange(len(ids))
    while (up[a] != up[b]).any():
        x, y = up[a], up[b]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]
    led = np.flatnonzero(up != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[led]), pa.array(ids[up[led]])], names=["u", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(u, v), both long -> (u, root): for each end that is not the least of its component, that least."""
    edges = cut(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v"))
    while True:
        total = edges.count()
        if total <= ROWS:
            return edges.coalesce(1).mapInArrow(_united, "u long, root long")
        tasks = 1 + total // ROWS
        led = cut(_large(edges, tasks, total))
        found = cut(_small(led, tasks, total))
        release(edges, led)
        edges = found
        if _is_stars(edges):
            return edges.select("u", F.col("v").alias("root"))
