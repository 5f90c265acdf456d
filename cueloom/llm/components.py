"""Connected components of a link table by alternating large and small stars.

Each round rewires edges towards smaller nodes. A star is one shuffle by node and one
pass over the sorted rows, of which only the node at hand and its smallest neighbour
are held, so a hub of any size needs no memory. Lineage is cut after each round.
Nothing is collected but two numbers a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_batches


def _star(small: bool):
    """Rows (u, v) sorted by both: u's smallest neighbour m (or u itself) gets the edges of u.

    A large star links the neighbours above u to m; a small star, whose rows are all
    towards smaller nodes, links the others and u.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, int] | None = None  # u, m, v of the row before
        for b in batches:
            if not b.num_rows:
                continue
            u, v = b.column(0).to_numpy(), b.column(1).to_numpy()
            first = np.empty(len(u), dtype=bool)
            first[1:] = u[1:] != u[:-1]
            first[0] = last is None or u[0] != last[0]
            again = np.zeros(len(u), dtype=bool)
            again[1:] = ~first[1:] & (v[1:] == v[:-1])
            again[0] = not first[0] and v[0] == last[2]
            at = np.maximum.accumulate(np.where(first, np.arange(len(u)), -1))
            low = np.where(at >= 0, v[at], last[1] if last else 0)
            m = np.minimum(u, low)
            last = int(u[-1]), int(low[-1]), int(v[-1])
            keep = ~again & ((v != m) if small else (v > u) & (v != m))
            out_u, out_v = v[keep], m[keep]
            if small:
                out_u, out_v = np.append(out_u, u[first]), np.append(out_v, m[first])
            if len(out_u):
                yield pa.RecordBatch.from_arrays([pa.array(out_u), pa.array(out_v)], names=["u", "v"])

    return run


def _dealt(edges: DataFrame, small: bool) -> DataFrame:
    # no number of partitions is given, so that few edges run in few tasks
    return edges.repartition("u").sortWithinPartitions("u", "v").transform(in_batches, _star(small), "u long, v long")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _dealt(_dealt(both, False), True)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; the root is the smallest node reachable."""
    edges = links.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
    state: tuple = ()
    while True:
        edges = cut(_round(edges), few=True)
        before, state = state, _state(edges)
        if not state[0] or before == state:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
