"""Connected components of a graph of links, by stars that shrink to their smallest node."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import durable, join_spread

MAX_STEPS = 100
#: Up to so many links, of 16 bytes each, one task works the components out; more go through steps of all tasks.
LINKS_AT_ONCE = 1 << 20


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first())


def _at_once(batches):
    """(node, component) of the links of all batches, whose number has been counted."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = top(root.setdefault(a, a)), top(root.setdefault(b, b))
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = np.fromiter(root, np.int64, len(root))
    for at in range(0, len(nodes), 1 << 16):
        part = nodes[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([top(x) for x in part.tolist()], pa.int64())], ["node", "component"])


def components(links: DataFrame, links_at_once: int = LINKS_AT_ONCE) -> DataFrame:
    """(node, component) of every node of the links (a, b), the component being the smallest node that can be reached.

    Each step links the larger neighbours of a node to its smallest one, then the smaller ones, until only stars are
    left; that takes about the logarithm of the longest path. Links may repeat and run either way; a link of a node with
    itself, or with null, counts for nothing. Smallest neighbours are minima, which tasks form before rows move. Links
    are counted first, and few enough are worked out by one task, with the same result.
    """
    a, b = F.col("a"), F.col("b")
    edges = durable(links.filter("a is not null and b is not null and a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")))
    if edges.count() <= links_at_once:
        return edges.coalesce(1).mapInArrow(_at_once, "node long, component long")
    edges, before = durable(edges.distinct()), None
    for _ in range(MAX_STEPS):
        now = _state(edges)
        if now == before or not now[0]:
            return edges.select(a.alias("node"), b.alias("component")).unionByName(edges.select(b.alias("node"), b.alias("component")).distinct())
        before = now
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = durable(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = join_spread(both.filter("b > a"), least, ["a"]).select(b.alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = durable(large)
        least = durable(large.groupBy("a").agg(F.min("b").alias("m")))
        joined = join_spread(large, least, ["a"])
        small = joined.filter("b <> m").select(b.alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = durable(small.distinct())
    raise RuntimeError(f"components took over {MAX_STEPS} steps")
