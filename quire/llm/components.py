"""Connected components by alternating large and small stars, over edge tables.

Each step takes a minimum per node, pre-aggregated before its shuffle, and joins it back; a node
with very many edges has one row on the join's other side, so the join can be split.  The edges are
written to the shared folder each round.  Defined cases: loops and repeated edges change nothing;
null ends are dropped; without edges there are no components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import dropped, staged


#: Edges in a file; a round never has more edges than the one before, so small ones are few tasks.
ROWS = 200_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge to another; component is its least node."""
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    e, seen = staged(e, "edges"), None
    while (now := _state(e)) != seen:
        seen, files = now, now[0] // ROWS + 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .filter("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        before, e = e, staged(small.coalesce(files), "edges")
        dropped(before)
    roots = e.select("v").distinct().coalesce(now[0] // ROWS + 1)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
