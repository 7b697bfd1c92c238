"""Connected components of links between ids, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """``(a, b)`` long ids, in any order and repeated at will -> ``(id, component)``.

    The component is the smallest id reachable. Only ids with a link to another id are
    returned. Rounds are kept in the shared folder; their number grows with the
    logarithm of the longest chain. A node with very many links is met by partial minima and
    by joins that the adaptive planner can split.
    """
    pairs = links.where(F.col("a") != F.col("b"))
    edges = stored(
        pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = _state(edges)
    while True:
        # Large star: each node links its larger neighbours to the smallest of all. The smallest are
        # written before the join: then both its sides are plain shuffles, which the adaptive planner
        # splits where a node has very many links.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = stored(
            both.join(least, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct(),
            "large-star",
        )
        # Small star: each node links its smaller neighbours, and itself, to the smallest.
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = stored(small.where(F.col("u") != F.col("v")).distinct(), "edges")
        new = _state(edges)
        if new == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = new


def _state(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges: their number, and a sum over their hashes."""
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h)).first())
