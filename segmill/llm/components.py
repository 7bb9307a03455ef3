"""Connected components of a large graph by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.session import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge to another; root is the least node.

    Each round lets every node hand its neighbours the least node it knows, first
    to the larger neighbours, then to the smaller ones. Only least values per node
    are grouped, so a node with many edges is an aggregate with map-side combining
    and a join that can be split. Rounds are written to the shared folder; the
    number of rounds grows with the logarithm of the graph. Null nodes have no
    edges; an empty graph gives an empty table.
    """
    one = F.col(a)
    two = F.col(b)
    current = (
        edges.where(one != two)
        .select(F.greatest(one, two).alias("u"), F.least(one, two).alias("v"))
        .distinct()
    )
    current = materialize(current, "graph")
    state = _fingerprint(current)
    while True:
        current = materialize(_small_star(_large_star(current)), "graph")
        after = _fingerprint(current)
        if after == state:
            break
        state = after
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.join(least, "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from the larger node ``u`` to the smaller ``v``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    handed = edges.join(least, "u").where(F.col("v") != F.col("m")).select(
        F.col("v").alias("u"), F.col("m").alias("v")
    )
    return handed.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
