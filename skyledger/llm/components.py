"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Relink each node's neighbours to the least of them (and itself)."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    told = both.join(least, "u")
    if large:
        out = told.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = told.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node`` and ``root`` (its component's least node) for each node of ``edges`` (u, v).

    Each step is a minimum per node (combined ahead of the shuffle) and a join;
    a node with very many links is split by AQE's skew handling. Steps are
    written to the shared folder; their number grows with the logarithm of the
    longest path. Self links and repeated links are fine.
    """
    edges = store.written(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = _state(edges)
    while before[0]:
        edges = store.written(_star(_star(edges, True), False), name)
        after = _state(edges)
        if after == before:
            break
        before = after
    # at rest every edge leads from a node to its root
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
