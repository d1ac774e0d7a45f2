"""Connected components of links between long ids, by alternating stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import cut_observed

#: Tells whether two rounds hold the same links.
SIGNATURE = {"n": "count(*)", "hashes": "coalesce(sum(xxhash64(u, v) % 1099511627776), 0)"}


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u > v): larger neighbours, or the node and its smaller ones, are tied to the least of them.

    The least neighbour of a node is a partial aggregate, so a hub costs its task one row; the join that hands it to the
    hub's neighbours is a plain one that Spark splits when it is skewed.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = both.join(least, "u")
    if large:
        tied = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        tied = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return tied.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``edges`` (u, v) reaches. Self-links and repeats do no harm."""
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    edges, before = cut_observed(edges, SIGNATURE)
    while before["n"]:
        edges, after = cut_observed(_stars(_stars(edges, True), False), SIGNATURE)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
