"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import checkpoint


def connected_components(links: DataFrame) -> DataFrame:
    """`links` has two long columns a and b; returns (node, root) for each node with a link, root the component's least node.

    Each round replaces links by links to the least neighbour (first for neighbours above a node, then for those below).
    Only minima are aggregated and joined back, so a node with very many neighbours is no group in one task: its links are
    one side of a join that adaptive execution can split. Rounds end when the links no longer change; every round is
    written to the shared checkpoint folder. Self links and repeated links are allowed; no links give no rows.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = checkpoint(links)
    before = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select("v", "v")).distinct()
        before = now
        links = checkpoint(_small_star(_large_star(links)))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """All links lead from a node u to a lesser one v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", "m")).distinct()
