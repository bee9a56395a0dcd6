"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a > b. Large: each node links its larger neighbours to the least of all; small: itself and its smaller ones."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # links to larger neighbours are those in which the node is the smaller end
        out = edges.join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return out.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """Columns node and component (the least node that links reach), for all nodes in links (columns a and b, any order).

    Self links and repeated links do no harm; nulls are left out; no links give no rows.
    Each round is stored in the shared folder, and no set of nodes meets in one task: the
    least neighbour is found by partial aggregates, and joins on a node of many links are split.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    edges = staged(edges, "edges")
    before = None
    while True:
        edges = staged(_star(_star(edges, True), False), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
