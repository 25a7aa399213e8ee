"""Connected components of a link table, without gathering any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import Work


def _fold(edges: DataFrame, large: bool) -> DataFrame:
    """Large-star (link each greater neighbour to the least of all) or small-star (each smaller one, and the node itself)."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))  # (node, neighbour)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    least = edges.groupBy("a").agg(F.min("b").alias("least"))  # a > b in every edge
    return edges.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("least").alias("b")), F.struct("a", F.col("least").alias("b")))).alias("e")).select("e.*")


def components(links: DataFrame, work: Work, name: str = "components") -> DataFrame:
    """(node, component) of all nodes with a link; a component is named by its least node.

    ``links`` has two columns of one orderable type. Large-star and small-star take turns until nothing
    changes: then every node links to its component's least one (Kiveris et al. 2014). Each turn is written
    to the shared folder; a node with any number of links costs it one aggregated row a partition.
    """
    x, y = links.columns
    edges = links.where(F.col(x) != F.col(y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    edges, seen, turn = work.save(edges, f"{name}-0"), None, 0
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if state == seen or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen, turn = state, turn + 1
        star = _fold(edges, large=True).where("a <> b").distinct()
        edges = work.save(_fold(star, large=False).where("a <> b").distinct(), f"{name}-{turn}")
        work.drop(f"{name}-{turn - 1}")
