"""Connected components by alternating stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored

MAX_TURNS = 60


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is tied to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of them; edges run from large to small."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links(a, b): the least id it can reach.

    Self-links give the id itself; null ends are left out. Each turn is written to
    the shared folder, so lineage stays short; the turns grow with the logarithm
    of the size of a component. A hub's neighbours are only reduced to their least
    one (partly before the shuffle) and joined back by a splittable join.
    """
    ends = links.where("a IS NOT NULL AND b IS NOT NULL")
    edges = stored(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "stars")
    for _ in range(MAX_TURNS):
        fresh = stored(_small(_large(edges)), "stars")
        same = [d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for d in (edges, fresh)]
        forget(edges)
        edges = fresh
        if same[0] == same[1]:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
