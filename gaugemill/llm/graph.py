"""Connected components of link tables by repeated star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "stars", most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node.

    Each round hangs the larger neighbours of a node on its smallest one, then what is smaller likewise, so the number
    of rounds grows with the logarithm of the longest path. A round is a saved table; a hub's links are combined before
    each shuffle and its join can be split.
    """
    edges = scratch.save(_down(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), f"{name}0")
    before = None
    for n in range(1, most_rounds + 1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        edges = scratch.save(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}{n}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n > 1:
            scratch.drop(f"{name}{n - 2}")
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components aren't settled after {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("node")))


def _down(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
