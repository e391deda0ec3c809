"""Bootstrap replicates that draw exactly as many rows as a group has, with replacement.

A group's rows stand in a seeded order, in blocks of at most BLOCK. How many of a replicate's n draws fall on a block is
split down a tree: at each node the draws of a span of blocks are dealt to its halves, binomially by the rows that these
have, by a seeded number that every block can work out for itself. A block then makes its own draws among its rows. So
counts add up to n in every replicate, a replicate's sum is a sum over blocks, and no task holds a group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.seeded import digest, draw
from .order import placed

#: Rows of a block. Only spans of more draws than this are dealt to halves: there, with chances near one half, a binomial
#: number and a rounded normal one differ by far less than their spread.
BLOCK = 4096


def _normal(seed: int, *key: Column) -> Column:
    """A number of the standard normal law from the key."""
    u = lambda j: (draw(F.lit(10**9), seed, *key, F.lit(j)) + 0.5) / 1e9
    return F.sqrt(-2 * F.log(u("u"))) * F.cos(2 * math.pi * u("v"))


def block_draws(n: Column, block: Column, seed: int, *key: Column) -> Column:
    """How many of the ``n`` draws of the replicate with this key fall on the block."""
    blocks = F.ceil(n / BLOCK)
    long = lambda c: c.cast("long")
    start = F.struct(F.lit(0).cast("long").alias("lo"), long(blocks).alias("hi"), long(n).alias("c"))

    def halve(s: Column, _: Column) -> Column:
        lo, hi, c = s["lo"], s["hi"], s["c"]
        mid = long(F.floor((lo + hi) / 2))
        size = F.least(hi * BLOCK, n) - lo * BLOCK
        share = (mid - lo) * BLOCK / size
        left = F.round(c * share + _normal(seed, *key, lo, hi) * F.sqrt(c * share * (1 - share)))
        left = long(F.greatest(F.lit(0.0), F.least(c.cast("double"), left)))
        here = block < mid
        halves = F.struct(F.when(here, lo).otherwise(mid).alias("lo"), F.when(here, mid).otherwise(hi).alias("hi"), F.when(here, left).otherwise(c - left).alias("c"))
        return F.when(hi - lo > 1, halves).otherwise(s)

    depth = F.when(blocks > 1, F.sequence(F.lit(1), F.ceil(F.log2(blocks.cast("double"))).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(depth, start, halve)["c"]


def replicate_means(rows: DataFrame, by: list[str], value: str, order: list[str], samples: int, seed: int) -> DataFrame:
    """Mean of each of ``samples`` replicates of each group, and how many rows were ``drawn``: as many as the group has.

    ``order`` are the key columns of a row. Nulls don't count; a group of nulls alone has no replicates. Rows that agree in
    their keys are rows like others.
    """
    held = rows.where(F.col(value).isNotNull()).select(F.to_json(F.struct(*(F.col(c) for c in by))).alias("_g") if by else F.lit("").alias("_g"), *by, digest(seed, *map(F.col, order)).alias("_h"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.col(value).cast("double").alias("_v"))
    at = placed(held, ["_g", "_h", *(f"_o{i}" for i in range(len(order)))], "_at")
    spans = at.groupBy("_g").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    met = at.join(spans, "_g").withColumn("_i", F.col("_at") - F.col("_first")).withColumn("_block", F.floor(F.col("_i") / BLOCK))
    values = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"])
    blocks = met.groupBy("_g", *by, "_n", "_block").agg(values.alias("_values"))
    each = blocks.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    name = [F.col(c) for c in [*by, "b"]]
    each = each.withColumn("_c", block_draws(F.col("_n"), F.col("_block"), seed, *name))
    taken = F.when(F.col("_c") > 0, F.sequence(F.lit(1).cast("long"), F.col("_c"))).otherwise(F.array().cast("array<long>"))
    one = lambda k: F.element_at("_values", (draw(F.size("_values"), seed, *name, F.col("_block"), k) + 1).cast("int"))
    sums = each.select(*by, "_g", "b", "_c", F.aggregate(taken, F.lit(0.0), lambda s, k: s + one(k)).alias("_s"))
    total = sums.groupBy("_g", *by, "b").agg(F.sum("_s").alias("_s"), F.sum("_c").alias("drawn"))
    return total.select(*by, "b", (F.col("_s") / F.col("drawn")).alias("mean"), "drawn")
