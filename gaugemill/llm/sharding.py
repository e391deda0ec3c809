"""Shards of nearly equal bytes, by Karmarkar-Karp differencing of groups that must stay together.

A group is all rows with one text. Groups are dealt into blocks; in a block, partial partitions of the wanted number of
parts are combined, always the two with the largest spread, the one's largest part with the other's smallest, until one
is left. The blocks' partitions, and then those of blocks of blocks, are combined in the same way, so no task sees more
than a bounded number of items, and the differences that are left shrink at every level.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .scratch import Scratch

SHARDS = 40
#: Groups in a block, and partial partitions that one task combines.
BLOCK_ITEMS, FAN_IN = 8192, 512
#: Rows of a shard that one task numbers.
NUMBERED_ROWS = 100_000


def difference(sums: np.ndarray) -> np.ndarray:
    """For partial partitions (a row each, with the sums of its parts), the part of the result that each part goes to."""
    n, parts = sums.shape
    if n == 0:
        return np.zeros((0, parts), np.int64)
    trees: dict[int, tuple] = {}
    heap = []
    for i in range(n):
        order = np.argsort(-sums[i], kind="stable")
        value = sums[i][order]
        trees[i] = (None, None, order, None)
        heap.append((-(int(value[0]) - int(value[-1])), i, value))
    heapq.heapify(heap)
    following = n
    while len(heap) > 1:
        _, i, x = heapq.heappop(heap)
        _, j, y = heapq.heappop(heap)
        value = x + y[::-1]
        order = np.argsort(-value, kind="stable")
        trees[following] = (i, j, order, None)
        value = value[order]
        heapq.heappush(heap, (-(int(value[0]) - int(value[-1])), following, value))
        following += 1
    out = np.empty((n, parts), np.int64)
    stack = [(heap[0][1], np.arange(parts))]
    while stack:
        node, place = stack.pop()
        i, j, order, _ = trees.pop(node)
        inner = np.empty(parts, np.int64)
        inner[order] = place  # where the parts before sorting go
        if i is None:
            out[node] = inner
        else:
            stack += [(i, inner), (j, inner[::-1])]
    return out


def _combine(pdf: pd.DataFrame, parts: int) -> pd.DataFrame:
    """One row of sums for each item; adds the part that each part of an item goes to, and the block's own sums."""
    pdf = pdf.sort_values("item", kind="stable")
    sums = np.array([list(s) for s in pdf["sums"]], np.int64).reshape(len(pdf), -1)
    if sums.shape[1] < parts:
        sums = np.concatenate([sums, np.zeros((len(pdf), parts - sums.shape[1]), np.int64)], 1)
    to = difference(sums)
    total = np.zeros(parts, np.int64)
    np.add.at(total, to.ravel(), sums.ravel())
    pdf = pdf[["block", "item"]].copy()
    pdf["to"] = list(to)
    pdf["total"] = [total] + [None] * (len(pdf) - 1)
    return pdf


def groups(documents: DataFrame) -> DataFrame:
    """Every row's id, size, checksum and group; the text itself goes no further. A null text is taken as empty."""
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("grp"))


def assign(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row doc_id, size, text_crc32, shard, and slot: its number in the shard, gapless from 0.

    Equal texts share a shard. A group larger than a shard's even share makes that shard larger and the others stay
    even. Repeated rows are rows like others; order among rows with equal ids is by checksum, and equal rows are alike.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "shards")
    rows = scratch.save(groups(documents), "rows")
    sized = scratch.save(rows.groupBy("grp").agg(F.sum("size").alias("bytes")), "groups")
    n = sized.count()
    blocks = max(1, math.ceil(n / BLOCK_ITEMS))
    schema = "block long, item string, to array<long>, total array<long>"
    combine = lambda pdf: _combine(pdf, shards)
    items = sized.select(F.expr(f"cast(pmod(xxhash64(grp), {blocks}) as long)").alias("block"), F.col("grp").alias("item"), F.array("bytes").alias("sums"))
    done = scratch.save(items.groupBy("block").applyInPandas(combine, schema), "level0")
    part = done.select("item", "block", F.get("to", F.lit(0)).alias("part"))
    level = 0
    while blocks > 1:
        level += 1
        up = max(1, math.ceil(blocks / FAN_IN))
        items = done.where("total is not null").select(F.expr(f"block % {up}").alias("block"), F.col("block").cast("string").alias("item"), F.col("total").alias("sums"))
        done = scratch.save(items.groupBy("block").applyInPandas(combine, schema), f"level{level}")
        move = done.select(F.col("item").cast("long").alias("block"), F.col("block").alias("up"), "to")
        part = part.join(move, "block").select("item", F.col("up").alias("block"), F.expr("to[part]").alias("part"))
        blocks = up
    placed = rows.join(part.select(F.col("item").alias("grp"), F.col("part").cast("int").alias("shard")), "grp").drop("grp")
    return numbered(scratch.save(placed, "placed"), "shard", ["doc_id", "text_crc32", "size"], "slot")


def numbered(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Adds each row's number within its key, gapless from 0. A key's rows are numbered piece by piece, each piece by hash
    of the order columns, so no task holds a whole key."""
    pieces = max(1, math.ceil(rows.count() / NUMBERED_ROWS))
    cut = rows.withColumn("_piece", F.expr(f"pmod(xxhash64({', '.join(order)}), {pieces})"))
    sizes = cut.groupBy(key, "_piece").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    begins = sizes.select(key, "_piece", F.coalesce(earlier, F.lit(0)).alias("_begin"))
    inner = cut.withColumn("_inner", F.row_number().over(Window.partitionBy(key, "_piece").orderBy(*order)) - 1)
    return inner.join(begins, [key, "_piece"]).withColumn(name, (F.col("_begin") + F.col("_inner")).cast("long")).drop("_piece", "_begin", "_inner")

