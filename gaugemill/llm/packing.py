"""Batches of similar lengths: bucket boundaries of least padding, and a token budget for each batch.

The exact histogram of lengths over all documents is the only thing that reaches the driver: k distinct lengths take
k * k / 2 tokens at least, so it has at most the square root of twice the corpus' tokens as rows (100 TB: some millions,
of 16 bytes), and as many as the longest text has tokens. A dynamic programme over it picks the boundaries.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch
from .sharding import numbered

BUCKETS, BUDGET = 16, 65_536


def length():
    """Tokens of a text: its words, and one end; null is empty."""
    return F.size(F.expr(r"filter(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), w -> w <> '')")) + 1


def boundaries(top: np.ndarray, count: np.ndarray, buckets: int) -> list[int]:
    """The upper ends of at most so many buckets, with the least padding when each text is filled up to its end.

    ``top`` are the lengths in order. The best cut for a longer prefix never lies further left, so each round of the
    programme is solved by halving, all halves of a level at once: lengths times their logarithm, in whole numbers.
    """
    n = len(top)
    if not n:
        return []
    top, cumulated = top.astype(np.int64), np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    best = np.concatenate([[0], top * cumulated[1:]])  # tokens of the first lengths, filled up to the last of them
    cuts = []
    for _ in range(1, min(buckets, n)):
        now, cut = best.copy(), np.zeros(n + 1, np.int64)
        lo, hi, left, right = (np.array([v]) for v in (1, n, 0, n))
        while len(lo):
            mid = (lo + hi) // 2
            size = np.minimum(mid - 1, right) - left + 1
            ends = np.cumsum(size)
            i = np.arange(ends[-1]) + np.repeat(left - (ends - size), size)
            value = best[i] + np.repeat(top[mid - 1], size) * (np.repeat(cumulated[mid], size) - cumulated[i])
            least = np.minimum.reduceat(value, ends - size)
            hits = np.flatnonzero(value == np.repeat(least, size))
            at = i[hits[np.searchsorted(hits, ends - size)]]
            now[mid], cut[mid] = least, at
            lo, hi, left, right = (np.stack(p, 1).ravel() for p in ((lo, mid + 1), (mid - 1, hi), (left, at), (at, right)))
            open_ = lo <= hi
            lo, hi, left, right = lo[open_], hi[open_], left[open_], right[open_]
        if now[n] >= best[n]:
            break
        best = now
        cuts.append(cut)
    ends, j = [], n
    for cut in reversed(cuts):
        ends.append(int(top[j - 1]))
        j = int(cut[j])
        if j == 0:
            break
    if j:
        ends.append(int(top[j - 1]))
    return sorted(ends)


def pack(documents: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Per row doc_id, n_tokens, bucket (int, from 0), padded (the bucket's length), batch (long, from 0 in each bucket)
    and slot (int, in the batch).

    A batch holds as many rows as fit the budget when filled up, one at least: a text beyond the budget is alone and
    whole. Null and empty texts have one token. Repeated rows are packed like others; rows of one length are taken by id.
    """
    scratch = Scratch(documents.sparkSession, "packing")
    rows = scratch.save(documents.select("doc_id", length().cast("long").alias("n_tokens")), "lengths")
    bins = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").toArrow()
    ends = boundaries(bins.column("n_tokens").to_numpy(), bins.column("n").to_numpy(), buckets)
    table = F.array(*map(F.lit, ends)).cast("array<long>") if ends else F.array(F.lit(0)).cast("array<long>")
    bucket = F.size(F.filter(table, lambda e: e < F.col("n_tokens")))
    placed = rows.withColumn("bucket", bucket).withColumn("padded", F.get(table, F.col("bucket")))
    at = numbered(placed, "bucket", ["n_tokens", "doc_id"], "_at")
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("padded"))).cast("long")
    return at.select("doc_id", "n_tokens", "bucket", "padded", F.floor(F.col("_at") / each).cast("long").alias("batch"), (F.col("_at") % each).cast("int").alias("slot"))
