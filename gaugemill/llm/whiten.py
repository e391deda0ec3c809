"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Step j multiplies the centred rows X by a vector and the product, u_j, by X transposed, each a sum over all rows that Spark
combines; u_j is made orthogonal to all u before it and the next v to all v before it. So U'XV is upper bidiagonal, and
the singular values and right vectors of that small matrix give the components and their deviations. No u is ever kept:
each lies in the range of X, u_j = X w_j with a w_j of one row's length, so X'u_j also tells how far u_j is from
orthogonal to every u before it.

Rows are first packed: floor(64 c) in the narrowest integers that hold a block of rows, so a step reads half the table or
less. The sums of entries, and each row's deviation, are whole numbers and exact; a constant added to all entries would
change neither deviations nor coordinates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch

SCALE = 64
COMPONENTS = 32
#: Rows in a packed block.
BLOCK_ROWS = 512
#: An entry beyond this, after scaling, is taken as this: whole numbers stay exact in doubles.
LARGEST = 2**53
RESULTS = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


def usable(vector: str = "embedding") -> Column:
    """Neither null nor with a null, infinite or NaN entry."""
    c = F.col(vector)
    return F.coalesce(c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _scaled(column: pa.Array, width: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return np.clip(np.floor(SCALE * values), -LARGEST, LARGEST).astype(np.int64)


def _packed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _scaled(batch.column(0), width)
            cells, kinds = [], []
            for at in range(0, len(x), BLOCK_ROWS):
                part = x[at : at + BLOCK_ROWS]
                top = int(np.abs(part).max(initial=0))
                kind = np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.int64
                cells.append(part.astype(kind).tobytes())
                kinds.append(np.dtype(kind).itemsize)
            yield pa.RecordBatch.from_pydict({"kind": pa.array(kinds, pa.int32()), "cells": pa.array(cells, pa.binary())})

    return run


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        kinds, cells = batch.column(0).to_numpy(), batch.column(1)
        for i in range(batch.num_rows):
            yield np.frombuffer(cells[i].as_buffer(), f"i{kinds[i]}").reshape(-1, width)


def _summed(packed: DataFrame, width: int, mean: np.ndarray, f: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all blocks of ``f`` of the centred rows: one vector a task, added up by place."""

    def run(batches):
        total = np.zeros(size)
        for block in _blocks(batches, width):
            total += f(block - mean)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(size, dtype=np.int32)), "part": pa.array(total)})

    out = np.zeros(size)
    for row in packed.mapInArrow(run, "at int, part double").groupBy("at").agg(F.sum("part").alias("part")).collect():
        out[row["at"]] = row["part"]
    return out


def _entry_sums(packed: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of every entry."""

    def run(batches):
        rows, total = 0, [0] * width
        for block in _blocks(batches, width):
            rows += len(block)
            total = [a + int(b) for a, b in zip(total, (block.astype(object) if block.dtype == np.int64 else block.astype(np.int64)).sum(0), strict=True)]
        yield pa.RecordBatch.from_pydict({"at": pa.array([*range(width), width], pa.int32()), "part": pa.array([*map(str, total), str(rows)])})

    found = packed.mapInArrow(run, "at int, part string").groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect()
    sums = {r["at"]: int(r["part"]) for r in found}
    return sums.get(width, 0), [sums.get(i, 0) for i in range(width)]


def bidiagonalise(product: Callable[[np.ndarray], tuple[np.ndarray, float]], width: int, wanted: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Singular values (falling) and right singular vectors (columns) of the rows behind ``product``, which maps w to
    X'(Xw) and the squared length of Xw.

    Stops when the first ``wanted`` triplets are exact to rounding, at the latest when v spans the whole space. Where a
    direction runs out, the next v is any that is orthogonal to those before it.
    """
    rng = np.random.default_rng(seed)

    def orthogonal(z: np.ndarray, before: np.ndarray) -> np.ndarray:
        for _ in range(2):
            z = z - before.T @ (before @ z)
        return z

    def fresh(before: np.ndarray) -> np.ndarray:
        z = orthogonal(rng.normal(size=width), before)
        return orthogonal(z / np.linalg.norm(z), before)

    vs, ws, backs = np.zeros((0, width)), np.zeros((0, width)), np.zeros((0, width))
    alphas: list[float] = []
    betas: list[float] = []
    v = fresh(vs)
    v, beta, largest = v / np.linalg.norm(v), 0.0, 0.0
    while True:
        w = v - beta * ws[-1] if len(ws) else v
        for _ in range(3):
            back, squared = product(w)  # X'u and |u|^2 of u = Xw
            overlap = ws @ back
            w, back = w - ws.T @ overlap, back - backs.T @ overlap
            if np.linalg.norm(overlap) <= 1e-6 * np.sqrt(squared):
                break
        alpha = np.sqrt(max(0.0, squared - overlap @ overlap))
        largest = max(largest, alpha, beta)
        vs = np.vstack([vs, v])
        if alpha <= 1e-14 * largest * width or not alpha:
            alpha, w, back = 0.0, np.zeros(width), np.zeros(width)
        else:
            w, back = w / alpha, back / alpha
        ws, backs = np.vstack([ws, w]), np.vstack([backs, back])
        alphas.append(alpha)
        small = np.diag(alphas) + np.diag(betas, 1)
        left, values, right = np.linalg.svd(small)
        if len(alphas) == width:
            break
        z = orthogonal(back - alpha * v, vs)
        beta = float(np.linalg.norm(z))
        if len(alphas) >= wanted and beta and np.abs(beta * left[-1, :wanted]).max() <= 1e-15 * values[0]:
            break
        if beta <= 1e-14 * largest * width:
            beta, v = 0.0, fresh(vs)
        else:
            v = orthogonal(z / beta, vs)
        v = v / np.linalg.norm(v)
        betas.append(beta)
    return values, vs.T @ right.T


@dataclass
class Whitening:
    """A fitted transformation: rows, exact sums of scaled entries, components as columns, their variances."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float
    identity_error: float

    @property
    def width(self) -> int:
        return len(self.sums)

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums]) if self.n else np.zeros(self.width)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Fits on all usable rows of the commonest length (of these, the longest). An empty list gives no components."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whiten")
    good = vectors.where(usable()).select("embedding")
    lengths = good.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    width = lengths[0]["size"] if lengths else 0
    if not width:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
    packed = scratch.save(good.where(F.size("embedding") == width).mapInArrow(_packed(width), "kind int, cells binary"), "packed", large_cells=True).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, sums = _entry_sums(packed, width)
        mean = np.array([s / n for s in sums])
        total = _summed(packed, width, mean, lambda x: np.array([np.vdot(x, x)]), 1)[0] / n

        def product(w: np.ndarray) -> tuple[np.ndarray, float]:
            def step(x):
                u = x @ w
                return np.append(u @ x, u @ u)

            out = _summed(packed, width, mean, step, width + 1)
            return out[:-1], float(out[-1])

        few = min(components, width)
        values, basis = bidiagonalise(product, width, few)
        variances, basis = (values[:few] ** 2) / n, basis[:, :few]
        there = variances > 1e-13 * total
        scaled = basis[:, there] / np.sqrt(variances[there])
        k = scaled.shape[1]

        def gram(x):
            y = x @ scaled
            return np.concatenate([(y.T @ y).ravel(), y.sum(0)])

        done = _summed(packed, width, mean, gram, k * k + k)
        centre = done[k * k :] / n
        error = float(np.abs(done[: k * k].reshape(k, k) / n - np.outer(centre, centre) - np.eye(k)).max(initial=0.0))
    finally:
        packed.unpersist()
    return Whitening(n, sums, basis, np.where(there, variances, 0.0), total, error)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Per row the sum of (n x - S)^2 over its entries, in whole numbers; null where that is beyond 64 bits."""
    top = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if top * top * max(1, len(sums)) < 2**63:
        y = n * x - np.array(sums, np.int64)
        return (y * y).sum(1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, dtype=object)) ** 2).sum(1)
    return [int(v) if v < 2**63 else None for v in exact]


def apply(vectors: DataFrame, fitted: Whitening, keep: list[str]) -> DataFrame:
    """For every usable row of the fitted length and every component a row: the fit list's size, the row's deviation, its
    whitened coordinate, the component's share of all variance and the fit's identity error, beside ``keep``.

    A component without variance (fewer different rows than components, or equal rows) has null coordinates and share 0,
    and isn't part of the identity error. Rows that are null, hold a null or non-finite entry, or have another length are
    left out; repeated rows are rows like others; equal variances keep the order they were found in. Kept columns that
    bear a result's name are left out. Batches are cut so that what one gives stays small.
    """
    width, few = fitted.width, fitted.components.shape[1]
    mean, n, sums = fitted.mean(), fitted.n, fitted.sums
    deep = np.sqrt(fitted.variances)
    scaled = np.divide(fitted.components, deep, out=np.full(fitted.components.shape, np.nan), where=deep > 0)
    share = fitted.variances / fitted.total if fitted.total else np.zeros(few)
    names = [c for c in keep if c not in RESULTS]
    rows = vectors.where(usable() & (F.size("embedding") == width)).select(F.struct(*map(F.col, names), F.lit(0).alias("_")).alias("row"), "embedding")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _scaled(part.column(1), width)
                y = (x - mean) @ scaled
                each = pa.array(np.repeat(np.arange(len(x)), few))
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": part.column(0).take(each),
                        "component": pa.array(np.tile(np.arange(1, few + 1, dtype=np.int32), len(x))),
                        "n": pa.array(np.full(len(x) * few, n, np.int64)),
                        "deviation": pa.array(deviations(x, n, sums), pa.int64()).take(each),
                        "whitened": pa.array(y.ravel(), from_pandas=True),
                        "explained": pa.array(np.tile(share, len(x))),
                        "identity_error": pa.array(np.full(len(x) * few, fitted.identity_error)),
                    }
                )

    if not few:
        rows = rows.where(F.lit(False))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(run, schema).select(*(F.col("row")[c].alias(c) for c in names), *RESULTS)
