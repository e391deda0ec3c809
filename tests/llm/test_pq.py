import numpy as np
import pytest

from gaugemill.llm import pq

from . import brute

SCHEMA = "vec_id long, embedding array<float>, component_id string"


def wanted(ids, x, at=0.95):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= at
    np.fill_diagonal(near, False)
    named = brute.components(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near), strict=True)])
    return {i: (int(n), named[i]) for i, n in zip(ids, near.sum(1), strict=True)}


def test_all_links_are_found(spark, monkeypatch):
    monkeypatch.setattr(pq, "TILE", 40)
    monkeypatch.setattr(pq, "LOT_BYTES", 60 * 8 * 16)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(200, 16))
    x = np.concatenate([base, base[:100] + rng.normal(scale=0.25, size=(100, 16)), base[:1] * 3 + rng.normal(scale=0.3, size=(150, 16)), base[:5]]).astype(np.float32)
    ids = [int(i) for i in rng.permutation(len(x)) * 3]
    rows = [(i, v.tolist(), "c") for i, v in zip(ids, x, strict=True)]
    odd = [(9001, None, "d"), (9002, [0.0] * 16, "d"), (9003, [float("nan")] * 16, "d"), (9004, [1.0] * 15 + [None], "d"), (9005, [1.0, 2.0], "d"), (9006, [], "d"), (9007, [float("inf")] * 16, "d")]
    found = {r.vec_id: (r.n_links, r.component_id) for r in pq.link(spark.createDataFrame(rows + odd, SCHEMA)).collect()}
    assert {i: v for i, v in found.items() if i < 9000} == wanted(ids, x.astype(float))
    assert all(found[i] == (0, i) for i, _, _ in odd)


def test_repeated_ids_nulls_and_empty_tables(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [2.0, 4.0]), (5, [-1.0, 1.0])]
    found = sorted((tuple(r) for r in pq.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()), key=str)
    assert found == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (5, 0, 5)], key=str)
    assert pq.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_in_many_dimensions(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(600, 64))
    x = np.concatenate([base, np.repeat(base[:300], 3, 0) + rng.normal(scale=0.3, size=(900, 64))]).astype(np.float32)
    ids = list(range(len(x)))
    found = {r.vec_id: r.n_links for r in pq.link(spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")).collect()}
    want = wanted(ids, x.astype(float))
    assert all(found[i] <= want[i][0] for i in ids) and sum(found.values()) >= 0.999 * sum(n for n, _ in want.values()) > 0


@pytest.mark.parametrize("d", [64, 384])
def test_no_link_is_lost_among_low_rank_vectors_and_drifting_copies(spark, d):
    rng = np.random.default_rng(d)
    flat = rng.normal(size=(500, 3)) @ rng.normal(size=(3, d))
    start, way = (np.linalg.qr(rng.normal(size=(d, 2)))[0].T for _ in range(2))
    turn = np.arange(0, 6, 0.3)
    chains = np.concatenate([np.outer(np.cos(turn), a[0]) + np.outer(np.sin(turn), a[1]) for a in (start, way, start[::-1] + 0.5 * way)])
    x = np.concatenate([flat, chains, rng.normal(size=(100, d))]).astype(np.float32)
    ids = [int(i) for i in rng.permutation(len(x))]
    found = {r.vec_id: (r.n_links, r.component_id) for r in pq.link(spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")).collect()}
    assert found == wanted(ids, x.astype(float))


@pytest.mark.parametrize("kind", ["noise", "drift"])
def test_recall_with_a_measured_reach(spark, monkeypatch, kind):
    """More vectors than queries, so that the reach is measured; differences in all directions, or along few."""
    monkeypatch.setattr(pq, "QUERIES", (300,))
    monkeypatch.setattr(pq, "TILE", 100)
    rng = np.random.default_rng(21)
    base = rng.normal(size=(900, 32))
    if kind == "noise":
        near = np.repeat(base[:400], 4, 0) + rng.normal(scale=0.2, size=(1600, 32))
    else:
        near = np.repeat(base[:400], 4, 0) + np.tile([[0.1], [0.2], [0.3], [0.4]], (400, 1)) * np.linalg.norm(base[0]) * np.eye(32)[0]
    x = np.concatenate([base, near]).astype(np.float32)
    ids = list(range(len(x)))
    found = {r.vec_id: r.n_links for r in pq.link(spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")).collect()}
    want = wanted(ids, x.astype(float))
    assert all(found[i] <= want[i][0] for i in ids)
    assert sum(found.values()) >= 0.99 * sum(n for n, _ in want.values()) > 1000


def test_a_vector_that_a_third_of_all_rows_hold(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 24)), 4000, 0), rng.normal(size=(40, 24))]).astype(np.float32)
    x[4000] = x[0] + 0.01
    found = {r.vec_id: (r.n_links, r.component_id) for r in pq.link(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    assert found[17] == (4000, 0) and found[4000] == (4000, 0) and sum(n for n, _ in found.values()) == 4000 * 4001
