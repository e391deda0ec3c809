import numpy as np
import pytest

from gaugemill.llm import whiten

SCHEMA = "vec_id long, embedding array<float>, n string"


def exact(x):
    """Scaled rows, falling variances and their unit vectors, from the whole covariance."""
    x = np.floor(64 * np.asarray(x, np.float32).astype(float)) + 1_000_000
    c = x - x.mean(0)
    values, vectors = np.linalg.eigh(c.T @ c / len(c))
    return x, c, values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("shape", [(300, 40), (50, 8), (20, 40)])
def test_against_the_whole_covariance(spark, shape):
    rng = np.random.default_rng(shape[0])
    x = rng.normal(size=shape) * np.linspace(1, 3, shape[1]) + rng.normal(size=shape[1])
    x[3] = x[4]
    table = spark.createDataFrame([(i, v.tolist(), "c") for i, v in enumerate(x.astype(np.float32))], SCHEMA).repartition(3)
    scaled, centred, values, vectors = exact(x)
    got = whiten.apply(table, whiten.fit(table), ["vec_id", "n"]).toPandas()
    few = min(32, shape[1])
    assert len(got) == len(x) * few and set(got["n"]) == {len(x)}
    deviation = {i: sum((len(x) * int(a) - int(s)) ** 2 for a, s in zip(row, scaled.sum(0), strict=True)) for i, row in enumerate(scaled)}
    assert all(deviation[i] == d for i, d in zip(got["vec_id"], got["deviation"], strict=True))
    there = values[:few] > 1e-9 * values[0]
    for k in range(few):
        part = got[got["component"] == k + 1].sort_values("vec_id")
        if not there[k]:
            assert part["whitened"].isna().all() and (part["explained"] == 0).all()
            continue
        want = centred @ vectors[:, k] / np.sqrt(values[k])
        mine = part["whitened"].to_numpy()
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-8
        assert np.allclose(part["explained"], values[k] / values.sum(), rtol=1e-10)
    assert 0 <= got["identity_error"].max() < 1e-9


def test_the_product_of_orders(spark):
    """Singular values over six orders of magnitude, where sums of squares alone would lose the small ones' vectors."""
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    x = rng.normal(size=(400, 12)) * np.logspace(0, -6, 12) @ q
    values, right = whiten.bidiagonalise(lambda w: ((x @ w) @ x, float((x @ w) @ (x @ w))), 12, 12)
    _, want, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(values, want, rtol=1e-8)
    assert np.allclose(np.abs((right * vt.T).sum(0)), 1, atol=1e-9)
    assert np.allclose(right.T @ right, np.eye(12), atol=1e-13)


def test_unusable_rows_other_lengths_and_empty_tables(spark):
    rng = np.random.default_rng(6)
    good = [(i, v.tolist(), "c") for i, v in enumerate(rng.normal(size=(30, 4)).astype(np.float32))]
    odd = [(90, None, "d"), (91, [float("nan")] * 4, "d"), (92, [1.0, None, 1.0, 1.0], "d"), (93, [float("inf")] * 4, "d"), (94, [1.0, 2.0], "d"), (95, [], "d")]
    table = spark.createDataFrame(good + odd, SCHEMA)
    fitted = whiten.fit(table)
    assert fitted.n == 30 and whiten.apply(table, fitted, ["vec_id"]).select("vec_id").distinct().count() == 30
    none = spark.createDataFrame([], SCHEMA)
    assert whiten.apply(none, whiten.fit(none), ["vec_id"]).count() == 0
    only = spark.createDataFrame(odd, SCHEMA)
    assert whiten.apply(only, whiten.fit(only), ["vec_id"]).count() == 2  # the row of two entries: two components
    same = spark.createDataFrame([(1, [1.0, 2.0], "c")] * 5, SCHEMA)
    got = whiten.apply(same, whiten.fit(same), ["vec_id"]).collect()
    assert len(got) == 10 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 for r in got)


def test_huge_entries_and_deviations_beyond_64_bits(spark):
    x = [[1e30, 0.0], [0.0, 1.0], [-5.0, 2.0]]
    table = spark.createDataFrame([(i, v, "c") for i, v in enumerate(x)], "vec_id long, embedding array<double>, n string")
    got = whiten.apply(table, whiten.fit(table), ["vec_id"]).collect()
    assert len(got) == 6 and all(r.deviation is None for r in got)
    assert whiten.deviations(np.array([[2**31, 5]]), 3, [0, 0]) == [9 * 2**62 + 225 if 9 * 2**62 < 2**63 else None]
