"""Window models from lag products against the windows themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import lagged, reconstruct, select, windows

BY = ["series_id"]


@pytest.fixture(scope="module")
def panel(spark):
    rng, rows = np.random.default_rng(7), []
    # Shorter than a window, exactly one window, ends that overlap, long; one null key.
    for s, n in ((0, 3), (1, 6), (2, 9), (3, 40), (4, 133), (None, 25)):
        x = np.cumsum(rng.normal(size=(n, 3)), axis=0) + [1000.0, 5.0, 0.0]
        rows += [(s, t, *map(float, x[t]), "k") for t in range(n)]
    return spark.createDataFrame(rows, "series_id int, t long, a double, b double, c double, vec string").repartition(5).cache()


def same_space(got, want):
    np.testing.assert_allclose(got @ got.T, want @ want.T, atol=1e-8)


@pytest.mark.parametrize("size", [None, 7])
@pytest.mark.parametrize("held", [True, False])
def test_same_model_as_from_windows(panel, monkeypatch, size, held):
    if not held:
        monkeypatch.setattr(lagged, "EDGE_VALUES", 0)
    groups = {0: ["a", "b", "c"], 4: ["c", "a"]}
    got = reconstruct.GroupedPca.fit_panel(panel, BY, groups, 6, 4, size)
    for g, columns in groups.items():
        wins = windows.flatten_windows(windows.sliding(panel, BY, columns, 6))
        want = reconstruct.WindowPca.fit(wins, 4)
        np.testing.assert_allclose(got.models[g].mean, want.mean, rtol=1e-10)
        same_space(got.models[g].basis, want.basis)


def test_moments_are_those_of_the_windows(panel):
    moments = lagged.window_moments(panel, BY, {0: ["b", "c"]}, 5)[0]
    wins = windows.flatten_windows(windows.sliding(panel, BY, ["b", "c"], 5))
    x = np.array([r.vec for r in wins.collect()])
    assert moments.count == len(x)
    np.testing.assert_allclose(moments.covariance(np.eye(10)), np.cov(x.T), rtol=1e-9, atol=1e-9)
    mean, variances, basis = moments.directions(3)
    np.testing.assert_allclose(mean, x.mean(axis=0))
    np.testing.assert_allclose(variances, np.linalg.eigvalsh(np.cov(x.T))[::-1][:3])
    np.testing.assert_allclose(basis.T @ basis, np.eye(3), atol=1e-12)
    one = lagged.window_moments(panel, BY, {0: ["b"]}, 1)[0]
    assert one.count == panel.count() and one.covariance(np.eye(1))[0, 0] == pytest.approx(
        panel.agg(F.var_samp("b")).first()[0]
    )


def test_leading_directions_of_a_wide_matrix():
    rng = np.random.default_rng(3)
    base = np.linalg.qr(rng.normal(size=(300, 300)))[0]
    values = np.concatenate([[50.0, 49.0, 20.0, 20.0, 3.0], 1 / np.arange(1, 296)])
    m = (base * values) @ base.T
    calls = []

    def product(v):
        calls.append(v.shape[1])
        return m @ v

    got, vectors = lagged.leading(product, 300, 5)
    np.testing.assert_allclose(got, values[:5], rtol=1e-10)
    same_space(vectors, base[:, :5])
    assert max(calls) <= 13
    # Fewer directions than asked for, and none at all.
    flat = lagged.leading(lambda v: 0 * v, 200, 3)
    assert flat[1].shape == (200, 3) and not flat[0].any()
    rank_one = lagged.leading(lambda v: np.ones((200, 200)) @ v, 200, 3)[0]
    np.testing.assert_allclose(rank_one, [200, 0, 0], atol=1e-9)


def test_wide_vectors_without_their_covariance(panel, monkeypatch):
    wins = windows.flatten_windows(windows.sliding(panel, BY, ["a", "b", "c"], 20)).cache()
    want = reconstruct.WindowPca.fit(wins, 3)
    monkeypatch.setattr(reconstruct, "MAX_WIDTH", 10)
    same_space(reconstruct.WindowPca.fit(wins, 3).basis, want.basis)
    same_space(reconstruct.WindowPca.fit_panel(panel, BY, ["a", "b", "c"], 20, 3).basis, want.basis)


def test_no_series_as_long_as_a_window(panel):
    with pytest.raises(ValueError, match="as long as"):
        reconstruct.WindowPca.fit_panel(panel.where("series_id = 0"), BY, ["a"], 6, 2)


@pytest.mark.parametrize("orthonormal", [True, False])
def test_mask_importance_against_whole_reconstructions(spark, panel, orthonormal):
    names, length = ["a", "b", "c"], 8
    wins = windows.flatten_windows(windows.sliding(panel.where("series_id in (3, 4)"), BY, names, length))
    rng = np.random.default_rng(1)
    basis = rng.normal(size=(24, 5))
    basis = np.linalg.qr(basis)[0] if orthonormal else basis / 9
    model = reconstruct.WindowPca(rng.normal(size=24), basis)
    got = {(r.series_id, r.feature): r.importance for r in select.mask_importance(wins, BY, names, length, model, 2).collect()}
    rows = wins.select("series_id", "vec", F.xxhash64("series_id", "w", F.lit(42)).alias("draw")).toPandas()
    for s, part in rows.groupby("series_id"):
        x, draws = np.stack(part.vec.to_numpy()), part.draw.to_numpy()
        clean = ((x - model.mean) @ basis @ basis.T + model.mean - x) ** 2
        for fi, f in enumerate(names):
            worse = []
            for r in range(2):
                y = x.reshape(-1, length, 3).copy()
                order = select.block_order(draws, length, fi, r)
                y[:, :, fi] = np.take_along_axis(y[:, :, fi], order, axis=1)
                worse.append(((y.reshape(x.shape) - model.mean) @ basis @ basis.T + model.mean - x) ** 2)
            assert got[s, f] == pytest.approx(np.mean(worse) - clean.mean(), rel=1e-7)
