"""Spectrum slicing against NumPy's eigenvalues, whitening against brute force."""

import numpy as np
import pytest

from holdfast.llm import spectrum


def symmetric(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values),) * 2))[0]
    m = q @ np.diag(np.asarray(values, float)) @ q.T
    return (m + m.T) / 2


@pytest.mark.parametrize("seed", range(20))
def test_pivots_count_eigenvalues(seed):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(1 + 3 * seed, 1 + 3 * seed))
    m = m + m.T
    if seed % 2:
        np.fill_diagonal(m, 0)  # no pivot of one row to start from
    for shift in (0.0, 0.7, -2.0):
        moved = m - shift * np.eye(len(m))
        assert spectrum.positive_pivots(moved) == (np.linalg.eigvalsh(moved) > 0).sum()


@pytest.mark.parametrize("values", [
    [9, 7, 5, 3, 1], [5, 5, 5, 1, 1, 1], [4, 4 - 1e-13, 4 - 2e-13, 4 - 3e-13, 1], [1e9, 1, 1e-4, 0, 0], [3], [2, 0], [1e-300, 1e-301],
    [1 + 1e-9, 1, 1 - 1e-9, 0.5], list(np.linspace(1, 2, 64))])
def test_leading_pairs(values):
    m = symmetric(values)
    true = np.linalg.eigvalsh(m)[::-1]
    reach = max(abs(true))
    got = spectrum.leading(m, 4)
    assert len(got) == min(4, int((np.asarray(sorted(values)[::-1]) > 1e-14 * reach).sum()))
    vectors = np.array([c.vector for c in got])
    assert np.abs(vectors @ vectors.T - np.eye(len(got))).max() < 1e-12
    for k, c in enumerate(got):
        assert abs(c.value - true[k]) <= 1e-13 * reach * len(m)
        assert np.linalg.norm(m @ c.vector - c.value * c.vector) <= 1e-13 * reach * len(m)


def test_nothing_varies():
    assert spectrum.leading(np.zeros((3, 3)), 4) == []


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, n int, component string")


def brute(rows, many=4):
    x = np.array([np.floor(256 * np.asarray(v, np.float32).astype(float)).astype(np.int64) for _, v in rows])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov((fit - s / n).T, bias=True))
    white = (x - s / n) @ vectors[:, ::-1][:, :many] / np.sqrt(values[::-1][:many])
    return n, ((n * x - s) ** 2).sum(axis=1), white, values[::-1][:many] / values.sum()


@pytest.mark.parametrize("dims", [5, 33])
def test_whitening(spark, dims):
    rng = np.random.default_rng(dims)
    rows = [(i, rng.normal(size=dims).astype(np.float32).tolist()) for i in range(150)]
    rows += [(7, rows[7][1]), (500, rows[3][1]), (501, rows[3][1])] * 30  # ids and copies again
    odd = [(900, None), (901, []), (902, [None] * dims), (903, [float("nan")] * dims), (904, [float("inf")] + [0.0] * (dims - 1)), (905, [1.0] * (dims + 1))]
    got = spectrum.whiten(table(spark, rows + odd).repartition(5)).collect()
    n, deviation, white, explained = brute(rows)
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-10
    first = {i: k for k, (i, _) in enumerate(rows)}
    for c in range(4):
        mine = [r for r in got if r.component == c + 1]
        ours = np.array([r.whitened for r in mine])
        want = np.array([white[first[r.vec_id], c] for r in mine])
        assert min(np.abs(ours - want).max(), np.abs(ours + want).max()) < 1e-9
        assert [r.deviation for r in mine] == [deviation[first[r.vec_id]] for r in mine]
        assert abs(mine[0].explained - explained[c]) < 1e-12


def test_fewer_components_than_asked(spark):
    got = spectrum.whiten(table(spark, [(1, [0.0, 0.0, 3.0]), (2, [1.0, 1.0, 3.0]), (3, [2.0, 2.0, 3.0])])).collect()
    assert [(r.vec_id, r.component, r.deviation) for r in sorted(got)] == [(1, 1, 2 * 768 ** 2), (2, 1, 0), (3, 1, 2 * 768 ** 2)]
    assert got[0].explained == pytest.approx(1.0)


def test_nothing_to_learn(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        found = spectrum.whiten(table(spark, rows))
        assert found.count() == 0 and found.columns == [
            "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whole_numbers_beyond_their_range(spark):
    got = spectrum.whiten(table(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 5.0])])).collect()
    assert {r.deviation for r in got} == {None} or all(r.deviation is None or r.deviation >= 0 for r in got)
    assert spectrum._rounded(np.array([1e30, -1e30, -0.1, 1.0]), 256.0).tolist() == [2 ** 63 - 1, -2 ** 63, -26, 256]


def test_deviation_beyond_machine_words():
    learned = spectrum.Whitening(2, 3, [3 << 40, 0], 1 << 41, 1.0, [], 0.0)
    x = np.array([[1 << 40, 5], [(1 << 40) + 1000, 0], [1 << 41, 0]])
    assert learned.deviations(x) == [225, 9_000_000, None]
