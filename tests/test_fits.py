"""Many fits at once against one fit at a time."""

from itertools import combinations

import numpy as np
import pytest

from meshwork.operators import fits as O


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    return {m: rng.normal(size=(40 + m, 3)) + 4 * rng.integers(0, 3, (40 + m, 1)) for m in (1, 2)}


@pytest.fixture(scope="module")
def fitted(spark, data):
    rows = [(m, i, x.tolist()) for m, v in data.items() for i, x in enumerate(v)] + [(3, 0, [0.0] * 3)]
    n = spark.createDataFrame(rows, "m int, id long, x array<double>").repartition(5)
    start = O.seeded(n, "m", [2, 3, 4], 3)
    return n, start, O.lloyd(n, start, 30)


def plain(x, c):
    for _ in range(30):
        lab = np.square(x[:, None] - c[None]).sum(axis=2).argmin(axis=1)
        c = np.array([x[lab == j].mean(axis=0) if (lab == j).any() else c[j] for j in range(len(c))])
    return c


def test_lloyd(data, fitted):
    _, start, end = fitted
    assert set(end.centres) == {1, 2} and end.rounds < 30
    for m, x in data.items():
        for i, run in enumerate(start.runs):
            assert {tuple(c) for c in start.centres[m][i]} <= {tuple(v) for v in x} and len(start.centres[m][i]) == run.k
            assert np.allclose(end.centres[m][i], plain(x, start.centres[m][i]))


def test_indices(data, fitted):
    n, _, end = fitted
    got = {(r.m, r.k, r.seed): r for r in O.indices(n, end).collect()}
    assert len(got) == 2 * 9
    for m, x in data.items():
        for i, (k, seed) in enumerate(end.runs):
            d = np.sqrt(np.square(x[:, None] - end.centres[m][i][None]).sum(axis=2))
            near = np.sort(d, axis=1)
            within = np.square(near[:, 0]).sum()
            between = np.square(x - x.mean(axis=0)).sum() - within
            r = got[m, k, seed]
            assert np.allclose([r.inertia, r.ch, r.silhouette], [within, between / (k - 1) / (within / (len(x) - k)), ((near[:, 1] - near[:, 0]) / near[:, 1]).mean()])
    best = {(r.m, r.k): r.seed for r in O.best_seeds(O.indices(n, end), "m").collect()}
    assert all(got[m, k, s].inertia <= min(got[m, k, t].inertia for t in range(3)) + 1e-6 for (m, k), s in best.items())


def test_agreement(data, fitted):
    n, _, end = fitted
    got = {(r.m, r.k, r.a, r.b): r.ari for r in O.seed_agreement(n, end).collect()}
    two = lambda v: v * (v - 1) / 2
    for m, x in data.items():
        labels = [np.square(x[:, None] - c[None]).sum(axis=2).argmin(axis=1) for c in end.centres[m]]
        for p, q in combinations(range(9), 2):
            if end.runs[p].k == end.runs[q].k:
                t = np.zeros((4, 4))
                np.add.at(t, (labels[p], labels[q]), 1)
                rows, cols, e = two(t.sum(axis=1)).sum(), two(t.sum(axis=0)).sum(), two(len(x))
                want = (two(t).sum() - rows * cols / e) / ((rows + cols) / 2 - rows * cols / e)
                assert abs(got[m, end.runs[p].k, end.runs[p].seed, end.runs[q].seed] - want) < 1e-9
    curve = O.stability_curve(O.seed_agreement(n, end), O.indices(n, end), "m").collect()
    assert sorted(r.k for r in curve) == [2, 3, 4] and all(r.n_slices == 2 for r in curve)


def test_empty(spark):
    n = spark.createDataFrame([], "m int, id long, x array<double>")
    end = O.lloyd(n, O.seeded(n, "m", [2], 2), 3)
    assert O.indices(n, end).count() == 0
