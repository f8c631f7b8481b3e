"""k-means of one table by blocks: no task holds all vectors, and clear groups are found."""

import numpy as np
import pytest

from meshwork.operators import cluster, packed, whole


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    group = rng.integers(0, 3, 900)
    return rng.normal(size=(900, 4)) + 12 * np.eye(4)[group], group


@pytest.fixture(scope="module")
def nodes(spark, data):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data[0])], "id long, x array<double>")


def test_groups_and_scores(nodes, data, monkeypatch):
    monkeypatch.setattr(packed, "SIZE", 100)
    x, group = data
    rows = whole.kmeans_runs(nodes, 2, 3).collect()
    assert len(rows) == 1800 and {r.k for r in rows} == {3}
    for seed in (0, 1):
        label = np.array([r.label for r in sorted((r for r in rows if r.seed == seed), key=lambda r: r.id)])
        assert len({(a, b) for a, b in zip(label, group)}) == 3
        centre = np.array([x[label == j].mean(axis=0) for j in range(3)])
        assert abs(next(r.score for r in rows if r.seed == seed) - np.square(x - centre[label]).sum()) < 1e-5


def test_gap_like_that_of_one_task(nodes):
    by_blocks = {r.k: r for r in whole.gap_curve(nodes, [2, 3, 4], 4).collect()}
    for r in cluster.gap_curve(nodes, [2, 3, 4], 4).collect():
        assert abs(r.gap - by_blocks[r.k].gap) < 0.2
    assert max(by_blocks, key=lambda k: by_blocks[k].gap) == 3
