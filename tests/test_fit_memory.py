"""Fits of whole runs widen a slice of their vectors at a time."""

import tracemalloc

import numpy as np

import __spark_entry__
from meshwork.operators import cluster

SF = "/root/testdata/sf0.001"


def test_kmeans_holds_no_second_copy():
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(60_000, 32)) + 9 * rng.integers(0, 4, 60_000)[:, None]).astype(np.float32)
    tracemalloc.start()
    label, score = cluster.kmeans_fit(x, 4, 0, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * x.nbytes
    centre = np.array([x[label == j].astype(float).mean(axis=0) for j in range(4)])
    d = np.square(x[:2000, None].astype(float) - centre[None]).sum(axis=2)
    assert (d.argmin(axis=1) == label[:2000]).all() and abs(score - np.square(x - centre[label]).sum()) < 1e-3


def test_slices_do_not_change_a_fit(monkeypatch):
    x = np.random.default_rng(1).normal(size=(500, 6))
    whole = cluster.kmeans_fit(x, 3, 5)
    monkeypatch.setattr(cluster, "SLICE", 64)
    part = cluster.kmeans_fit(x, 3, 5)
    assert (whole[0] == part[0]).all() and whole[1] == part[1]


def test_box_of_references():
    x = np.random.default_rng(4).normal(size=(400, 3)) * [5.0, 1.0, 0.1] + 7
    r = cluster.uniform_in_box(x, 0)
    assert r.shape == x.shape and np.all(r.std(axis=0) > 0.2 * x.std(axis=0)) and r[:, 2].std() < 1


def test_runs_are_fitted_once(spark):
    """The best run is chosen among written runs, not among runs that are fitted again."""
    q = __spark_entry__.queries()["kmeans_best_of_seeds"](spark, SF)
    assert "InArrow" not in q._jdf.queryExecution().toString() and "InPandas" not in q._jdf.queryExecution().toString()
    assert q.select("id").distinct().count() == q.count() == 500
