"""Ward's tree and leading eigenvectors by blocks give what one task with all vectors gives, and no task gets all vectors."""

import numpy as np
import pytest

from meshwork.operators import cluster, whole
from meshwork.plans import clusters


def frame(spark, x, ids=None, kind="double"):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(range(len(x)) if ids is None else ids, x)], f"id long, x array<{kind}>").repartition(3)


def labels(df):
    return [r.label for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("local, k", [(20, 4), (40, 6)])
def test_ward_in_rounds(spark, local, k, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(90, 5)), rng.normal(size=(60, 5)) + 4, [[90.0] * 5, [91.0] * 5, [-70.0] * 5]])
    monkeypatch.setattr(whole, "ROWS", 16)
    assert labels(whole.ward(frame(spark, x), k, local)) == cluster.ward_fit(x, k).tolist()


def test_ward_of_copies_and_ties(spark):
    """A large group of equal vectors is one cluster at once; equal costs on a grid don't stop the rounds."""
    x = np.array([[0.0, 0.0]] * 200 + [[-0.0, 0.0]] * 3 + [[100.0 + i, float(j)] for i in range(4) for j in range(4)])
    assert labels(whole.ward(frame(spark, x), 2, 1)) == [0] * 203 + [1] * 16


def test_pairs_of_equal_cost_choose_each_other():
    ids = np.arange(300)
    x = np.eye(300)
    own = whole.Cheapest(ids, x, np.ones(300))
    for part in (ids[:170], ids[170:]):
        own.meet(part, x[part], np.ones(len(part)))
    assert (own.to != ids).all() and (own.to[own.to] == ids).sum() > 60


def test_spectral_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(90, 6)) + 3 * np.eye(6)[i] for i in range(4)])
    x[5] = 0.0
    monkeypatch.setattr(whole, "ROWS", 50)
    got = np.array(labels(whole.spectral(frame(spark, x, kind="float"), 4, 0)))
    x = x.astype(np.float32).astype(float)
    u = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=x.any(axis=1)[:, None])
    w = np.maximum(u @ u.T, 0)
    np.fill_diagonal(w, 0)
    want = cluster.spectral_fit(w, 4, 0)
    rest = np.arange(len(x)) != 5
    assert (got == want)[rest].all()


def test_large_tables_go_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(whole, "LOCAL", 100)
    monkeypatch.setattr(cluster, "fits", lambda *a: pytest.fail("all vectors in one task"))
    monkeypatch.setattr(whole, "ward", lambda n, k: ("ward", k))
    monkeypatch.setattr(whole, "spectral", lambda n, k, seed: ("spectral", k))
    assert clusters.ward(spark, "/root/testdata/sf0.001") == ("ward", 6) and clusters.spectral(spark, "/root/testdata/sf0.001") == ("spectral", 6)
