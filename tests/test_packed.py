"""Nearest neighbours over packed blocks: each node is moved a fixed number of times, and no tie or copy is lost."""

import numpy as np
import pytest

import __spark_entry__
from meshwork.operators import packed, pairs, validity

SF = "/root/testdata/sf0.001"


def want(x, k, metric):
    with np.errstate(invalid="ignore"):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9) if metric == "cosine" else -np.round(np.sqrt(np.square(x[:, None] - x[None]).sum(axis=2)), 9)
    return {(i, j) for i in range(len(x)) for j in sorted((j for j in range(len(x)) if j != i and not np.isnan(s[i, j])), key=lambda j: (-s[i, j], j))[:k]}


@pytest.mark.parametrize("metric", ["cosine", "euclid"])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_copies_far_vectors_and_small_tiles(spark, metric, kind, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 4)).astype(np.float32 if kind == "float" else float).astype(float)
    x[10:40], x[50], x[60:64] = x[10], 0.0, x[60:64] + 1e6
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"id long, x array<{kind}>")
    monkeypatch.setattr(packed, "GROUP", 2)
    monkeypatch.setattr(packed, "ROWS", 7)
    monkeypatch.setattr(packed, "COLUMNS", 5)
    x = np.array(x, np.float32).astype(float) if kind == "float" else x
    assert {(r.src, r.dst) for r in pairs.block_knn(nodes, 4, 5, metric=metric).collect()} == want(x, 4, metric)


def test_equal_vectors_past_k_are_no_columns():
    m = np.array([[0.0, 1.0], [2.0, 3.0], [-0.0, 1.0], [0.0, 1.0], [2.0, 3.0]])
    assert packed.first_copies(m, 2).tolist() == [0, 1, 2, 4] and packed.first_copies(m, 1).tolist() == [0, 1]


def test_products_in_single_precision_lose_nobody():
    """Distances that single precision can't tell apart are ranked by double."""
    x = 1.0 + np.random.default_rng(2).normal(size=(300, 8)) * 1e-6
    best = packed.Best(np.arange(300), x, "euclid", 3, 9)
    best.meet(np.arange(300), x)
    assert {(i, int(j)) for i in range(300) for j in best.to[i]} == want(x, 3, "euclid")


def test_no_vector_is_copied_for_each_block(spark):
    df = pairs.block_knn(spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], "id long, x array<double>"), 2, 4)
    text = df._jdf.queryExecution().toString()
    assert "CartesianProduct" in text and "Generate" not in text


def test_edges_are_worked_out_once(spark):
    """Measures that read the edges more than once read what was written."""
    for name in ("clustering_coeff", "degree_change", "edge_degree_stats", "network_overlap"):
        text = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().toString()
        assert "InArrow" not in text and "CartesianProduct" not in text


def test_vectors_are_moved_as_stored(spark):
    """Block operators widen vectors in the task, not before they are sent to each pair of blocks."""
    for name in ("similar_not_neighbours", "cosine_pairs_threshold", "silhouette"):
        assert "array<double>" not in __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().analyzed().toString()


def test_sums_of_distances_move_no_vector_for_each_block(spark, monkeypatch):
    """Silhouettes and pairs above a threshold meet by packed blocks, which may be many."""
    rng = np.random.default_rng(3)
    x, label = rng.normal(size=(120, 3)) + 1e4, rng.integers(0, 3, 120)
    x[5:9] = x[5]
    nodes = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label))], "id long, x array<double>, label long")
    monkeypatch.setattr(packed, "GROUP", 2)
    monkeypatch.setattr(pairs, "TILE", 7)
    for df in (validity.silhouette(nodes, 9), pairs.block_pairs(nodes, "cosine", 9, 0.5)):
        text = df._jdf.queryExecution().toString()
        assert "CartesianProduct" in text and "Generate" not in text
    d, at = np.linalg.norm(x[:, None] - x[None], axis=2), np.arange(120)
    for r in validity.silhouette(nodes, 9).collect():
        own, other = d[r.id, (label == label[r.id]) & (at != r.id)].mean(), min(d[r.id, label == c].mean() for c in {0, 1, 2} - {label[r.id]})
        assert abs(r.s - (other - own) / max(own, other)) < 1e-9


def test_each_pair_of_blocks_is_met_once():
    for blocks in (1, 2, 5, 8):
        met = [tuple(sorted((i, j))) for i in range(blocks) for j in range(blocks) if packed.once(i, j, blocks)]
        assert sorted(met) == [(i, j) for i in range(blocks) for j in range(i, blocks)]
