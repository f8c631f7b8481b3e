"""Results of pairs by blocks against brute force, and plans that send no pairs to a broadcast."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from meshwork.operators import pairs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 5))
    x[7], x[20:26] = 0.0, x[20]
    return x


@pytest.fixture(scope="module")
def nodes(spark, vectors):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, x array<double>")


def cosines(x):
    with np.errstate(invalid="ignore"):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return u @ u.T


def plan(df):
    return df._jdf.queryExecution().toString()


def test_blocks_stay_few():
    assert pairs.blocks_for(10) == 4 and pairs.blocks_for(120_000) == 16 and pairs.blocks_for(720_000) == 22


@pytest.mark.parametrize("blocks", [1, 3])
def test_bands(nodes, vectors, blocks):
    d, c = np.linalg.norm(vectors[:, None] - vectors[None], axis=2), cosines(vectors)
    i, j = np.triu_indices(150, 1)
    d, c = d[i, j], c[i, j]
    got = {r.band: r for r in pairs.block_bands(nodes, blocks, [0, 1.5, 3], ["near", "far"]).collect()}
    for name, own in (("near", (d > 0) & (d <= 1.5)), ("far", (d > 1.5) & (d <= 3)), (None, (d <= 0) | (d > 3))):
        there = own & ~np.isnan(c)
        assert got[name].n == own.sum() and got[name].mean == pytest.approx(c[there].mean(), abs=1e-12)
        assert got[name].r == pytest.approx(np.corrcoef(c[there], np.log1p(d[there]))[0, 1], abs=1e-9)


def test_bands_join_no_pairs(spark):
    assert "Join" not in plan(__spark_entry__.queries()["distance_bands"](spark, SF))


@pytest.mark.parametrize("q", [0.0, 0.5, 0.9, 1.0])
def test_quantile(nodes, vectors, q):
    c = cosines(vectors)[np.triu_indices(150, 1)]
    assert pairs.cosine_quantile(nodes, 3, q) == pytest.approx(np.quantile(c[~np.isnan(c)], q), abs=1e-12)


def test_skipped_partners(spark, nodes, vectors):
    skip = spark.createDataFrame([(3, [5, 9, 900]), (5, [3]), (9, [3])], "id long, skip array<long>")
    every = {(r.x, r.y) for r in pairs.block_pairs(nodes, "cosine", 3, -2.0).collect()}
    left = {(r.x, r.y) for r in pairs.block_pairs(nodes.join(skip, "id", "left"), "cosine", 3, -2.0).collect()}
    assert every - left == {(3, 5), (3, 9)}
    assert "Join" not in plan(__spark_entry__.queries()["similar_not_neighbours"](spark, SF)).split("FlatMapGroupsInArrow")[0]


@pytest.mark.parametrize("metric", ["cosine", "euclid"])
@pytest.mark.parametrize("k", [1, 4])
def test_knn_with_ties(nodes, vectors, metric, k):
    s = cosines(vectors) if metric == "cosine" else -np.linalg.norm(vectors[:, None] - vectors[None], axis=2)
    want = set()
    for i in range(150):
        order = sorted((j for j in range(150) if j != i and not np.isnan(s[i, j])), key=lambda j: (-round(s[i, j], 9), j))
        want |= {(i, j) for j in order[:k]}
    assert {(r.src, r.dst) for r in pairs.block_knn(nodes, k, 3, metric=metric).collect()} == want


def test_knn_of_copies_is_split_not_lost(nodes, vectors, monkeypatch):
    """A block of equal vectors passes any bound; it is ranked in smaller slices."""
    by = pairs.Metric(np.ones((40, 3)), "cosine")
    monkeypatch.setattr(pairs, "CELLS", 64)
    s = np.where(np.eye(40, dtype=bool), -np.inf, 1.0)
    i, j, w = pairs._best(by, np.arange(40), np.arange(40), np.arange(40), s, 2, 9)
    assert len(i) == 80 and sorted(set(j.tolist())) == [0, 1, 2] and np.allclose(w, 1)


@pytest.mark.parametrize("blocks", [1, 3])
def test_lags(spark, blocks):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 9))
    x[4] = 2.0
    df = spark.createDataFrame([(i * 7 % 30, x[i * 7 % 30].tolist()) for i in range(30)], "id long, x array<double>")
    got = {(r.x, r.y): (r.score, r.lag) for r in pairs.block_lags(df, [0, -1, 1, -2, 3], blocks).collect()}
    assert len(got) == 30 * 29 // 2
    for (a, b), (score, lag) in got.items():
        best = None
        for at in [0, -1, 1, -2, 3]:
            u, v = (x[a][: 9 - at], x[b][at:]) if at >= 0 else (x[a][-at:], x[b][: 9 + at])
            if np.ptp(u) and np.ptp(v):
                c = round(float(np.corrcoef(u, v)[0, 1]), 9)
                best = (c, at) if best is None or c > best[0] else best
        assert (score is None and best is None) or (lag == best[1] and score == pytest.approx(best[0], abs=2e-9))


@pytest.mark.parametrize("blocks", [1, 3])
def test_shared(spark, blocks, monkeypatch):
    rng = np.random.default_rng(3)
    sets = {i: sorted(set(rng.integers(0, 60, rng.integers(1, 12)).tolist())) for i in range(80)}
    df = spark.createDataFrame(list(sets.items()), "id long, x array<long>")
    got = {(r.x, r.y): r.n_shared for r in pairs.block_shared(df, blocks, 2).collect()}
    assert got == {(i, j): n for i in sets for j in sets if i < j and (n := len(set(sets[i]) & set(sets[j]))) >= 2}


def test_slices_cover_all():
    parts = list(pairs._slices(np.cumsum([5, 1, 9, 2, 2, 30]), 10))
    assert [(p.start, p.stop) for p in parts] == [(0, 2), (2, 3), (3, 5), (5, 6)]


def roads(spark):
    rng = np.random.default_rng(2)
    d = {}
    for a, b in rng.integers(0, 40, (150, 2)).tolist():
        if a != b:
            d[min(a, b), max(a, b)] = float(rng.integers(0, 4))
    ids = sorted({v for e in d for v in e})
    return ids, d, spark.createDataFrame([(v,) for v in ids], "id long"), spark.createDataFrame([(*k, v) for k, v in d.items()], "x long, y long, distance double")


def test_missing_pairs(spark):
    ids, d, nodes, known = roads(spark)
    gone = pairs.missing_pairs(nodes, known)
    assert "LeftAnti" not in plan(gone)
    found = [(r.x, r.y) for r in gone.collect()]
    assert len(found) == len(set(found)) and set(found) == {(a, b) for a in ids for b in ids if a < b} - d.keys()


@pytest.mark.parametrize("value", [0.0, 2.5])
def test_zero_profile(spark, value):
    ids, d, nodes, known = roads(spark)
    got = {(r.x, r.y): r for r in pairs.zero_profile(nodes, known, known.where(F.col("distance") == 0), value).collect()}
    assert got.keys() == {k for k, v in d.items() if v == 0}
    of = lambda a, b: d.get((min(a, b), max(a, b)), value)
    for (a, b), r in got.items():
        gaps = [abs(of(a, z) - of(b, z)) for z in ids if z not in (a, b)]
        assert (r.n_third, r.max_gap, r.median_gap) == (len(gaps), max(gaps), float(np.median(gaps)))


def test_small_tables_are_dealt_out(spark):
    """Very many pairs of two small tables are worked out in many tasks."""
    assert __spark_entry__.queries()["haversine_distance"](spark, SF).rdd.getNumPartitions() >= 256


def test_fast_rounding_is_half_up(spark):
    from meshwork.functions.scalar import rounded_fast

    df = spark.createDataFrame([(0.0,), (0.00005,), (12.34566,), (20015.08679,)], "v double")
    assert [r[0] for r in df.select(rounded_fast(F.col("v"), 4)).collect()] == [0.0, 0.0001, 12.3457, 20015.0868]


def test_shared_vertices_join_no_pairs(spark):
    """Pairs of polygons are no rows before they are counted."""
    text = plan(__spark_entry__.queries()["shared_vertex_pairs"](spark, SF))
    assert "FlatMapGroupsInArrow" in text and "SortMergeJoin" not in text and "BroadcastHashJoin" not in text


def test_overlaps_and_gaps_leave_no_join_to_a_broadcast(spark):
    q = __spark_entry__.queries()
    assert "Broadcast" not in plan(q["overlap_pairs"](spark, SF)) and "Broadcast" not in plan(q["gap_widths"](spark, SF))
