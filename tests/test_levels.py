"""Join counts against all permutations; guarded deviations."""

from itertools import permutations
from statistics import fmean, median, pstdev

from meshwork.operators import graph, summary


def test_join_counts_against_all_permutations(spark):
    edges = [(0, 1), (0, 2), (1, 2), (2, 3), (4, 5), (0, 6)]
    label = ["a", "a", "b", "b", "b", "c", "a"]
    counts = [sum(p[x] == p[y] for x, y in edges) for p in permutations(label)]
    e = spark.createDataFrame([(x, y, 1.0) for x, y in edges], "x long, y long, score double")
    r = graph.label_joins(spark.createDataFrame(list(enumerate(label)), "id long, label string"), e).first()
    seen = sum(label[x] == label[y] for x, y in edges)
    assert r.n_within == seen
    assert abs(r.expected - fmean(counts)) < 1e-9 and abs(r.deviation - pstdev(counts)) < 1e-9
    assert abs(r.z - (seen - fmean(counts)) / pstdev(counts)) < 1e-9


def test_one_label_has_no_z(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (2, 3, 1.0)], "x long, y long, score double")
    r = graph.label_joins(spark.createDataFrame([(i, "a") for i in range(5)], "id long, label string"), e).first()
    assert (r.n_within, r.expected, r.z) == (2, 2.0, None)


def test_guard(spark):
    rows = [("a", 0.2), ("a", 0.4), ("b", 0.0), ("b", 0.0), ("b", 0.0)]
    got = {r.g: r for r in summary.guarded_deviation(spark.createDataFrame(rows, "g string, v double"), "g", "v", 0.005).collect()}
    m = fmean(v for _, v in rows)
    assert abs(got["a"].d_mean - (0.3 - m) / m) < 1e-12 and got["b"].d_mean == -1.0
    assert median(v for _, v in rows) == 0.0 and got["a"].d_median is None and got["b"].n == 3
