"""Summary operators where the queries' tables don't reach: failures, empty tables, nulls and ties."""

import pytest
from pyspark.sql import functions as F

from meshwork.operators import summary
from meshwork.operators.checks import CheckFailed


def test_merge_one_stops_on_none_and_on_several(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in summary.merge_one(left, right, ["k"]).collect()) == [(1, "a"), (2, "b")]
    for bad in ((3,), (4,)):
        with pytest.raises(CheckFailed):
            summary.merge_one(left.union(spark.createDataFrame([bad], "k int")), right, ["k"])


def test_versions_end_the_year_before_the_next(spark):
    rows = spark.createDataFrame([("a", 1990, 1), ("a", 1995, 2), ("a", 1995, 3), ("b", 2000, 4)], "k string, since int, v int")
    got = summary.valid_versions(rows, "k", "since", "v")
    assert {r.v: r.valid_to for r in got.collect()} == {1: 1994, 3: 9999, 4: 9999}
    at = lambda y: sorted(r.v for r in summary.valid_in(got, F.lit(y), "since").collect())
    assert (at(1989), at(1990), at(1994), at(1995), at(2000)) == ([], [1], [1], [3], [3, 4])


def test_month_rule_needs_enough_months(spark):
    rows = [("x", 0.01, 2.0, 1.0)] * 23 + [("x", 0.2, 2.0, 1.0)] + [("y", 0.01, 2.0, 1.0)] * 22 + [("y", 0.01, 1.0, 1.0), ("y", None, 2.0, 1.0)]
    got = summary.month_verdict(spark.createDataFrame(rows, "key string, p double, observed double, p95 double"), "key", 23)
    assert {r.key: (r.n, r.n_passed, r.holds) for r in got.collect()} == {"x": (24, 23, True), "y": (24, 22, False)}


def test_fields_are_quoted(spark):
    rows = spark.createDataFrame([(1, 'say "a";b', "1995-01-01")], "id int, label string, period string").withColumn("period", F.col("period").cast("date"))
    line = summary.export_lines(rows, ["1995-01-01", "1995-04-01"]).first()["line"]
    assert line == '"1";"say ""a"";b";'


def test_detour_over_no_distance_is_null(spark):
    rows = spark.createDataFrame([(3.0, 2.0), (4.0, 2.0), (1.0, 0.0)], "road double, straight double")
    got = summary.detours(rows, F.col("road"), F.col("straight"), 1.5).collect()
    assert [(r.detour, r.long_way) for r in got] == [(1.5, False), (2.0, True), (None, False)]


def test_captions_leave_out_weak_and_constant_features(spark):
    rows = spark.createDataFrame([("a", 0.0, 1.0, 5.0), ("b", 2.0, 1.0, 5.0), ("b", 2.0, 1.1, 5.0), ("a", 0.0, 1.1, 5.0)], "label string, x double, y double, c double")
    got = summary.profile(rows, ["x", "y", "c"]).select("label", "n", "z_c", summary.caption(["x", "y", "c"]).alias("caption"))
    assert {tuple(r) for r in got.collect()} == {("a", 2, None, "x↓1.00σ"), ("b", 2, None, "x↑1.00σ")}


def test_a_peak_is_above_both_neighbours(spark):
    got = summary.kinks(spark.createDataFrame([(4, 1.0), (5, 3.0), (6, 2.0), (7, 2.0), (8, 5.0)], "k int, y double"), "k", "y").orderBy("k").collect()
    assert [(r.step, r.kink, r.peak) for r in got] == [(None, False, False), (2.0, True, True), (-1.0, False, False), (0.0, False, False), (3.0, False, False)]


def test_empty_tables_give_no_rows(spark):
    labels = spark.createDataFrame([], "id int, period date, label string")
    assert summary.aligned(labels, F.lit("1996-04-01").cast("date")).count() == 0
    assert summary.composition(labels, "id").count() == 0
    assert summary.label_at(labels, labels, "none").count() == 0
    assert summary.union_first(labels, labels, ["id"]).count() == 0
    assert summary.median_gap(spark.createDataFrame([], "g string, x double, y double"), "g", "a", "b", "x", "y").first()["actual"] is None


def test_labels_outside_the_anchor_align_to_nothing(spark):
    rows = spark.createDataFrame([(1, "1995-01-01", "p"), (2, "1995-01-01", "q"), (1, "1996-04-01", "r")], "id int, period string, label string").withColumn("period", F.col("period").cast("date"))
    got = {(r.id, str(r.period)): r.aligned for r in summary.aligned(rows, F.lit("1996-04-01").cast("date")).collect()}
    assert got == {(1, "1995-01-01"): "r", (2, "1995-01-01"): None, (1, "1996-04-01"): "r"}
