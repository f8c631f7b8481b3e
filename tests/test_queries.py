"""Every query that has SQL gives the rows of DuckDB on the smallest tables; the others keep their invariants."""

import pytest

import __spark_entry__
import compare
from meshwork.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, con, name):
    ok, note = compare.compare(spark, con, SF, name)
    assert ok, note


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_louvain_beats_the_given_labels(spark):
    q = registry.queries()
    best = q["louvain_best"](spark, SF).first()["modularity"]
    assert best > q["modularity_mq"](spark, SF).first()["modularity"]


def test_runs_give_whole_partitions(spark):
    for name in ("kmeans_best_of_seeds", "gmm_best", "ward", "spectral"):
        df = registry.queries()[name](spark, SF)
        assert df.select("id").distinct().count() == df.count() == 500


def test_bounded_statistics(spark):
    q = registry.queries()
    p = q["prediction_strength"](spark, SF).first()
    assert 0 <= p["p10"] <= p["mean"] <= 1 and p["n"] == 20
    assert -0.2 < q["adjusted_mutual_information"](spark, SF).first()["ami"] < 1
    assert all(0 <= r["confidence"] <= 1 for r in q["membership_confidence"](spark, SF).collect())
    b = q["bootstrap_delta"](spark, SF).first()
    assert b["low"] <= b["high"] and b["n"] == 200
