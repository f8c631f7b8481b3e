"""Queries and their SQL read whole tables."""

import pytest

import __spark_entry__
import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


def same(spark, con, name, sf=SF):
    df = __spark_entry__.queries()[name](spark, sf)
    cur = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [x[0] for x in cur.description]
    want, got = compare.rows_of(columns, cur.fetchall()), compare.rows_of(df.columns, df.collect())
    assert sorted(columns) == sorted(df.columns) and got == want
    return got


def test_every_vector_has_neighbours_and_a_label(spark):
    q = __spark_entry__.queries()
    assert q["block_knn5"](spark, SF).select("src").distinct().count() == 500
    assert q["ward"](spark, SF).select("id").distinct().count() == 500


def test_cyclic_shift_has_rows(spark, con):
    """Every month of the orders but the one that isn't shifted."""
    months = con.execute("SELECT count(DISTINCT date_trunc('month', o_orderdate)) FROM orders").fetchone()[0]
    assert len(same(spark, con, "cyclic_shift")) == months - 1 > 0


def test_all_customers_and_roads(spark, con):
    sf = "/root/testdata/sf0.01"
    wide = compare.connect(sf)
    assert len(same(spark, wide, "haversine_distance", sf)) > 5000
    assert same(spark, wide, "shared_vertex_pairs", sf)
    ids = con.execute("SELECT count(*) FROM (SELECT o_custkey FROM orders UNION SELECT l_suppkey FROM lineitem)").fetchone()[0]
    assert len(same(spark, con, "missing_pairs_impute")) == ids * (ids - 1) // 2 > 60 * 59 // 2
    assert same(spark, con, "zero_distance_profile")


def test_anti_join_has_rows(spark):
    assert __spark_entry__.queries()["anti_join_missing"](spark, SF).count() > 0
