"""A digest of all edges is of the sorted lines, however many ranges they fall into, and no cell holds them all."""

import hashlib

import __spark_entry__
from meshwork.operators import graph

SF = "/root/testdata/sf0.001"


def test_lines_in_order(spark):
    keys = [f"{i}:{j}" for i in range(40) for j in range(i, 300)]
    lines = spark.createDataFrame([(k, f"{k}:x") for k in reversed(keys)], "k string, line string").repartition(7)
    row = graph.digest(lines, ";").first()
    assert row.n == len(keys) and row.sha256 == hashlib.sha256(";".join(f"{k}:x" for k in sorted(keys)).encode()).hexdigest()
    assert graph.digest(lines.limit(0), ";").first() == (hashlib.sha256(b"").hexdigest(), 0)


def test_no_list_of_all_edges(spark):
    assert "collect_list" not in __spark_entry__.queries()["adjacency_digest"](spark, SF)._jdf.queryExecution().toString()
