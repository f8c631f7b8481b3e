"""Core members from counts by labels, against the co-occurrence of all pairs."""

import numpy as np

import __spark_entry__
from meshwork.operators import graph

SF = "/root/testdata/sf0.001"


def test_same_as_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 4, 60)
    rows = [(s, i * 3, int(base[i] if rng.random() < 0.8 else rng.integers(0, 5))) for s in range(4) for i in range(60)]
    rows += [(s, 999, 7) for s in range(4)]
    found = spark.createDataFrame(rows, "seed long, id long, label long")
    got = {r.id: tuple(r) for r in graph.core_of_runs(found, 4).collect()}
    pairs = graph.core_members(graph.cooccurrence(found, 4), found.where("seed = 0").select("id", "label"))
    want = {r.id: tuple(r) for r in pairs.collect()}
    assert got.keys() == want.keys() and len({w[3] for w in want.values()}) > 2 and got[999][2:] == want[999][2:] == (None, 0.0, True)
    assert all(got[i][1] == want[i][1] and got[i][3:] == want[i][3:] and (got[i][2] is None or abs(got[i][2] - want[i][2]) < 1e-12) for i in want)


def test_no_pairs_of_nodes(spark):
    """No self join of nodes on their community."""
    text = __spark_entry__.queries()["louvain_cooccurrence"](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert "(id#" not in "".join(x for x in text.splitlines() if "Join" in x and "<" in x)
