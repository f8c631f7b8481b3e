"""As-of join, assignment and pruning of months."""

import bisect
import math
import random

from meshwork.operators import outside as O
from meshwork.plans import outside as P

SF = "/root/testdata/sf0.001"


def test_asof_against_search(spark):
    rng = random.Random(5)
    right = {(k, t): float(t * 10 + k) for k in range(4) for t in rng.sample(range(50), 9)}
    left = [(i, rng.randrange(5), rng.randrange(50)) for i in range(200)] + [(900, None, 3), (901, 1, None)]
    l = spark.createDataFrame(left, "i int, k int, t int")
    r = spark.createDataFrame([(k, t, v) for (k, t), v in right.items()], "k int, t int, v double")
    got = O.asof_join(l, r, ["k"], "t", ["v"]).collect()
    assert len(got) == len(left)
    for row in got:
        times = sorted(t for k, t in right if k == row.k) if row.t is not None else []
        at = bisect.bisect_right(times, row.t) - 1 if times else -1
        want = (times[at], right[row.k, times[at]]) if at >= 0 else (None, None)
        assert (row.t_seen, row.v) == want
    assert O.asof_join(l.limit(0), r, ["k"], "t", ["v"]).count() == 0


def test_assignment(spark):
    z = spark.createDataFrame([(1, [0.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (3, [9.0, 0.0], "b")], "id int, z array<double>, label string")
    c = O.centres(z, 2)
    assert [(r["label"], list(r["c"])) for r in c.first().centres] == [("a", [1.0, 0.0]), ("b", [9.0, 0.0])]
    rows = spark.createDataFrame([(1, [1.0, 1.0], 2.0), (2, [5.0, 0.0], 9.0), (3, [1.0, 8.0], 2.0), (4, None, None)], "id int, z array<double>, d_max double")
    got = {r.id: (r.label, r.status, r.d1) for r in O.assign(rows, c).collect()}
    assert got == {1: ("a", "assigned", 1.0), 2: ("a", "assigned", 4.0), 3: (None, "far", 8.0), 4: (None, "none", None)}
    one = O.assign(rows.where("id = 1"), c).first()
    assert math.isclose(one.ratio, 1 / math.sqrt(65), rel_tol=1e-6)


def test_only_wanted_months_are_read(spark):
    plan = P.pruned_months(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan[plan.index("PartitionFilters") :]
    one = P.by_month(spark, SF).where("month = '1998-03'")
    filters = one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    assert "= 1998-03)], PushedFilters" in filters
    assert {r.month for r in one.select("month").distinct().collect()} == {"1998-03"}


def test_statuses_occur(spark):
    kinds = {r.status for r in P.types_outside_sample(spark, "/root/testdata/sf0.01").select("status").distinct().collect()}
    assert "assigned" in kinds
