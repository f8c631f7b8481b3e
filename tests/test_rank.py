"""Ranks by ranges of values, held against plain Python."""

import random
import re
from collections import defaultdict

import pytest

from meshwork.operators import rank


def plain(values):
    """Average ranks of a list; None has none."""
    order = sorted(v for v in values if v is not None)
    return [None if v is None else order.index(v) + 1 + (order.count(v) - 1) / 2 for v in values]


def table(n, seed):
    rng = random.Random(seed)
    pick = [lambda: 7.0, lambda: rng.gauss(0, 1), lambda: float(rng.randint(0, 9)), lambda: 10.0 ** rng.randint(-300, 300), lambda: None]
    return [(i, rng.choice("aab"), rng.choices(pick, [3, 4, 2, 1, 1])[0]()) for i in range(n)]


@pytest.mark.parametrize(("n", "ranges"), [(1, 4), (600, 3), (600, 64)])
def test_ranks(spark, n, ranges):
    rows = table(n, n + ranges)
    df = spark.createDataFrame(rows, "id long, g string, x double")
    got = {r.id: (r["rank"], r["rank_n"]) for r in rank.with_ranks(df, "x", ranges=ranges).collect()}
    want = plain([x for _, _, x in rows])
    assert len(got) == n and [got[i][0] for i, _, _ in rows] == want
    keyed = {r.id: r["k"] for r in rank.with_ranks(df, "x", "k", ["g"], ranges).collect()}
    by = defaultdict(list)
    for i, g, x in rows:
        by[g].append((i, x))
    for g in by.values():
        assert [keyed[i] for i, _ in g] == plain([x for _, x in g])


def test_empty(spark):
    assert rank.with_ranks(spark.createDataFrame([], "id long, x double"), "x").count() == 0


def test_no_task_ranks_the_whole_table(spark):
    """Windows have keys, and a key is a range, not a group of any size."""
    df = spark.createDataFrame(table(300, 1), "id long, g string, x double")
    for by in ([], ["g"]):
        plan = rank.with_ranks(df, "x", by=by)._jdf.queryExecution().optimizedPlan().toString()
        specs = re.findall(r"windowspecdefinition\(([^()]*)", plan)
        assert specs and all("_q#" in s.split(" ASC")[0] for s in specs)
        assert "Cartesian" not in plan


def test_within(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "a", 7.0), (3, "b", 1.0)], "id long, g string, x double")
    assert {r.id: r.w for r in rank.with_within_ranks(df, "x", "w", ["g"]).collect()} == {1: 0.25, 2: 0.75, 3: 0.5}
