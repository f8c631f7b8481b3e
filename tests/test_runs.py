"""Comparison of partitions against plain Python."""

import random
from collections import Counter
from itertools import combinations, permutations

import pytest

from meshwork.operators import runs as O


def plain_ari(x, y):
    two = lambda n: n * (n - 1) / 2
    same = sum(two(n) for n in Counter(zip(x, y)).values())
    a, b = (sum(two(n) for n in Counter(v).values()) for v in (x, y))
    e = a * b / two(len(x))
    return (same - e) / ((a + b) / 2 - e)


@pytest.fixture(scope="module")
def table():
    rng = random.Random(3)
    base = [rng.randrange(4) for _ in range(60)]
    out = {r: [rng.randrange(4) if rng.random() < 0.12 * (r % 4) else (b + r) % 4 for b in base] for r in range(9)}
    out[9] = out[0]
    return out


@pytest.fixture(scope="module")
def runs(spark, table):
    return spark.createDataFrame([(r, i, v) for r, x in table.items() for i, v in enumerate(x) if (r, i) != (2, 5)], "run int, id long, label int")


def test_pairs(runs, table):
    got = {(r.a, r.b): (r.n, r.ari) for r in O.pairwise_ari(runs).collect()}
    assert got.keys() == set(combinations(range(10), 2))
    for (a, b), (n, v) in got.items():
        keep = [i for i in range(60) if i != 5 or 2 not in (a, b)]
        assert n == len(keep) and abs(v - plain_ari([table[a][i] for i in keep], [table[b][i] for i in keep])) < 1e-9
    assert got[0, 9][1] == 1.0


def test_groups(spark, runs, table):
    cost = {r: (r * 7 % 10) / 10 for r in range(10)}
    pairs = O.pairwise_ari(runs)
    ari = {frozenset((r.a, r.b)): r.ari for r in pairs.collect()}
    got = {r.run: r.first for r in O.alike(spark.createDataFrame(list(cost.items()), "run int, cost double"), pairs, 0.6).collect()}
    want, order = {}, sorted(cost, key=lambda r: (cost[r], r))
    for r in order:
        want[r] = next((x for x in order if want.get(x) == x and ari[frozenset((x, r))] >= 0.6), r)
    assert got == want and len(set(got.values())) > 1
    near = O.near_best(spark.createDataFrame(list(cost.items()), "run int, cost double"), 0.25).collect()
    assert {r.run for r in near} == {r for r, c in cost.items() if c <= 0.25}


def test_best_and_disjoint(spark, runs):
    pairs = O.pairwise_ari(runs)
    scores = spark.createDataFrame([(r, [3.0, 9.0, 9.0][r % 3] - (r > 5)) for r in range(10)], "run int, score double")
    b = O.best_against_rest(scores, pairs, 0.5).first()
    assert (b.best, b.n) == (1, 9) and -1 <= b.rho <= 1 and 0 <= b.share_high <= 1
    d = O.disjoint_pairs(runs, pairs, 4).collect()
    assert len(d) == 4 and len({x for r in d for x in (r.a, r.b)}) == 8
    assert [(r.k, r.n_runs, r.is_mode) for r in O.label_counts(runs).collect()] == [(4, 10, True)]


def test_mobile(spark, runs, table):
    canonical = spark.createDataFrame(list(enumerate(table[0])), "id long, label int")
    moved = set()
    for r, x in table.items():
        keep = [i for i in range(60) if (r, i) != (2, 5)]
        best = max(permutations(range(4)), key=lambda p: sum(p[x[i]] == table[0][i] for i in keep))
        moved |= {i for i in keep if best[x[i]] != table[0][i]}
    s = O.mobile_share(runs, canonical).first()
    assert abs(s.share - len(moved) / 60) < 1e-9 and s.n_nodes == 60
    few = spark.createDataFrame([(0, i, i % 3) for i in range(30)], "run int, id long, label int")
    one = spark.createDataFrame([(i, 7) for i in range(30)], "id long, label int")
    assert {r.label for r in O.matched(few, one).collect()} == {7, None}
