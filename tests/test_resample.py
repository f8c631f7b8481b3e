"""Permutations and bootstraps against enumeration and plain Python."""

import random
from collections import Counter
from itertools import combinations, permutations, product
from statistics import median

import numpy as np
import pytest

from meshwork.operators import resample


def plain_eta(ranks, labels):
    n, groups = len(ranks), sorted(set(labels))
    ties = sum(c**3 - c for c in Counter(ranks).values())
    q = sum(sum(r for r, g in zip(ranks, labels) if g == k) ** 2 / labels.count(k) for k in groups)
    h = (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n**3 - n))
    return round(max(0.0, (h - len(groups) + 1) / (n - len(groups))), 9)


@pytest.mark.parametrize("block", [2, 1 << 16])
def test_null_is_the_uniform_one(spark, block):
    """Every split of eight rows, whether the rows lie in one block or in several."""
    y = [1.0, 2.0, 3.0, 3.0, 5.0, 6.0, 7.5, 9.0]
    df = spark.createDataFrame([(i, v, "a" if i < 3 else "b") for i, v in enumerate(y)], "id long, y double, g string")
    test = resample.Ranked(df, "id", "y", "g")
    null = Counter(round(r.eta2, 9) for r in test.null(8000, seed=block, block=block).collect())
    ranks = [1, 2, 3.5, 3.5, 5, 6, 7, 8]
    exact = Counter(plain_eta(ranks, ["a" if i in c else "b" for i in range(8)]) for c in combinations(range(8), 3))
    assert set(null) == set(exact) and sum(null.values()) == 8000
    chi = sum((null[k] - 8000 * n / 56) ** 2 / (8000 * n / 56) for k, n in exact.items())
    assert chi < len(exact) + 5 * (2 * len(exact)) ** 0.5
    assert round(test.observed().first().eta2, 9) == plain_eta(ranks, list("aaabbbbb"))


def test_null_within_regions(spark):
    """Labels stay in their regions: the null is that of all permutations within them."""
    rows = [(0, "r", 1.0, "a"), (1, "r", 2.0, "b"), (2, "r", 4.0, "c"), (3, "s", 3.0, "a"), (4, "s", 9.0, "a"), (5, "s", 8.0, "b")]
    df = spark.createDataFrame(rows, "id long, r string, y double, g string")
    null = Counter(round(r.eta2, 9) for r in resample.Ranked(df, "id", "y", "g", region="r").null(6000, seed=3).collect())
    ranks = [1.5, 3.5, 5.5, 1.5, 5.5, 3.5]
    exact = Counter(plain_eta(ranks, list(p + q)) for p, q in product(permutations("abc"), permutations("aab")))
    assert set(null) == set(exact)
    chi = sum((null[k] - 6000 * n / 36) ** 2 / (6000 * n / 36) for k, n in exact.items())
    assert chi < len(exact) + 5 * (2 * len(exact)) ** 0.5


def test_permutation_test_by_key(spark):
    rng = random.Random(1)
    rows = [(i, i % 2, rng.gauss(3.0 * (i % 2) * (i % 4 > 1), 1), "ab"[i % 4 > 1]) for i in range(400)] + [(900, 0, None, "a"), (901, 1, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, m int, y double, g string")
    t = {r.m: r for r in resample.permutation_test(df, "id", "y", "g", 1000, by=["m"]).collect()}
    assert t[1].p == 1 / 1001 and t[1].observed > t[1].p99 >= t[1].p95 and t[0].p > 0.001 and t[0].n_perm == 1000
    v = resample.verdict(resample.permutation_test(df, "id", "y", "g", 1000, by=["m"]), "m", resample.F.lit(1), 0.05, 1).first()
    assert (v.holds, v.n_periods) == (True, 2)


def test_weights_are_poisson():
    w = resample.poisson_weights(np.arange(2000), np.arange(500))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.1 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.2


def test_medians_against_repeated_rows(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([5.0, 5.0, rng.gauss(5, 1), float(rng.randint(0, 9))]), rng.choice("aab")) for i in range(300)] + [(300, None, "a"), (301, 1.0, None), (302, 7.0, "c")]
    df = spark.createDataFrame(rows, "id long, x double, g string")
    got = {(r.g, r.draw): r.median for r in resample.bootstrap_medians(df, "id", "x", "g", 60, ranges=6).collect()}
    w = resample.poisson_weights(np.array([i for i, _, _ in rows]), np.arange(60))
    want = {}
    for g in "abc":
        for d in range(60):
            repeated = [x for k, (i, x, own) in enumerate(rows) if own == g and x is not None for _ in range(w[k, d])]
            if repeated:
                want[g, d] = median(repeated)
    assert got == want
    b = resample.bootstrap_gaps(df, "id", "x", "g", [("a", "b")], 60).first()
    assert b.low <= b.high and b.n == 60
