"""Bootstrapped rank correlations against repeated rows in plain Python."""

import random

import numpy as np
import pytest

from meshwork.operators import resample, rho


def ranks(v):
    s = sorted(v)
    first, last = {}, {}
    for i, e in enumerate(s, 1):
        first.setdefault(e, i)
        last[e] = i
    return [(first[e] + last[e]) / 2 for e in v]


def plain(rows, weights, within):
    drawn = [row for row, w in zip(rows, weights) for _ in range(w)]
    u, v = [], []
    for key in sorted({r[3] for r in drawn}) if within else [None]:
        part = [r for r in drawn if key is None or r[3] == key]
        for out, at in ((u, 1), (v, 2)):
            own = ranks([r[at] for r in part])
            out += [(k - 0.5) / len(part) for k in own] if within else own
    if len(set(u)) < 2 or len(set(v)) < 2:
        return None
    return float(np.corrcoef(u, v)[0, 1])


@pytest.mark.parametrize("region", [None, "r"])
def test_draws_against_repeated_rows(spark, region):
    """Half of the rows hold one value of x, so it gets a range of its own; ties and ranges of few rows abound."""
    rng = random.Random(5)
    rows = []
    for i in range(240):
        x = rng.choice([2.0, 2.0, rng.gauss(2, 2), float(rng.randint(0, 5))])
        rows.append((i * 7, x, x + rng.choice([0.0, rng.gauss(0, 3)]), rng.choice("pqq")))
    df = spark.createDataFrame([*rows, (9000, None, 1.0, "p"), (9001, 1.0, None, "q")], "id long, x double, y double, r string")
    n = 520  # more than a batch
    got = {r.draw: r.rho for r in rho.bootstrap_draws(df, "id", "x", "y", n, region, size=20).collect()}
    w = resample.poisson_weights(np.array([r[0] for r in rows]), np.arange(n))
    assert set(got) == set(range(n))
    for d in range(n):
        assert got[d] == pytest.approx(plain(rows, w[:, d], region is not None), abs=1e-9)
    b = rho.bootstrap_rho(df, "id", "x", "y", 100, region).first()
    assert b.rho == pytest.approx(plain(rows, [1] * len(rows), region is not None), abs=1e-9)
    assert b.low < b.rho < b.high and (b.n_rows, b.n_draws) == (240, 100)


def test_no_spread_and_no_rows(spark):
    df = spark.createDataFrame([(i, 1.0, float(i)) for i in range(9)], "id long, x double, y double")
    assert all(r.rho is None for r in rho.bootstrap_draws(df, "id", "x", "y", 5).collect())
    assert rho.bootstrap_draws(df.limit(0), "id", "x", "y", 5).count() == 0
