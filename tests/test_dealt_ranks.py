"""Ranks dealt to groups by random bytes, and by counts of equal ranks, against enumeration."""

from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from meshwork.operators import rank, resample
from meshwork.plans import verdicts


@pytest.mark.parametrize("many, by_bytes", [(64, 1), (1, 1), (2, 1), (2, 99)])
def test_all_arrangements_are_equally_likely(monkeypatch, many, by_bytes):
    """Single rows by bytes, all rows by counts, and both in one block."""
    monkeypatch.setattr(resample, "MANY", many)
    monkeypatch.setattr(resample, "BYTES", by_bytes)
    ranks, times, counts = np.array([1.0, 2.0, 4.0, 6.0, 7.0]), np.array([1, 1, 3, 1, 1]), [1, 4, 2]
    n = 20_000
    got = Counter(map(tuple, resample._sums(np.random.default_rng(5), ranks, times, np.tile(counts, (n, 1)))))
    exact = Counter(tuple(np.bincount(p, np.repeat(ranks, times), 3)) for p in permutations([0, 1, 1, 1, 1, 2, 2]))
    assert set(got) == set(exact) and sum(got.values()) == n
    chi = sum((got[k] - n * c / exact.total()) ** 2 / (n * c / exact.total()) for k, c in exact.items())
    assert chi < len(exact) + 5 * (2 * len(exact)) ** 0.5


def test_small_groups_and_large_blocks():
    """Groups of less than a byte's share and none at all; the counts are met, and sums have the hypergeometric mean and variance."""
    m, counts = 5000, np.array([3, 0, 1500, 3497])
    rows = np.arange(1.0, m + 1)
    s = resample._sums(np.random.default_rng(1), rows, np.ones(m, int), np.tile(counts, (3000, 1)))
    assert (s.sum(axis=1) == rows.sum()).all() and (s[:, 1] == 0).all()
    for g in (0, 2):
        mean, var = counts[g] * (m + 1) / 2, counts[g] * (m - counts[g]) * (m + 1) / 12
        assert abs(s[:, g].mean() - mean) < 5 * (var / 3000) ** 0.5 and abs(s[:, g].var() / var - 1) < 0.15


def test_ranks_of_many_ranges(spark):
    """Values in nearly all ranges of both levels, and ties."""
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=9000), 4)
    df = spark.createDataFrame([(int(i % 2), float(x)) for i, x in enumerate(v)], "k int, x double")
    got = {(r.k, r.x): (r["rank"], r.rank_n) for r in rank.with_ranks(df, "x", by=["k"]).collect()}
    for k in (0, 1):
        own = np.sort(v[k::2])
        for x in own:
            assert got[k, x] == ((np.searchsorted(own, x, "left") + np.searchsorted(own, x, "right") + 1) / 2, len(own))


def test_verdicts_read_tests_that_were_written(spark, monkeypatch):
    """The six tests are drawn once, however often their rows are read."""
    monkeypatch.setattr(verdicts, "N", 20)
    df = verdicts.verdict_stages(spark, "/root/testdata/sf0.001")
    assert "MapInPandas" not in df._jdf.queryExecution().toString() and df.count() == 3
