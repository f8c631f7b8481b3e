"""Permuted labels: sizes, uniformity, S_Dbw against the operator for one labelling, and standing against plain Python."""

import random
from collections import Counter
from itertools import permutations
from statistics import mean, stdev

import pytest

from meshwork.operators import baseline, validity

SCHEMA = "id long, x array<double>, label string"


@pytest.mark.parametrize("block", [3, 4096])
def test_labels_are_uniform(spark, block):
    df = spark.createDataFrame([(i, [float(i)], "aabbc"[i]) for i in range(5)], SCHEMA)
    drawn = {}
    for r in baseline.Permuted(df, 3000, seed=4, block=block).labelled().collect():
        drawn.setdefault(r.perm, {})[r.id] = r.label
    seen = Counter("".join(v[i] for i in range(5)) for v in drawn.values())
    exact = set(permutations("aabbc"))
    assert set(seen) == {"".join(e) for e in exact} and sum(seen.values()) == 3000
    chi = sum((c - 3000 / len(exact)) ** 2 / (3000 / len(exact)) for c in seen.values())
    assert chi < len(exact) + 5 * (2 * len(exact)) ** 0.5


@pytest.mark.parametrize("block", [16, 4096])
def test_same_index_as_for_one_labelling(spark, block):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(3 * (i % 3 == 0), 1), rng.choice([0.0, rng.gauss(0, 1)])], "abc"[i % 3]) for i in range(120)]
    df = spark.createDataFrame([*rows, (500, None, "a"), (501, [1.0, 1.0], None)], SCHEMA)
    p = baseline.Permuted(df, 4, seed=1, block=block)
    got = {r.perm: r for r in p.s_dbw().collect()}
    drawn = p.labelled().collect()
    assert len(got) == 4 and len(drawn) == 480
    x = {i: v for i, v, _ in rows}
    for perm, r in got.items():
        own = spark.createDataFrame([(d.id, x[d.id], d.label) for d in drawn if d.perm == perm], SCHEMA)
        want = validity.s_dbw(own).first()
        assert (r.scat, r.dens_bw, r.s_dbw) == pytest.approx((want.scat, want.dens_bw, want.s_dbw), abs=1e-9)


def test_standing(spark):
    values = [1.0, 1.1, 1.3, 0.9, 1.05, 1.2]
    real, null = spark.createDataFrame([(0.5,)], "s double"), spark.createDataFrame([(v,) for v in values], "s double")
    r = baseline.standing(real, null, "s", draws=500).first()
    z = (0.5 - mean(values)) / stdev(values)
    assert (r.value, r.mean, r.std, r.z) == pytest.approx((0.5, mean(values), stdev(values), z)) and r.low < z < r.high and r.undefined == 0
    broken = baseline.standing(real, spark.createDataFrame([(1.0,), (None,)], "s double"), "s", draws=10).first()
    assert broken.z is None and broken.undefined == 1


def test_too_many_centres(spark, monkeypatch):
    monkeypatch.setattr(baseline, "MOST", 3)
    with pytest.raises(ValueError, match="fewer permutations"):
        baseline.Permuted(spark.createDataFrame([(1, [1.0], "a"), (2, [2.0], "b")], SCHEMA), 2)
