"""Verdicts and names by cases worked out by hand."""

import pytest

from meshwork.operators import verdicts

SCHEMA = "hypothesis string, variable string, level string, family string, p double, confirmed boolean, observed double, size string, benchmark double, opposite boolean"


def rows(spark):
    return spark.createDataFrame(
        [
            ("A", "a", "all", "main", 0.01, True, 0.2, "large", 0.4, None),
            ("A", "a", "within", "inner", 0.02, True, 0.02, "small", 0.4, None),
            ("B", "b", "all", "main", 0.03, True, 0.1, "medium", 0.0, None),  # 0.03 * 1, not below the 0.02 of its elder
            ("B", "b", "within", "inner", 0.03, True, 0.1, "medium", 0.1, True),
            ("C", "c", "all", None, 0.049, True, 0.1, "medium", 0.1, None),  # not adjusted
            ("C", "c", "within", None, 0.001, False, 0.1, "medium", 0.1, None),  # its rule did not confirm it
            ("D", "d", "all", "main", 0.9, False, 0.0, "negligible", 0.1, None),
        ],
        SCHEMA,
    )


def test_levels_and_stages(spark):
    out = verdicts.assemble(rows(spark))
    got = {(r.hypothesis, r.level): r for r in out.collect()}
    assert [got[k].p_holm for k in [("A", "all"), ("B", "all"), ("D", "all"), ("C", "all")]] == [pytest.approx(0.03), pytest.approx(0.06), pytest.approx(0.9), None]
    assert {k for k, r in got.items() if r.result == verdicts.CONFIRMED} == {("A", "all"), ("A", "within"), ("B", "within"), ("C", "all")}
    assert got["A", "all"].to_benchmark == pytest.approx(0.5) and got["A", "within"].to_benchmark is None and got["B", "all"].to_benchmark is None
    assert (got["A", "within"].note, got["B", "within"].note, got["C", "all"].note, got["A", "all"].note) == (verdicts.SMALL, verdicts.OPPOSITE, verdicts.EXPLORATORY, "")
    s = {r.hypothesis: (r.stage, r.note) for r in verdicts.stages(out).collect()}
    assert s["A"] == ("confirmed at both levels", f"within: {verdicts.SMALL}") and s["B"] == ("confirmed within regions only", f"within: {verdicts.OPPOSITE}")
    assert s["C"] == ("confirmed over all rows only", "all: exploratory | within: exploratory") and s["D"] == (None, "")


def test_a_test_without_p_stops(spark):
    broken = spark.createDataFrame([("A", "a", "all", "main", None, True, 0.2, "large", 0.4, None)], SCHEMA)
    with pytest.raises(Exception, match="no p or no rule for A, all"):
        verdicts.assemble(broken).collect()


def test_names(spark):
    df = spark.createDataFrame([(1, 0.9, 0.8, -1.2, -0.55, 1.5), (2, 0.4, 0.9, 0.9, -0.9, 0.5), (3, 0.6, None, -0.5, -0.5, None)], "label int, z_a double, other_a double, z_b double, other_b double, size double")
    n = {r.label: (r.name, r.border) for r in verdicts.type_names(df, ["a", "b"], [("size", ">=", 1.5, "large"), ("size", "<=", 0.5, "small")], 0.5, 0.1).collect()}
    assert n == {1: ("b lower, a higher · large", "b"), 2: ("no distinct profile · small", ""), 3: ("b lower", "b")}
