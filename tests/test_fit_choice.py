"""Tables that are too large for a task are fitted by blocks."""

import __spark_entry__
from meshwork.operators import cluster, whole

SF = "/root/testdata/sf0.001"


def test_confidence_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(whole, "FITTED", 100)
    monkeypatch.setattr(cluster, "fits", None)
    rows = __spark_entry__.queries()["membership_confidence"](spark, SF).collect()
    assert len(rows) == 500 and all(0 <= r["confidence"] <= 1 for r in rows)
