"""Shares on the edge of a bin, whatever the order of the sums."""

import datetime

import numpy as np

import __spark_entry__


def test_shares_on_an_edge(spark, tmp_path):
    rng, rows = np.random.default_rng(0), []
    for user in range(400):
        click = rng.integers(1, 9999, 3)
        rest = 3 * int(click.sum()) if user < 200 else int(click.sum())
        cuts = sorted(rng.integers(0, rest, 3).tolist())
        parts = np.diff([0, *cuts, rest]).tolist()
        for kind, cents in [*(("click", int(v)) for v in click), *zip(("view", "error", "signup", "view"), parts)]:
            rows.append((len(rows), datetime.datetime(2024, 1, 3, 12), user, kind, cents / 100))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").repartition(7).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.bin: r.n for r in __spark_entry__.queries()["share_hist_right_closed"](spark, str(tmp_path)).collect()}
    assert got == {"0-25": 200, "25-50": 200}
