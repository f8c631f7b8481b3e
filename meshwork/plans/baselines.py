"""Validity of the labels against permuted labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshwork.operators import baseline, validity
from meshwork.plans.base import query
from meshwork.plans.panels import labels
from meshwork.plans.summaries import FEATURES, shares
from meshwork.session import materialize

N = 100


def labelled_shares(spark, sf):
    """(id, x, label): the shares of every supplier and quarter, labelled by the dominant category."""
    rows = labels(spark, sf).join(shares(spark, sf), ["id", "period"])
    key = F.col("id") * 100_000 + F.datediff("period", F.lit("1970-01-01"))
    return materialize(rows.select(key.alias("id"), F.array(*FEATURES).alias("x"), "label"))


@query()
def s_dbw_baseline(spark, sf):
    """S_Dbw of the dominant categories against 100 permutations of them, standardised, with an interval of 2,000 resamples."""
    rows = labelled_shares(spark, sf)
    return baseline.standing(validity.s_dbw(rows), baseline.Permuted(rows, N).s_dbw(), "s_dbw")
