"""k-means over every quarter, k and seed at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshwork.operators import fits as O
from meshwork.operators import outside
from meshwork.plans.base import query
from meshwork.plans.outside import share_rows
from meshwork.session import materialize
from meshwork.sources import fixtures as fx

KS, SEEDS, ROUNDS = [3, 4, 5, 6, 7, 8], 10, 12


def nodes(spark, sf):
    """(period, id, x): a supplier's shares under the quarter's scaler."""
    rows = materialize(share_rows(spark, sf))
    z = outside.scaled(rows, outside.month_scalers(rows, fx.TYPES, "period"), fx.TYPES, "period")
    return materialize(z.select("period", "id", F.col("z").alias("x")))


def fitted(spark, sf):
    n = nodes(spark, sf)
    return n, O.lloyd(n, O.seeded(n, "period", KS, SEEDS), ROUNDS)


@query()
def k_over_periods(spark, sf):
    """Inertia, Calinski-Harabasz index and simplified silhouette of the best of ten seeds, for every quarter and k."""
    return O.best_seeds(O.indices(*fitted(spark, sf)), "period")


@query()
def k_stability_curve(spark, sf):
    """How alike ten seeds are in every quarter, by k."""
    n, f = fitted(spark, sf)
    return O.stability_curve(O.seed_agreement(n, f), O.indices(n, f), "period")
