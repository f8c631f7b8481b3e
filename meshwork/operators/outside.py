"""Types for nodes outside the sample: an as-of join, monthly scalers, eligibility and assignment with a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.functions.scalar import ratio


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str]) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` at or before its ``at``, under the same ``by``; null where there is none.

    Both sides are sorted as one table within a key, and a window carries the last row of ``right`` forward: no pair of rows is
    made. ``right`` has one row for each (by, at). A key's rows meet in one task, by a sort that spills.
    """
    rows = left.columns
    l = left.select(F.struct(*rows).alias("_row"), *by, at, F.lit(1).alias("_side"), *[F.lit(None).cast(dict(right.dtypes)[v]).alias(f"_v_{v}") for v in values], F.lit(None).cast(dict(right.dtypes)[at]).alias("_at"))
    r = right.select(F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), *by, at, F.lit(0).alias("_side"), *[F.col(v).alias(f"_v_{v}") for v in values], F.col(at).alias("_at"))
    w = Window.partitionBy(*by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.last(F.when(F.col("_side") == 0, F.struct(*[f"_v_{v}" for v in values], "_at")), ignorenulls=True).over(w)
    out = l.unionByName(r).withColumn("_seen", seen).where("_side = 1")
    return out.select("_row.*", *[F.col(f"_seen._v_{v}").alias(v) for v in values], F.col("_seen._at").alias(f"{at}_seen"))


def month_scalers(sample: DataFrame, features: list[str], period: str) -> DataFrame:
    """(period, m_<feature>, s_<feature>): means and population deviations of the sample's features in each period."""
    return sample.groupBy(period).agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features])


def scaled(rows: DataFrame, scalers: DataFrame, features: list[str], period: str) -> DataFrame:
    """Adds ``z``, the features under the period's scaler; a feature that doesn't vary counts as zero."""
    z = [F.coalesce(ratio(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")), F.lit(0.0)) for c in features]
    return rows.join(scalers, period).withColumn("z", F.array(*z)).drop(*[f"{p}_{c}" for c in features for p in "ms"])


def centres(sample: DataFrame, n: int) -> DataFrame:
    """One row: ``centres``, the array of (label, c), labels in order, with the means of ``z``."""
    g = sample.groupBy("label").agg(F.array(*[F.avg(F.col("z")[i]) for i in range(n)]).alias("c"))
    return g.agg(F.sort_array(F.collect_list(F.struct("label", "c"))).alias("centres"))


def nearest(z: Column, centres: Column) -> Column:
    """Struct (d1, label, d2): the nearest centre, ties to the first label, and the distances to it and to the second."""
    d = lambda c: F.sqrt(F.aggregate(F.zip_with(z, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    order = F.sort_array(F.transform(centres, lambda r: F.struct(F.round(d(r["c"]), 9).alias("d"), r["label"].alias("label"))))
    return F.struct(order[0]["d"].alias("d1"), order[0]["label"].alias("label"), F.get(order, F.lit(1))["d"].alias("d2"))


def eligibility(sample: DataFrame, centre: DataFrame, by: list[str], least: float) -> DataFrame:
    """(by, n, agreement, d_max, eligible): how often the sample's nearest centre is its own label, and the farthest distance."""
    near = sample.join(F.broadcast(centre)).withColumn("near", nearest(F.col("z"), F.col("centres")))
    g = near.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("near.label") == F.col("label")).cast("double")).alias("agreement"), F.max("near.d1").alias("d_max"))
    return g.withColumn("eligible", F.col("agreement") >= least)


def assign(rows: DataFrame, centre: DataFrame, d_max: str = "d_max") -> DataFrame:
    """Adds label, d1, d2, ratio and status of rows with ``z`` (null: no eligible period): ``assigned``, ``far`` beyond ``d_max``, or ``none``."""
    near = rows.join(F.broadcast(centre)).withColumn("near", F.when(F.col("z").isNotNull(), nearest(F.col("z"), F.col("centres"))))
    status = F.when(F.col("z").isNull(), "none").when(F.col("near.d1") > F.col(d_max), "far").otherwise("assigned")
    label = F.when(status == "assigned", F.col("near.label"))
    return near.select(*rows.columns, label.alias("label"), F.col("near.d1").alias("d1"), F.col("near.d2").alias("d2"), ratio(F.col("near.d1"), F.col("near.d2")).alias("ratio"), status.alias("status")).drop("z")
