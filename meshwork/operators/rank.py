"""Ranks, quantile bins, step-down adjustment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.session import materialize


def average_rank(x: str, by: list[str] | None = None) -> Column:
    """1-based rank of ascending x; ties share the mean of their ranks."""
    own = Window.partitionBy(*(by or [])).orderBy(x)
    ties = Window.partitionBy(*(by or []), x)
    return F.rank().over(own) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


#: Ranges of the first and of the second level into which values are dealt to be ranked.
RANGES = 64


def with_ranks(df: DataFrame, x: str, name: str = "rank", by: list[str] | None = None, ranges: int = RANGES) -> DataFrame:
    """Adds the 1-based rank of ascending x within ``by``, ties sharing the mean of their ranks, and ``<name>_n``, how many are ranked.

    No task sorts the table, nor a key of ``by`` that holds most of it. Equal values are counted first; the values fall into ranges by
    quantiles of values, in two levels; a window ranks within (key, range), and the counts of the ranges below, at most
    (ranges + 1) squared a key, are added. A null x has no rank.
    """
    by = by or []
    steps = [i / ranges for i in range(1, ranges)]
    below = lambda s: F.coalesce(F.size(F.filter(s, lambda e: e < F.col(x))), F.lit(0))
    v = materialize(df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("_t")))  # else nested ranks repeat the plan below them
    v = v.join(F.broadcast(v.agg(F.percentile_approx(x, steps).alias("_s")))).withColumn("_p", below("_s")).drop("_s")
    inner = v.groupBy("_p").agg(F.percentile_approx(x, steps).alias("_s"))  # a row for each range of the first level
    v = v.join(F.broadcast(inner), "_p").withColumn("_q", F.col("_p") * (ranges + 1) + below("_s")).drop("_s", "_p")
    # counts of lower ranges, for the first level and within one of its ranges: lists of ``ranges`` + 1 at most, not of their square
    ends = v.groupBy(*by, "_q").agg(F.sum("_t").alias("_t")).groupBy(*by, F.floor(F.col("_q") / (ranges + 1)).alias("_p")).agg(F.collect_list(F.struct("_q", "_t")).alias("_e"), F.sum("_t").alias("_t"))
    ends = ends.groupBy(*by).agg(F.collect_list(F.struct("_p", "_t", "_e")).alias("_f"), F.sum("_t").alias(f"{name}_n"))
    lower = lambda e, c, a: F.aggregate(F.filter(e, lambda b: b[c] < a[c]), F.lit(0).cast("long"), lambda s, r: s + r["_t"])
    offset = ends.select(*by, f"{name}_n", F.explode(F.transform("_f", lambda a: F.struct(a["_e"].alias("_e"), lower(F.col("_f"), "_p", a).alias("_o")))).alias("_r")).select(*by, f"{name}_n", "_r._e", "_r._o")
    offset = offset.select(*by, f"{name}_n", "_o", F.explode(F.transform("_e", lambda a: F.struct(a["_q"].alias("_q"), lower(F.col("_e"), "_q", a).alias("_i")))).alias("_r"))
    offset = offset.select(*by, f"{name}_n", "_r._q", (F.col("_o") + F.col("_r._i")).alias("_o"))
    here = Window.partitionBy(*by, "_q").orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = v.withColumn("_h", F.sum("_t").over(here)).join(offset, [*by, "_q"])
    ranks = placed.select(*by, x, (F.col("_o") + F.col("_h") - (F.col("_t") - 1) / 2.0).alias(name), f"{name}_n")
    return df.join(ranks, [*by, x], "left").select(*df.columns, name, f"{name}_n")


def with_within_ranks(df: DataFrame, x: str, name: str, by: list[str]) -> DataFrame:
    """Adds (rank - 0.5) / n within groups, like ``within_rank``, for groups of any size."""
    return with_ranks(df, x, "_w", by).withColumn(name, (F.col("_w") - 0.5) / F.col("_w_n")).drop("_w", "_w_n")


def within_rank(x: str, by: list[str]) -> Column:
    """(average rank - 0.5) / n within groups."""
    return (average_rank(x, by) - 0.5) / F.count(F.lit(1)).over(Window.partitionBy(*by))


def quantile_bins(df: DataFrame, x: str, q: int, name: str = "bin") -> DataFrame:
    """Bins of linear quantile edges, right-closed, ties together; the first bin has its lower edge."""
    edges = df.agg(F.percentile(x, F.array(*[F.lit(i / q) for i in range(q + 1)])).alias("_edges"))
    out = df.join(F.broadcast(edges))
    inner = F.size(F.filter(F.slice("_edges", 2, q - 1), lambda e: e < F.col(x)))
    return out.withColumn(name, inner + 1).drop("_edges")


def holm(df: DataFrame, p: str, family: list[str], tie: str) -> DataFrame:
    """Adds p_holm: max over smaller p of (m - s) p, at most one, within a family."""
    fam = Window.partitionBy(*family)
    order = fam.orderBy(F.col(p), F.col(tie))
    step = F.col(p) * (F.count(F.lit(1)).over(fam) - F.row_number().over(order) + 1)
    df = df.withColumn("_step", step)
    return df.withColumn("p_holm", F.least(F.lit(1.0), F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_step")


def borda(scores: DataFrame, item: str, score: str, criterion: str, sign: dict[str, int]) -> DataFrame:
    """Sum and mean of an item's average ranks over criteria, best first; values are rounded to 12 digits."""
    signed = F.lit(0.0)
    for name, s in sign.items():
        signed = F.when(F.col(criterion) == name, F.bround(-s * F.col(score), 12)).otherwise(signed)
    ranked = scores.withColumn("_v", signed).withColumn("rank", average_rank("_v", [criterion]))
    return ranked.groupBy(item).agg(F.sum("rank").alias("rank_sum"), F.avg("rank").alias("rank_mean"))
