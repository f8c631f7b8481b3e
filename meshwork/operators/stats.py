"""Nonparametric inference: rank tests, permutation nulls, bootstrap, exact tails."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwork.functions.scalar import ratio
from meshwork.operators.rank import with_ranks, with_within_ranks


def prepare(df: DataFrame, y: str, group: str, region: str, min_region: int = 3, min_group: int = 5, rounds: int = 3) -> DataFrame:
    """Rows with a value whose regions and groups are large enough, dropped in turn until nothing changes.

    The rounds are unrolled; the query fails if ``rounds`` of them leave a small one.
    """
    out = df.where(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double")))
    for _ in range(rounds):
        out = out.withColumn("_r", F.count(F.lit(1)).over(Window.partitionBy(region))).where(F.col("_r") >= min_region)
        out = out.withColumn("_g", F.count(F.lit(1)).over(Window.partitionBy(group))).where(F.col("_g") >= min_group)
    small = F.count(F.lit(1)).over(Window.partitionBy(region))
    out = out.withColumn("_r", small)
    ok = F.assert_true(F.col("_r") >= min_region, F.lit("sample preparation did not settle"))
    return out.withColumn(y, F.when(ok.isNull(), F.col(y))).drop("_r", "_g")


def ranked(df: DataFrame, y: str, region: str | None = None) -> DataFrame:
    """Adds rank: the average rank, or (rank - 0.5) / n within a region and then ranked again."""
    if region is None:
        return with_ranks(df, y).drop("rank_n")
    within = with_within_ranks(df, y, "_v", [region]).withColumn("_v", F.round("_v", 12))
    return with_ranks(within, "_v").drop("_v", "rank_n")


def kruskal(df: DataFrame, y: str, group: str, region: str | None = None) -> DataFrame:
    """One row: H with tie factor, n, k and eta squared max(0, (H - k + 1) / (n - k))."""
    r = ranked(df, y, region).select(group, "rank")
    g = r.groupBy(group).agg(F.sum("rank").alias("s"), F.count(F.lit(1)).alias("c"))
    t = r.groupBy("rank").agg(F.count(F.lit(1)).cast("double").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    a = g.agg(F.sum(F.col("s") * F.col("s") / F.col("c")).alias("q"), F.sum("c").cast("double").alias("n"), F.count(F.lit(1)).alias("k")).join(F.broadcast(t))
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    return a.withColumn("h", h).select("h", n.cast("long").alias("n"), "k", F.greatest(F.lit(0.0), (F.col("h") - F.col("k") + 1) / (n - F.col("k"))).alias("eta2"))


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """(by, rho, n); null where a side is constant."""
    by = by or []
    r = with_ranks(with_ranks(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, "_x", by), y, "_y", by)
    g = r.groupBy(*by) if by else r.groupBy()
    out = g.agg(F.covar_pop("_x", "_y").alias("c"), F.stddev_pop("_x").alias("sx"), F.stddev_pop("_y").alias("sy"), F.count(F.lit(1)).alias("n"))
    return out.select(*by, ratio(F.col("c"), F.col("sx") * F.col("sy")).alias("rho"), "n")


def residual_ranks(df: DataFrame, x: str, y: str) -> DataFrame:
    """Adds residual: rank of y less its least-squares fit on the rank of x."""
    r = with_ranks(with_ranks(df, x, "_x"), y, "_y")
    fit = r.agg(F.regr_slope("_y", "_x").alias("_a"), F.regr_intercept("_y", "_x").alias("_b"))
    return r.join(F.broadcast(fit)).withColumn("residual", F.col("_y") - F.col("_a") * F.col("_x") - F.col("_b")).drop("_x", "_y", "_x_n", "_y_n", "_a", "_b")


def permutations_of(df: DataFrame, id: str, value: str, n: int, region: list[str] | None = None) -> DataFrame:
    """(perm, id, value): the values dealt anew in each permutation, within regions if given; replayable md5 order."""
    region = region or []
    spark = df.sparkSession
    perm = F.broadcast(spark.range(n).select(F.col("id").alias("perm")))
    key = F.md5(F.concat_ws("-", F.col("perm").cast("string"), F.col(id).cast("string")))
    fan = df.select(*region, id, value).join(perm)
    take = fan.withColumn("_n", F.row_number().over(Window.partitionBy("perm", *region).orderBy(id))).select("perm", *region, id, "_n")
    give = fan.withColumn("_n", F.row_number().over(Window.partitionBy("perm", *region).orderBy(key, id))).select("perm", *region, value, "_n")
    return take.join(give, ["perm", *region, "_n"]).select("perm", id, value)


def kruskal_null(df: DataFrame, id: str, y: str, group: str, n: int, region: str | None = None) -> DataFrame:
    """(perm, eta2) of a Kruskal-Wallis test under permutation of the ranks; ties are the same in each."""
    r = ranked(df, y, region)
    dealt = permutations_of(r, id, "rank", n, [region] if region else None).join(r.select(id, group), id)
    g = dealt.groupBy("perm", group).agg(F.sum("rank").alias("s"), F.count(F.lit(1)).alias("c"))
    t = r.groupBy("rank").agg(F.count(F.lit(1)).cast("double").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    a = g.groupBy("perm").agg(F.sum(F.col("s") * F.col("s") / F.col("c")).alias("q"), F.sum("c").cast("double").alias("n"), F.count(F.lit(1)).alias("k")).join(F.broadcast(t))
    m = F.col("n")
    h = (12 / (m * (m + 1)) * F.col("q") - 3 * (m + 1)) / (1 - F.col("ties") / (m * m * m - m))
    return a.select("perm", F.greatest(F.lit(0.0), (h - F.col("k") + 1) / (m - F.col("k"))).alias("eta2"))


def upper_p(null: DataFrame, value: str, observed: DataFrame, obs: str) -> DataFrame:
    """One row: p = (1 + #{null >= observed}) / (1 + n), and the null's 95th and 99th percentiles."""
    j = null.join(F.broadcast(observed.select(F.col(obs).alias("_o"))))
    return j.agg(((1 + F.count_if(F.round(value, 12) >= F.round("_o", 12))) / (1 + F.count(F.lit(1)))).alias("p"), F.percentile(value, 0.95).alias("p95"), F.percentile(value, 0.99).alias("p99"), F.max("_o").alias("observed"))


def mann_whitney(df: DataFrame, y: str, is_first) -> DataFrame:
    """One row: U of the first sample and the normal approximation's z with tie and continuity correction."""
    r = with_ranks(df.where(F.col(y).isNotNull()), y).withColumn("_f", is_first)
    t = r.groupBy("rank").agg(F.count(F.lit(1)).cast("double").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    a = r.agg(F.sum(F.when(F.col("_f"), F.col("rank"))).alias("r1"), F.count_if("_f").cast("double").alias("n1"), F.count_if(~F.col("_f")).cast("double").alias("n2")).join(F.broadcast(t))
    u, n = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") + F.col("n2")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    mean = F.col("n1") * F.col("n2") / 2
    return a.select(u.alias("u"), ((F.abs(u - mean) - 0.5) / sd).alias("z"), F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"))


def wilcoxon_exact(n: int, w: float) -> float:
    """Two-sided exact p of a signed-rank sum W = min(W+, W-) without ties: subset sums by dynamic programming."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for r in range(1, n + 1):
        ways[r:] += ways[:-r].copy()
    return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))


def wilcoxon(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: W+, W- and n of the non-zero differences, ranks of absolute values averaged over ties."""
    d = with_ranks(df.withColumn("_d", F.round(F.col(x) - F.col(y), 9)).where("_d <> 0").withColumn("_a", F.abs("_d")), "_a")
    zero = F.lit(0.0)
    return d.agg(F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("rank"))), zero).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("_d") < 0, F.col("rank"))), zero).alias("w_minus"), F.count(F.lit(1)).alias("n"))


def anova(df: DataFrame, y: str, group: str) -> DataFrame:
    """One row: R squared, its adjusted form and omega squared of a grouping."""
    m = df.withColumn("_m", F.avg(y).over(Window.partitionBy(group))).join(F.broadcast(df.agg(F.avg(y).alias("_all"))))
    a = m.agg(F.sum(F.pow(F.col("_m") - F.col("_all"), 2)).alias("b"), F.sum(F.pow(F.col(y) - F.col("_all"), 2)).alias("t"), F.count(F.lit(1)).cast("double").alias("n"), F.countDistinct(group).alias("k"))
    n, k, b, t = (F.col(c) for c in "nkbt")
    msw = (t - b) / (n - k)
    return a.select((b / t).alias("r2"), (1 - (1 - b / t) * (n - 1) / (n - k)).alias("adj_r2"), ((b - (k - 1) * msw) / (t + msw)).alias("omega2"))


def cyclic_null(series: DataFrame, t: str, x: str, y: str) -> DataFrame:
    """(shift, rho): Spearman's rho of x with y shifted cyclically, for every shift but zero."""
    n = series.count()
    s = series.select((F.row_number().over(Window.orderBy(t)) - 1).alias("i"), x, y)
    shifts = F.broadcast(series.sparkSession.range(1, n).select(F.col("id").alias("shift")))
    moved = s.select("i", x).join(shifts).withColumn("j", F.pmod(F.col("i") + F.col("shift"), F.lit(n)))
    return spearman(moved.join(s.select(F.col("i").alias("j"), y), "j"), x, y, ["shift"]).select("shift", "rho")


def nearest_types(centres: DataFrame, m: int) -> DataFrame:
    """(source, target): the m nearest other centres of each, ties to the smaller label; centres are (label, x)."""
    from meshwork.functions.scalar import euclid

    a, b = centres.alias("a"), centres.alias("b")
    d = a.join(b, F.col("a.label") != F.col("b.label")).select(F.col("a.label").alias("source"), F.col("b.label").alias("target"), F.round(euclid(F.col("a.x"), F.col("b.x")), 9).alias("d"))
    return d.withColumn("_r", F.row_number().over(Window.partitionBy("source").orderBy("d", "target"))).where(F.col("_r") <= m).select("source", "target", "d")


def share_to_nearest(trans: DataFrame, nearest: DataFrame) -> DataFrame:
    """One row: the share of transitions (source, target, n) that go to a near type."""
    hit = trans.join(nearest.select("source", "target", F.lit(1).alias("_h")), ["source", "target"], "left")
    return hit.agg(F.sum(F.when(F.col("_h") == 1, F.col("n")).otherwise(0)).alias("hits"), F.sum("n").alias("n")).withColumn("share", ratio(F.col("hits").cast("double"), F.col("n")))


def binomial_pmf(n: int, p: float) -> np.ndarray:
    if p <= 0 or p >= 1:
        out = np.zeros(n + 1)
        out[0 if p <= 0 else n] = 1.0
        return out
    k = np.arange(n + 1)
    lg = np.array([math.lgamma(i + 1) for i in range(n + 1)])
    return np.exp(lg[n] - lg - lg[::-1] + k * math.log(p) + (n - k) * math.log1p(-p))


def binomial_sum_tail(n: list[int], p: list[float], x: int) -> float:
    """P(X >= x) of a sum of independent binomials, by convolution."""
    out = np.ones(1)
    for a, b in zip(n, p):
        out = np.convolve(out, binomial_pmf(int(a), float(b)))
    return float(out[x:].sum()) if x < len(out) else 0.0


def bootstrap_eta_gap(df: DataFrame, y: str, a: str, b: str, n: int, batch: int = 50) -> DataFrame:
    """(draw, gap): eta squared of grouping a less that of b, on resampled rows. A test's sample fits a task; batches of draws are dealt out."""
    fan = df.select(y, a, b).join(F.broadcast(df.sparkSession.range(-(-n // batch)).select(F.col("id").alias("batch"))))

    def ranks(v: np.ndarray) -> np.ndarray:
        _, inv, cnt = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(cnt) - (cnt - 1) / 2)[inv]

    def eta(r: np.ndarray, g: np.ndarray) -> float:
        m, c, s = len(r), np.bincount(g), np.bincount(g, r)
        k = int((c > 0).sum())
        t = np.unique(r, return_counts=True)[1].astype(float)
        h = (12 / (m * (m + 1)) * (s[c > 0] ** 2 / c[c > 0]).sum() - 3 * (m + 1)) / (1 - (t**3 - t).sum() / (m**3 - m))
        return max(0.0, (h - k + 1) / (m - k))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        which = int(pdf.batch.iloc[0])
        pdf = pdf.sort_values([y, a, b], kind="stable")
        v, ga, gb = pdf[y].to_numpy(), pd.factorize(pdf[a], sort=True)[0], pd.factorize(pdf[b], sort=True)[0]
        rng, out = np.random.default_rng(which), []
        for i in range(min(batch, n - which * batch)):
            at = rng.integers(0, len(v), len(v))
            r = ranks(v[at])
            out.append((which * batch + i, eta(r, ga[at]) - eta(r, gb[at])))
        return pd.DataFrame(out, columns=["draw", "gap"])

    return fan.groupBy("batch").applyInPandas(draw, "draw long, gap double")


def poisson_bootstrap_share(hits: DataFrame, id: str, n: int) -> DataFrame:
    """(draw, share): cluster bootstrap of hits over trials with replayable Poisson(1) weights per id."""
    draws = F.broadcast(hits.sparkSession.range(n).select(F.col("id").alias("draw")))
    u = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("draw").cast("string"), F.col(id).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    edge, total, w = math.exp(-1), math.exp(-1), F.lit(0)
    for k in range(1, 9):
        w = w + (u >= total).cast("int")
        edge /= k
        total += edge
    return hits.join(draws).withColumn("w", w).groupBy("draw").agg(ratio(F.sum(F.col("w") * F.col("hits")).cast("double"), F.sum(F.col("w") * F.col("trials"))).alias("share"))
