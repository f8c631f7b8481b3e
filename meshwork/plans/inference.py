"""Rank tests and their nulls over the territory attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshwork.functions import scalar as S
from meshwork.operators import panel, rank, stats
from meshwork.plans.base import query
from meshwork.plans.panels import LABELS, labels
from meshwork.session import table
from meshwork.sources import fixtures as fx
from meshwork.sources.fixtures import with_views

R = S.rounded


def avg_rank(x: str, by: str = "") -> str:
    p = f"PARTITION BY {by} " if by else ""
    q = f"PARTITION BY {by}, {x}" if by else f"PARTITION BY {x}"
    return f"(rank() OVER ({p}ORDER BY {x}) + (count(*) OVER ({q}) - 1) / 2.0)"


T = "t AS (SELECT territory_id AS id, round(market_access, -2) AS y, market_access AS x, district_type AS g, region_name AS r, federal_district AS f FROM fx_territory)"


def sql(tail: str, more: str = "") -> str:
    return with_views("fx_territory", more=T + (", " + more if more else "")) + tail


def sample(spark, sf):
    return fx.territory(spark, sf).select(F.col("territory_id").alias("id"), F.round("market_access", -2).alias("y"), F.col("market_access").alias("x"), F.col("district_type").alias("g"), F.col("region_name").alias("r"), F.col("federal_district").alias("f"))


@query(sql(f"SELECT id, {avg_rank('y')} AS rank FROM t"))
def average_ranks(spark, sf):
    return rank.with_ranks(sample(spark, sf), "y").select("id", "rank")


@query(sql(f"SELECT id, round(({avg_rank('y', 'r')} - 0.5) / count(*) OVER (PARTITION BY r), 9) AS w FROM t"))
def within_region_rank(spark, sf):
    return rank.with_within_ranks(sample(spark, sf), "y", "w", ["r"]).select("id", R(F.col("w"), 9).alias("w"))


KW = "SELECT {by}12 / (n * (n + 1)) * q - 3 * (n + 1) AS h0, n, k FROM (SELECT {by}sum(s * s / c) AS q, CAST(sum(c) AS DOUBLE) AS n, count(*) AS k FROM (SELECT {by}{g}, sum(rank) AS s, count(*) AS c FROM {src} GROUP BY {by}{g}) {group})"


def kw_sql(g: str, src: str) -> str:
    return f"k0 AS ({KW.format(by='', g=g, src=src, group='')}), tf AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM {src} GROUP BY rank)), kw AS (SELECT h0 / (1 - ties / (n * n * n - n)) AS h, n, k FROM k0, tf)"


RANKED = f"rk AS (SELECT *, {avg_rank('y')} AS rank FROM t)"
WITHIN = f"w0 AS (SELECT *, round(({avg_rank('y', 'r')} - 0.5) / count(*) OVER (PARTITION BY r), 12) AS w FROM t), rk AS (SELECT *, {avg_rank('w')} AS rank FROM w0)"
OUT = "SELECT round(h, 6) AS h, CAST(n AS BIGINT) AS n, k, round(greatest(0, (h - k + 1) / (n - k)), 6) AS eta2 FROM kw"


def _kw(d):
    return d.select(R(F.col("h")).alias("h"), "n", "k", R(F.col("eta2")).alias("eta2"))


@query(sql(OUT, RANKED + ", " + kw_sql("g", "rk")))
def kruskal_eta2(spark, sf):
    return _kw(stats.kruskal(sample(spark, sf), "y", "g"))


@query(sql(OUT, WITHIN + ", " + kw_sql("g", "rk")))
def kruskal_within_region(spark, sf):
    return _kw(stats.kruskal(sample(spark, sf), "y", "g", "r"))


@query(sql(OUT, RANKED + ", " + kw_sql("f", "rk")))
def kruskal_benchmark(spark, sf):
    """The effect of the federal district as the benchmark."""
    return _kw(stats.kruskal(sample(spark, sf), "y", "f"))


@query(sql(f"SELECT f, round(corr(a, b), 6) AS rho, count(*) AS n FROM (SELECT f, {avg_rank('y', 'f')} AS a, {avg_rank('id', 'f')} AS b FROM t) GROUP BY 1"))
def spearman_by_district(spark, sf):
    return stats.spearman(sample(spark, sf), "y", "id", ["f"]).withColumn("rho", R(F.col("rho")))


@query(sql(f"SELECT 'all' AS level, round(corr(a, b), 6) AS rho FROM (SELECT {avg_rank('y')} AS a, {avg_rank('id')} AS b FROM t) UNION ALL SELECT 'within', round(corr(a, b), 6) FROM (SELECT {avg_rank('wy')} AS a, {avg_rank('wi')} AS b FROM (SELECT round(({avg_rank('y', 'r')} - 0.5) / count(*) OVER (PARTITION BY r), 12) AS wy, round(({avg_rank('id', 'r')} - 0.5) / count(*) OVER (PARTITION BY r), 12) AS wi FROM t)) UNION ALL SELECT 'between', round(corr(a, b), 6) FROM (SELECT {avg_rank('my')} AS a, {avg_rank('mi')} AS b FROM (SELECT round(median(y), 9) AS my, round(median(id), 9) AS mi FROM t GROUP BY r))"))
def spearman_levels(spark, sf):
    s = sample(spark, sf)
    w = rank.with_within_ranks(rank.with_within_ranks(s, "y", "_y", ["r"]), "id", "_id", ["r"]).select(F.round("_y", 12).alias("y"), F.round("_id", 12).alias("id"))
    b = s.groupBy("r").agg(F.round(F.median("y"), 9).alias("y"), F.round(F.median("id"), 9).alias("id"))
    parts = [stats.spearman(d, "y", "id").select(F.lit(n).alias("level"), R(F.col("rho")).alias("rho")) for n, d in (("all", s), ("within", w), ("between", b))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(sql("SELECT id, round(b - regr_slope(b, a) OVER () * a - regr_intercept(b, a) OVER (), 6) AS residual FROM ra", f"ra AS (SELECT id, {avg_rank('id')} AS a, {avg_rank('y')} AS b FROM t)"))
def rank_residual(spark, sf):
    return stats.residual_ranks(sample(spark, sf), "id", "y").select("id", R(F.col("residual")).alias("residual"))


PERM = "pm AS (SELECT range AS perm FROM range(40)), fan AS (SELECT perm, id, g, r, rank FROM rk, pm), tk AS (SELECT perm, id, g, row_number() OVER (PARTITION BY perm{r} ORDER BY id) AS n{c} FROM fan), gv AS (SELECT perm, rank, row_number() OVER (PARTITION BY perm{r} ORDER BY md5(perm || '-' || id), id) AS n{c} FROM fan), dl AS (SELECT tk.perm, g, rank FROM tk JOIN gv ON tk.perm = gv.perm AND tk.n = gv.n{j}), k0 AS ({kw}), tf AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM rk GROUP BY rank)), nl AS (SELECT perm, greatest(0, (h0 / (1 - ties / (n * n * n - n)) - k + 1) / (n - k)) AS eta2 FROM k0, tf)"
PERM_KW = KW.format(by="perm, ", g="g", src="dl", group="GROUP BY perm")


@query(sql("SELECT perm, round(eta2, 6) AS eta2 FROM nl", RANKED + ", " + PERM.format(r="", c="", j="", kw=PERM_KW)))
def perm_null(spark, sf):
    return stats.kruskal_null(sample(spark, sf), "id", "y", "g", 40).select("perm", R(F.col("eta2")).alias("eta2"))


@query(sql("SELECT perm, round(eta2, 6) AS eta2 FROM nl", WITHIN + ", " + PERM.format(r=", r", c=", r", j=" AND tk.r = gv.r", kw=PERM_KW)))
def perm_null_within_region(spark, sf):
    return stats.kruskal_null(sample(spark, sf), "id", "y", "g", 40, "r").select("perm", R(F.col("eta2")).alias("eta2"))


@query(sql("SELECT round((1 + count(*) FILTER (round(eta2, 12) >= round(o, 12))) / (1 + count(*)), 6) AS p, round(quantile_cont(eta2, 0.95), 6) AS p95, round(quantile_cont(eta2, 0.99), 6) AS p99, round(max(o), 6) AS observed FROM nl, ob", RANKED + ", " + PERM.format(r="", c="", j="", kw=PERM_KW) + ", " + kw_sql("g", "rk").replace("k0", "k1").replace("tf AS", "tg AS").replace("FROM k1, tf", "FROM k1, tg") + ", ob AS (SELECT greatest(0, (h - k + 1) / (n - k)) AS o FROM kw)"))
def permutation_p(spark, sf):
    s = sample(spark, sf)
    p = stats.upper_p(stats.kruskal_null(s, "id", "y", "g", 40), "eta2", stats.kruskal(s, "y", "g"), "eta2")
    return p.select(*[R(F.col(c)).alias(c) for c in p.columns])


P = "p AS (SELECT f, r, round(1 - 1.0 / (1 + avg(y) / 40000), 9) AS p FROM t GROUP BY 1, 2)"


@query(sql("SELECT f, r, p, round(least(1, max(s) OVER (PARTITION BY f ORDER BY p, r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS p_holm FROM (SELECT *, p * (count(*) OVER (PARTITION BY f) - row_number() OVER (PARTITION BY f ORDER BY p, r) + 1) AS s FROM p)", P))
def holm(spark, sf):
    p = sample(spark, sf).groupBy("f", "r").agg(F.round(1 - 1.0 / (1 + F.avg("y") / 40000), 9).alias("p"))
    return rank.holm(p, "p", ["f"], "r").withColumn("p_holm", R(F.col("p_holm")))


@query(sql("SELECT u, round((abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2 FROM (SELECT sum(rank) FILTER (g = 'BUILDING') - CAST(count(*) FILTER (g = 'BUILDING') AS DOUBLE) * (count(*) FILTER (g = 'BUILDING') + 1) / 2 AS u, CAST(count(*) FILTER (g = 'BUILDING') AS DOUBLE) AS n1, CAST(count(*) FILTER (g <> 'BUILDING') AS DOUBLE) AS n2 FROM rk), (SELECT sum(t * t * t - t) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM rk GROUP BY rank))", RANKED))
def mannwhitney_u(spark, sf):
    m = stats.mann_whitney(sample(spark, sf), "y", F.col("g") == "BUILDING")
    return m.withColumn("z", R(F.col("z")))


@query(sql("SELECT coalesce(sum(k) FILTER (d > 0), 0) AS w_plus, coalesce(sum(k) FILTER (d < 0), 0) AS w_minus, count(*) AS n FROM (SELECT d, (rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0) AS k FROM (SELECT round(y - 5000, 9) AS d, abs(round(y - 5000, 9)) AS a FROM t) WHERE d <> 0)"))
def wilcoxon_w(spark, sf):
    return stats.wilcoxon(sample(spark, sf).withColumn("c", F.lit(5000.0)), "y", "c")


@query(sql("SELECT round(b / s, 6) AS r2, round(1 - (1 - b / s) * (n - 1) / (n - k), 6) AS adj_r2, round((b - (k - 1) * (s - b) / (n - k)) / (s + (s - b) / (n - k)), 6) AS omega2 FROM (SELECT sum(pow(m - o, 2)) AS b, sum(pow(x - o, 2)) AS s, CAST(count(*) AS DOUBLE) AS n, count(DISTINCT r) AS k FROM (SELECT x, r, avg(x) OVER (PARTITION BY r) AS m, (SELECT avg(x) FROM t) AS o FROM t))"))
def anova_omega(spark, sf):
    a = stats.anova(sample(spark, sf), "x", "r")
    return a.select(*[R(F.col(c)).alias(c) for c in a.columns])


@query(sql("SELECT id, y FROM d WHERE gn >= 20", "a AS (SELECT *, count(*) OVER (PARTITION BY r) AS rn FROM t), b AS (SELECT *, count(*) OVER (PARTITION BY g) AS gn FROM a WHERE rn >= 45), c AS (SELECT * EXCLUDE (rn), count(*) OVER (PARTITION BY r) AS rn FROM b WHERE gn >= 20), d AS (SELECT * EXCLUDE (gn), count(*) OVER (PARTITION BY g) AS gn FROM c WHERE rn >= 45)"))
def sample_preparation(spark, sf):
    return stats.prepare(sample(spark, sf), "y", "g", "r", 45, 20, rounds=2).select("id", "y")


Q = "q AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS x, median(o_totalprice) AS y FROM orders GROUP BY 1), s AS (SELECT row_number() OVER (ORDER BY m) - 1 AS i, x, y FROM q), sh AS (SELECT range AS shift FROM range(1, (SELECT count(*) FROM s))), j AS (SELECT shift, a.x, b.y FROM s a, sh JOIN s b ON b.i = (a.i + shift) % (SELECT count(*) FROM s))"


@query("WITH " + Q + f" SELECT shift, round(corr(u, v), 6) AS rho FROM (SELECT shift, {avg_rank('x', 'shift')} AS u, {avg_rank('y', 'shift')} AS v FROM j) GROUP BY 1")
def cyclic_shift(spark, sf):
    q = table(spark, sf, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("m")).agg(F.count(F.lit(1)).alias("x"), F.median("o_totalprice").alias("y"))
    return stats.cyclic_null(q, "m", "x", "y").withColumn("rho", R(F.col("rho")))


CENTRES = LABELS + ", sh AS (SELECT id, period, label, " + ", ".join(f"coalesce(sum(value) FILTER (category = '{c}'), 0) / sum(value) AS c{i}" for i, c in enumerate(fx.TYPES)) + " FROM lb JOIN fx_consumption f ON f.territory_id = lb.id AND f.period = lb.period GROUP BY 1, 2, 3), ce AS (SELECT label, [" + ", ".join(f"avg(c{i})" for i in range(6)) + "] AS x FROM sh GROUP BY 1), nr AS (SELECT a.label AS source, b.label AS target, round(sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 9) AS d FROM ce a JOIN ce b ON a.label <> b.label QUALIFY row_number() OVER (PARTITION BY a.label ORDER BY d, b.label) <= 2), tr AS (SELECT previous AS source, label AS target, count(*) AS n FROM (SELECT label, lag(label) OVER (PARTITION BY id ORDER BY period) AS previous FROM lb) WHERE label <> previous GROUP BY 1, 2)"


@query(with_views("fx_consumption", more=CENTRES.replace("lb.period GROUP BY 1, 2, 3)", "lb.period GROUP BY lb.id, lb.period, lb.label)").replace("SELECT id, period, label, coalesce", "SELECT lb.id, lb.period, lb.label, coalesce")) + "SELECT CAST(sum(n) FILTER (nr.d IS NOT NULL) AS BIGINT) AS hits, CAST(sum(n) AS BIGINT) AS n, round(sum(n) FILTER (nr.d IS NOT NULL) / sum(n), 6) AS share FROM tr LEFT JOIN nr USING (source, target)")
def share_to_nearest(spark, sf):
    """Share of label changes that go to one of the two nearest types."""
    lab, c = labels(spark, sf), fx.consumption(spark, sf).withColumnRenamed("territory_id", "id")
    w = c.groupBy("id", "period").pivot("category", fx.TYPES).sum("value").fillna(0.0, subset=fx.TYPES)
    total = sum((F.col(t) for t in fx.TYPES[1:]), F.col(fx.TYPES[0]))
    m = w.join(lab, ["id", "period"]).groupBy("label").agg(F.array(*[F.avg(F.col(t) / total) for t in fx.TYPES]).alias("x"))
    s = stats.share_to_nearest(panel.transitions(lab), stats.nearest_types(m, 2))
    return s.withColumn("share", R(F.col("share")))


@query()
def bootstrap_delta(spark, sf):
    """Bootstrap distribution of the gap between two effect sizes: 2.5 % and 97.5 % points and the share below zero."""
    d = stats.bootstrap_eta_gap(sample(spark, sf), "y", "g", "f", 200)
    return d.agg(F.percentile("gap", 0.025).alias("low"), F.percentile("gap", 0.975).alias("high"), F.avg((F.col("gap") <= 0).cast("double")).alias("p_boot"), F.count(F.lit(1)).alias("n"))


@query()
def cluster_bootstrap_share(spark, sf):
    t = panel.steps(labels(spark, sf)).where("previous is not null").groupBy("id").agg(F.count_if("changed").alias("hits"), F.count(F.lit(1)).alias("trials"))
    return stats.poisson_bootstrap_share(t, "id", 100)
