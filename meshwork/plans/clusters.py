"""Clusterings of vectors and their validity."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshwork.functions import scalar as S
from meshwork.operators import cluster, panel, rank, validity, whole
from meshwork.plans.base import query
from meshwork.plans.graphs import DIST
from meshwork.session import materialize
from meshwork.sources import fixtures as fx
from meshwork.sources.fixtures import with_views

R = S.rounded

AB = "la AS (SELECT id, label FROM fx_nodes), lb AS (SELECT id, CASE WHEN x[1] > 0.1 THEN 0 WHEN x[2] > 0 THEN 1 ELSE 2 END AS label FROM fx_nodes), ct AS (SELECT i, j, n, sum(n) OVER (PARTITION BY i) AS ni, sum(n) OVER (PARTITION BY j) AS nj, sum(n) OVER () AS total FROM (SELECT la.label AS i, lb.label AS j, count(*) AS n FROM la JOIN lb USING (id) GROUP BY 1, 2))"


def sql(tail: str, more: str = AB) -> str:
    return with_views("fx_nodes", more=more) + tail


def second(n):
    return n.select("id", F.when(F.col("x")[0] > 0.1, 0).when(F.col("x")[1] > 0, 1).otherwise(2).cast("long").alias("label"))


def table_of(spark, sf):
    n = fx.nodes(spark, sf)
    return validity.contingency(n, second(n))


@query(sql("SELECT i, CAST(j AS BIGINT) AS j, n, CAST(ni AS BIGINT) AS ni, CAST(nj AS BIGINT) AS nj FROM ct"))
def contingency(spark, sf):
    return table_of(spark, sf).select("i", "j", "n", "ni", "nj")


@query(sql("SELECT round((s - a * b / p) / ((a + b) / 2 - a * b / p), 6) AS ari FROM (SELECT sum(n * (n - 1) / 2) AS s, max(total * (total - 1) / 2) AS p FROM ct), (SELECT sum(ni * (ni - 1) / 2) AS a FROM (SELECT DISTINCT i, ni FROM ct)), (SELECT sum(nj * (nj - 1) / 2) AS b FROM (SELECT DISTINCT j, nj FROM ct))"))
def ari(spark, sf):
    return validity.adjusted_rand(table_of(spark, sf)).withColumn("ari", R(F.col("ari")))


@query(sql("SELECT round(mi, 6) AS mi, round(ha, 6) AS ha, round(hb, 6) AS hb, round(2 * mi / (ha + hb), 6) AS nmi FROM (SELECT sum(n / total * ln(n * total / (ni * nj))) AS mi FROM ct), (SELECT -sum(ni / total * ln(ni / total)) AS ha FROM (SELECT DISTINCT i, ni, total FROM ct)), (SELECT -sum(nj / total * ln(nj / total)) AS hb FROM (SELECT DISTINCT j, nj, total FROM ct))"))
def nmi(spark, sf):
    m = validity.mutual_information(table_of(spark, sf))
    return m.select(*[R(F.col(c)).alias(c) for c in m.columns])


@query(sql("SELECT round(sum(n) FILTER (r = 1) / max(total), 6) AS purity, round(sum(n) FILTER (r <= 2) / max(total), 6) AS top2 FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY n DESC, j) AS r FROM ct)"))
def purity_nesting(spark, sf):
    p = validity.purity(table_of(spark, sf))
    return p.select(*[R(F.col(c)).alias(c) for c in p.columns])


@query(sql("SELECT i, CAST(j AS BIGINT) AS j, round(n / (ni + nj - n), 6) AS jaccard FROM ct QUALIFY row_number() OVER (PARTITION BY i ORDER BY round(n / (ni + nj - n), 12) DESC, j) = 1"))
def best_jaccard(spark, sf):
    return validity.best_jaccard(table_of(spark, sf)).withColumn("jaccard", R(F.col("jaccard")))


@query(sql("SELECT i, round(sum(n * (n - 1)) / max(ni * (ni - 1)), 6) AS ratio, CAST(max(ni) AS BIGINT) AS n FROM ct GROUP BY 1 HAVING max(ni) >= 2"))
def ps_ratio(spark, sf):
    return validity.strength_ratios(table_of(spark, sf)).withColumn("ratio", R(F.col("ratio")))


@query(sql("SELECT a.id, round(coalesce((b - a) / greatest(a, b), 0), 6) AS s FROM (SELECT a.id, min(m) FILTER (own) AS a, min(m) FILTER (NOT own) AS b FROM (SELECT a.id, a.label = b.label AS own, avg(" + DIST + ") AS m FROM fx_nodes a JOIN fx_nodes b ON a.id <> b.id GROUP BY a.id, a.label, b.label) a GROUP BY 1) a", "one AS (SELECT 1)"))
def silhouette(spark, sf):
    return validity.silhouette(fx.stored_nodes(spark, sf)).withColumn("s", R(F.col("s")))


LONG = "lv AS (SELECT id, label, unnest(range(1, 65)) AS d, unnest(x) AS v FROM fx_nodes)"


@query(sql("SELECT round(b, 6) AS between, round(w, 6) AS within, round((b / (k - 1)) / (w / (n - k)), 6) AS ch FROM (SELECT sum(pow(m - o, 2)) AS b, sum(pow(v - m, 2)) AS w FROM (SELECT v, avg(v) OVER (PARTITION BY label, d) AS m, avg(v) OVER (PARTITION BY d) AS o FROM lv)), (SELECT count(*) AS n, count(DISTINCT label) AS k FROM fx_nodes)", LONG).replace(" AS between", ' AS "between"').replace(" AS within", ' AS "within"'))
def calinski_harabasz(spark, sf):
    c = validity.calinski_harabasz(fx.nodes(spark, sf))
    return c.select(*[R(F.col(f"`{x}`")).alias(x) for x in c.columns])


CENTRES = LONG + ", ce AS (SELECT label, list(m ORDER BY d) AS x FROM (SELECT label, d, avg(v) AS m FROM lv GROUP BY 1, 2) GROUP BY 1)"
DBW = CENTRES + f""", vr AS (SELECT label, sqrt(sum(q * q)) AS s FROM (SELECT label, d, var_pop(v) AS q FROM lv GROUP BY 1, 2) GROUP BY 1), wh AS (SELECT sqrt(sum(q * q)) AS o FROM (SELECT d, var_pop(v) AS q FROM lv GROUP BY 1)),
sc AS (SELECT avg(s) / max(o) AS scat, sqrt(sum(s)) / count(*) AS sd, count(*) AS k FROM vr, wh),
nr AS (SELECT a.label, a.x FROM fx_nodes a JOIN ce b ON a.label = b.label QUALIFY row_number() OVER (PARTITION BY a.label ORDER BY round({DIST}, 9), a.id) = 1),
pr AS (SELECT a.label AS i, b.label AS j, list_transform(list_zip(a.x, b.x), lambda p: (p[1] + p[2]) / 2) AS m, a.x AS ci, b.x AS cj FROM nr a JOIN nr b ON a.label < b.label),
dn AS (SELECT i, j, count(*) FILTER ({DIST.replace('b.x', 'm')} <= sd) AS dm, count(*) FILTER ({DIST.replace('b.x', 'ci')} <= sd) AS di, count(*) FILTER ({DIST.replace('b.x', 'cj')} <= sd) AS dj FROM pr JOIN fx_nodes a ON a.label IN (i, j), sc GROUP BY 1, 2)"""


@query(sql("SELECT round(scat, 6) AS scat, CASE WHEN u = 0 THEN round(2 * r / (k * (k - 1)), 6) END AS dens_bw, CASE WHEN u = 0 THEN round(scat + 2 * r / (k * (k - 1)), 6) END AS s_dbw FROM sc, (SELECT sum(dm / nullif(greatest(di, dj), 0)) AS r, count(*) FILTER (greatest(di, dj) = 0) AS u FROM dn)", DBW))
def s_dbw(spark, sf):
    d = validity.s_dbw(fx.nodes(spark, sf))
    return d.select(*[R(F.col(c)).alias(c) for c in d.columns])


@query(sql(f"SELECT id, CAST(t[1].label AS BIGINT) AS label, round(t[1].d, 6) AS d1, round(t[2].d, 6) AS d2, round(t[1].d / t[2].d, 6) AS ratio FROM (SELECT a.id, list({{'d': round({DIST}, 9), 'label': b.label}} ORDER BY round({DIST}, 9), b.label) AS t FROM fx_nodes a, ce b GROUP BY 1)", CENTRES))
def nearest_centroid(spark, sf):
    n = fx.nodes(spark, sf)
    a = cluster.assign(n.select("id", "x"), validity.centroids(n))
    return a.select("id", "label", *[R(F.col(c)).alias(c) for c in ("d1", "d2", "ratio")])


def _lloyd(step: int, source: str) -> str:
    return f"""a{step} AS (SELECT a.id, a.x, b.label FROM fx_nodes a, {source} b QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round({DIST}, 9), b.label) = 1),
c{step} AS (SELECT label, list(m ORDER BY d) AS x FROM (SELECT label, d, avg(v) AS m FROM (SELECT label, unnest(range(1, 65)) AS d, unnest(x) AS v FROM a{step}) GROUP BY 1, 2) GROUP BY 1)"""


@query(sql(f"SELECT a.id, b.label, round(round({DIST}, 9), 6) AS d1 FROM fx_nodes a, c3 b QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round({DIST}, 9), b.label) = 1", "c0 AS (SELECT id AS label, x FROM fx_nodes WHERE id < 6), " + ", ".join(_lloyd(i + 1, f"c{i}") for i in range(3))))
def lloyd_fixed_3iter(spark, sf):
    n = fx.nodes(spark, sf)
    return cluster.lloyd(n, n.where("id < 6").select(F.col("id").alias("label"), "x"), 3).withColumn("d1", R(F.col("d1")))


HALF = "cz AS (SELECT half, label, list(m ORDER BY d) AS x FROM (SELECT id % 2 AS half, label, d, avg(v) AS m FROM lv WHERE label < 6 GROUP BY 1, 2, 3) GROUP BY 1, 2), co AS (SELECT a.label AS a, b.label AS b, round(" + DIST + ", 9) AS cost FROM cz a JOIN cz b ON a.half = 0 AND b.half = 1), "
PERMS = "pe(p, rest) AS (SELECT CAST([] AS BIGINT[]), CAST(range(6) AS BIGINT[]) UNION ALL SELECT list_append(p, v), list_filter(rest, lambda r: r <> v) FROM (SELECT p, rest, unnest(rest) AS v FROM pe)), pt AS (SELECT p, sum(cost) AS total FROM (SELECT p, unnest(range(6)) AS a, unnest(p) AS b FROM pe WHERE len(p) = 6) q JOIN co ON co.a = q.a AND co.b = q.b GROUP BY 1), best AS (SELECT p FROM pt ORDER BY round(total, 9), p LIMIT 1), mt AS (SELECT unnest(range(6)) AS a, unnest(p) AS b FROM best)"


def costs(spark, sf):
    n = fx.nodes(spark, sf).where("label < 6").withColumn("half", F.col("id") % 2)
    c = validity.centroids(n, ["half"])
    a, b = c.where("half = 0").alias("a"), c.where("half = 1").alias("b")
    return a.join(b).select(F.col("a.label").alias("a"), F.col("b.label").alias("b"), F.round(S.euclid(F.col("a.x"), F.col("b.x")), 9).alias("cost"))


@query(sql("SELECT mt.a, mt.b FROM mt", LONG + ", " + HALF + PERMS))
def assignment_k6(spark, sf):
    """Least-cost one-to-one matching of six centroids of two halves."""
    return panel.match_by_permutation(costs(spark, sf), 6).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))


@query(sql("""SELECT a, b, round(cost, 6) AS cost, round(rival / cost, 6) AS margin, mutual, CASE WHEN NOT mutual OR rival / cost < 1.2 THEN 'ambiguous' WHEN rival / cost >= 1.5 THEN 'sure' ELSE 'likely' END AS confidence FROM (
SELECT mt.a, mt.b, c.cost, (SELECT min(o.cost) FROM co o WHERE (o.a = mt.a) <> (o.b = mt.b)) AS rival, c.cost = (SELECT min(o.cost) FROM co o WHERE o.a = mt.a) AND c.cost = (SELECT min(o.cost) FROM co o WHERE o.b = mt.b) AS mutual FROM mt JOIN co c ON c.a = mt.a AND c.b = mt.b)""", LONG + ", " + HALF + PERMS))
def centroid_match_margin(spark, sf):
    c = costs(spark, sf)
    m = panel.match_margins(c, panel.match_by_permutation(c, 6).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    return m.withColumn("cost", R(F.col("cost"))).withColumn("margin", R(F.col("margin")))


BORDA = "sc(m, c, v) AS (SELECT label, 'spread', round(avg(x[1]), 9) FROM fx_nodes GROUP BY 1 UNION ALL SELECT label, 'size', CAST(count(*) AS DOUBLE) FROM fx_nodes GROUP BY 1)"


@query(sql("SELECT m, sum(rank) AS rank_sum, round(avg(rank), 6) AS rank_mean FROM (SELECT m, (rank() OVER (PARTITION BY c ORDER BY s) + (count(*) OVER (PARTITION BY c, s) - 1) / 2.0) AS rank FROM (SELECT m, c, CASE c WHEN 'spread' THEN v ELSE -v END AS s FROM sc)) GROUP BY 1", BORDA))
def rank_borda(spark, sf):
    n = fx.nodes(spark, sf).groupBy(F.col("label").alias("m"))
    a = n.agg(F.round(F.avg(F.col("x")[0]), 9).alias("v")).withColumn("c", F.lit("spread"))
    b = n.agg(F.count(F.lit(1)).cast("double").alias("v")).withColumn("c", F.lit("size"))
    return rank.borda(a.unionByName(b), "m", "v", "c", {"spread": -1, "size": 1}).withColumn("rank_mean", R(F.col("rank_mean")))


@query(sql("SELECT k, gap, s, coalesce(k = (SELECT min(k) FROM g WHERE ok), false) AS chosen FROM g", "cv AS (SELECT label AS k, round(0.5 + avg(x[3]), 6) AS gap, round(stddev_pop(x[4]) / 10, 6) AS s FROM fx_nodes GROUP BY 1), g AS (SELECT *, gap >= lead(gap) OVER (ORDER BY k) - lead(s) OVER (ORDER BY k) AS ok FROM cv)"))
def gap_rule(spark, sf):
    c = fx.nodes(spark, sf).groupBy(F.col("label").alias("k")).agg(R(0.5 + F.avg(F.col("x")[2])).alias("gap"), R(F.stddev_pop(F.col("x")[3]) / 10).alias("s"))
    return validity.gap_choice(c)


def run_list(spark, seeds, k):
    return spark.range(seeds).select(F.col("id").alias("seed"), F.lit(k).alias("k"))


def k_runs(spark, sf):
    """Ten runs of six means, written: one in a task up to ``whole.FITTED`` nodes, all by blocks beyond."""
    n = fx.stored_nodes(spark, sf)
    return materialize(whole.kmeans_runs(n, 10, 6) if n.count() > whole.FITTED else cluster.fits(n, run_list(spark, 10, 6)))


@query()
def kmeans_best_of_seeds(spark, sf):
    runs = k_runs(spark, sf)
    return cluster.best_run(runs, ["k"]).select("k", "seed", "id", "label", "score")


@query()
def membership_confidence(spark, sf):
    """Agreement of runs with the best one after renaming labels by overlap."""
    runs = k_runs(spark, sf)
    best = cluster.best_run(runs, ["k"]).select("id", "label")
    return cluster.confidence(cluster.overlap_relabel(runs, best, 6), best)


@query()
def gmm_best(spark, sf):
    n = fx.nodes(spark, sf).withColumn("x", F.slice("x", 1, 5))
    return cluster.best_run(cluster.fits(n, run_list(spark, 4, 4), "gmm").withColumn("score", -F.col("score")), ["k"])


@query()
def ward(spark, sf):
    """One task up to ``whole.LOCAL`` nodes, rounds by blocks beyond."""
    n = fx.stored_nodes(spark, sf)
    if n.count() > whole.LOCAL:
        return whole.ward(n, 6)
    return cluster.fits(n, run_list(spark, 1, 6), "ward").select("id", "label")


@query()
def spectral(spark, sf):
    """A dense matrix up to ``whole.LOCAL`` nodes, products by blocks beyond."""
    n = fx.stored_nodes(spark, sf)
    if n.count() > whole.LOCAL:
        return whole.spectral(n, 6, 0)
    return cluster.fits(n, run_list(spark, 1, 6), "spectral").select("id", "label")


@query()
def prediction_strength(spark, sf):
    p = cluster.prediction_strength(fx.nodes(spark, sf).select("id", "x"), 4, 10)
    return p.agg(F.avg("strength").alias("mean"), F.stddev_samp("strength").alias("sd"), F.median("strength").alias("median"), F.percentile("strength", 0.1).alias("p10"), F.count(F.lit(1)).alias("n"))


@query()
def gap_statistic(spark, sf):
    n = fx.stored_nodes(spark, sf)
    return validity.gap_choice((whole if n.count() > whole.FITTED else cluster).gap_curve(n, [2, 3, 4, 5, 6], 8))


@query()
def adjusted_mutual_information(spark, sf):
    return spark.createDataFrame([(validity.adjusted_information(table_of(spark, sf)),)], "ami double")


@query()
def principal_axes(spark, sf):
    pc, shares, _ = cluster.pca(fx.nodes(spark, sf).withColumn("x", F.slice("x", 1, 8)))
    return pc.select("id", F.col("pc")[0].alias("pc1"), F.lit(shares[0]).alias("share1"))
