"""Effects by level, guarded deviations, detours on the sphere, joins of labels along edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshwork.functions import scalar as S
from meshwork.operators import graph, stats, summary
from meshwork.plans.base import query
from meshwork.plans.graphs import EDGES, ROADS, edges, roads
from meshwork.plans.inference import KW, RANKED, WITHIN, avg_rank, sample, sql
from meshwork.plans.panels import LABELS, labels
from meshwork.plans.summaries import FEATURES, SHARES, rounded, shares
from meshwork.session import table
from meshwork.sources import fixtures as fx
from meshwork.sources.fixtures import with_views


def _eta_sql(level: str, g: str, src: str) -> str:
    ties = f"(SELECT sum(t * t * t - t) FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM {src} GROUP BY rank))"
    return f"SELECT '{level}' AS level, CAST(n AS BIGINT) AS n, k, round(greatest(0, (h0 / (1 - {ties} / (n * n * n - n)) - k + 1) / (n - k)), 6) AS eta2 FROM ({KW.format(by='', g=g, src=src, group='')})"


BETWEEN = f"bt AS (SELECT r, f, median(y) AS y FROM t GROUP BY 1, 2), rb AS (SELECT *, {avg_rank('y')} AS rank FROM bt)"


@query(sql(" UNION ALL ".join([_eta_sql("all", "g", "rk"), _eta_sql("within", "g", "ri"), _eta_sql("between", "f", "rb")]), ", ".join([RANKED, WITHIN.replace("rk AS", "ri AS"), BETWEEN])))
def eta_by_level(spark, sf):
    """Eta squared over all rows, within regions, and of region medians between districts."""
    s = sample(spark, sf)
    between = s.groupBy("r", "f").agg(F.median("y").alias("y"))
    parts = [("all", stats.kruskal(s, "y", "g")), ("within", stats.kruskal(s, "y", "g", "r")), ("between", stats.kruskal(between, "y", "f"))]
    found = [k.select(F.lit(level).alias("level"), "n", "k", S.rounded(F.col("eta2")).alias("eta2")) for level, k in parts]
    return found[0].unionByName(found[1]).unionByName(found[2])


GUARDED = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, label, count(*) AS n, round(avg({f}), 6) AS mean, round(median({f}), 6) AS median,"
    f" round(CASE WHEN (SELECT abs(avg({f})) FROM rw) >= 0.005 THEN avg({f}) / (SELECT avg({f}) FROM rw) - 1 END, 6) AS d_mean,"
    f" round(CASE WHEN (SELECT abs(median({f})) FROM rw) >= 0.005 THEN median({f}) / (SELECT median({f}) FROM rw) - 1 END, 6) AS d_median FROM rw GROUP BY label"
    for f in FEATURES
)


@query(with_views("fx_consumption", more=LABELS + ", " + SHARES + ", rw AS (SELECT * FROM lb JOIN sh USING (id, period))") + GUARDED)
def guarded_deviations(spark, sf):
    """How the types' mean and median shares deviate from those of all rows, where the latter are half a percentage point or more."""
    rows = labels(spark, sf).join(shares(spark, sf), ["id", "period"])
    out = None
    for f in FEATURES:
        d = rounded(summary.guarded_deviation(rows, "label", f, 0.005), "mean", "median", "d_mean", "d_median").withColumn("feature", F.lit(f))
        out = d if out is None else out.unionByName(d)
    return out


KM = "2 * 6371.0 * asin(sqrt(least(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 1.0)))"


@query("WITH " + ROADS + f", co AS (SELECT c_custkey AS id, c_acctbal / 200 AS lat, CAST(c_custkey % 360 AS DOUBLE) - 180 AS lon FROM customer), q AS (SELECT x, y, 100 * distance AS road, {KM} AS straight FROM rd JOIN co a ON a.id = x JOIN co b ON b.id = y) SELECT x, y, round(straight, 3) AS straight, round(road / nullif(straight, 0), 6) AS detour, coalesce(road / nullif(straight, 0) > 1.5, false) AS long_way FROM q")
def detours_on_the_sphere(spark, sf):
    """Roads against the great circle between their ends."""
    at = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 200).alias("lat"), ((F.col("c_custkey") % 360).cast("double") - 180).alias("lon"))
    end = lambda c: at.select(F.col("c_custkey").alias(c), F.col("lat").alias(f"lat_{c}"), F.col("lon").alias(f"lon_{c}"))
    r = roads(spark, sf).join(end("x"), "x").join(end("y"), "y")
    r = r.withColumn("straight", S.haversine_km(F.col("lat_x"), F.col("lon_x"), F.col("lat_y"), F.col("lon_y")))
    d = summary.detours(r, 100 * F.col("distance"), F.col("straight"), 1.5)
    return d.select("x", "y", S.rounded(F.col("straight"), 3).alias("straight"), S.rounded(F.col("detour")).alias("detour"), "long_way")


JOINS = EDGES + """, cc AS (SELECT CAST(count(*) AS DOUBLE) AS c FROM fx_nodes GROUP BY label),
cs AS (SELECT sum(c) AS n, sum(c * (c - 1)) AS f2, sum(c * (c - 1) * (c - 2)) AS f3, sum(c * (c - 1) * (c - 2) * (c - 3)) AS f4, sum(pow(c * (c - 1), 2)) AS sq FROM cc),
dg AS (SELECT sum(d * (d - 1)) AS shared FROM (SELECT CAST(count(*) AS DOUBLE) AS d FROM (SELECT x AS id FROM e UNION ALL SELECT y FROM e) GROUP BY id)),
wi AS (SELECT CAST(count(*) FILTER (a.label = b.label) AS BIGINT) AS n_within, CAST(count(*) AS DOUBLE) AS m FROM e JOIN (SELECT id, label FROM fx_nodes) a ON a.id = x JOIN (SELECT id, label FROM fx_nodes) b ON b.id = y),
pp AS (SELECT *, f2 / (n * (n - 1)) AS p2, f3 / (n * (n - 1) * (n - 2)) AS p3, (f4 + f2 * f2 - sq) / (n * (n - 1) * (n - 2) * (n - 3)) AS p4 FROM cs, dg, wi),
mo AS (SELECT n_within, m * p2 AS expected, sqrt(m * p2 + shared * p3 + (m * m - m - shared) * p4 - pow(m * p2, 2)) AS deviation FROM pp)"""


@query(with_views("fx_nodes", more=JOINS) + "SELECT n_within, round(expected, 6) AS expected, round(deviation, 6) AS deviation, round((n_within - expected) / deviation, 6) AS z FROM mo")
def label_join_z(spark, sf):
    """Edges within a label against all permutations of the labels."""
    return rounded(graph.label_joins(fx.nodes(spark, sf).select("id", "label"), edges(spark, sf)), "expected", "deviation", "z")


CENTRAL = EDGES + ", cn AS (SELECT id, avg(score) AS centrality, CAST(count(*) AS DOUBLE) AS degree FROM (SELECT x AS id, score FROM e UNION ALL SELECT y, score FROM e) GROUP BY 1), cl AS (SELECT cn.*, CASE WHEN label < 3 THEN 1.0 ELSE 0.0 END AS flag FROM cn JOIN fx_nodes USING (id))"


@query(with_views("fx_nodes", more=CENTRAL) + f"SELECT count(*) AS n, round(corr(centrality, degree), 6) AS r_degree, round(corr(centrality, flag), 6) AS r_flag, (SELECT round(corr(a, b), 6) FROM (SELECT {avg_rank('centrality')} AS a, {avg_rank('degree')} AS b FROM (SELECT round(centrality, 9) AS centrality, degree FROM cl))) AS rho_degree FROM cl")
def centrality_correlations(spark, sf):
    """Centrality with the degree, and with a flag of the node (point-biserial)."""
    flag = F.when(F.col("label") < 3, 1.0).otherwise(0.0)
    c = graph.centrality(edges(spark, sf)).join(fx.nodes(spark, sf).select("id", flag.alias("flag")), "id").withColumn("degree", F.col("degree").cast("double"))
    rho = stats.spearman(c.withColumn("centrality", F.round("centrality", 9)), "centrality", "degree").select(S.rounded(F.col("rho")).alias("rho_degree"))
    return c.agg(F.count(F.lit(1)).alias("n"), S.rounded(F.corr("centrality", "degree")).alias("r_degree"), S.rounded(F.corr("centrality", "flag")).alias("r_flag")).join(F.broadcast(rho))
