"""Similarity networks, distance networks and graph measures."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from meshwork.functions import scalar as S
from meshwork.operators import components, graph, pairs, shape
from meshwork.plans.base import query
from meshwork.plans.relational import WIDE
from meshwork.session import materialize, table
from meshwork.sources import fixtures as fx
from meshwork.sources.fixtures import with_views

R = S.rounded

ZWIDE = WIDE + ", z AS (SELECT territory_id AS id, period, [" + ", ".join(f"coalesce(({c} - avg({c}) OVER p) / nullif(stddev_pop({c}) OVER p, 0), 0)" for c in fx.EVENTS) + "] AS x FROM w WINDOW p AS (PARTITION BY period))"
DOT = "list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2]))"
NORM = lambda a: f"sqrt(list_sum(list_transform({a}.x, lambda v: v * v)))"
COS = f"{DOT} / nullif({NORM('a')} * {NORM('b')}, 0)"
DIST = "sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"


def knn_sql(source: str, by: str = "", k: int = 8, nearest: bool = False, name: str = "e") -> str:
    """CTEs from pairs (by, x, y, score) to edges (by, x, y, score, mutual)."""
    g = f"{by}, " if by else ""
    order = "round(score, 9), dst" if nearest else "round(score, 9) DESC, dst"
    return f"""{name}_b AS (SELECT {g}x AS src, y AS dst, score FROM {source} WHERE score IS NOT NULL UNION ALL SELECT {g}y, x, score FROM {source} WHERE score IS NOT NULL),
{name}_t AS (SELECT * FROM {name}_b QUALIFY row_number() OVER (PARTITION BY {g}src ORDER BY {order}) <= {k}),
{name} AS (SELECT {g}least(src, dst) AS x, greatest(src, dst) AS y, max(score) AS score, count(*) = 2 AS mutual FROM {name}_t GROUP BY ALL)""".replace("GROUP BY ALL", f"GROUP BY {g}least(src, dst), greatest(src, dst)")


NET = ZWIDE + f", ps AS (SELECT a.period, a.id AS x, b.id AS y, {COS} AS score FROM z a JOIN z b ON a.period = b.period AND a.id < b.id), " + knn_sql("ps", "period")


def vectors(spark, sf):
    """z-scores of the five shares within a week, as (id, period, x)."""
    w = shape.wide(shape.shares(fx.consumption_users(spark, sf), ["territory_id", "period"]), ["territory_id", "period"], fx.EVENTS, "share", fill=0.0)
    z = pairs.zscores(w, fx.EVENTS, ["period"])
    return z.select(F.col("territory_id").alias("id"), "period", F.array(*fx.EVENTS).alias("x"))


def network(spark, sf):
    v = materialize(vectors(spark, sf))
    largest = v.groupBy("period").count().agg(F.max("count")).first()[0] or 0
    return pairs.block_edges(v, 8, max(2, pairs.blocks_for(largest) // 2), by=["period"])


@query(with_views("fx_users", more=NET) + "SELECT period, x, y, round(score, 6) AS similarity, mutual FROM e")
def similarity_network(spark, sf):
    """Shares, pivot, z-scores within the week, cosine, eight nearest with mutual flag."""
    return network(spark, sf).select("period", "x", "y", R(F.col("score")).alias("similarity"), "mutual")


@query(with_views("fx_users", more=ZWIDE) + "SELECT id, period, " + ", ".join(f"round(x[{i + 1}], 6) AS {c}" for i, c in enumerate(fx.EVENTS)) + " FROM z")
def zscore_period(spark, sf):
    return vectors(spark, sf).select("id", "period", *[R(F.col("x")[i]).alias(c) for i, c in enumerate(fx.EVENTS)])


@query(with_views("fx_users", more=NET) + ", n AS (SELECT period, count(DISTINCT x) AS k FROM (SELECT period, x FROM e UNION ALL SELECT period, y FROM e) GROUP BY 1) SELECT e.period, count(*) AS n_edges, count(*) FILTER (mutual) AS n_mutual, max(k) AS n_nodes FROM e JOIN n ON n.period = e.period GROUP BY 1")
def network_summary(spark, sf):
    e = network(spark, sf)
    ends = e.select("period", F.explode(F.array("x", "y")).alias("id")).groupBy("period").agg(F.countDistinct("id").alias("n_nodes"))
    return e.groupBy("period").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if("mutual").alias("n_mutual")).join(ends, "period")


@query(with_views("fx_users", more=NET) + """, c AS (SELECT a.period, count(*) AS n FROM e a JOIN e b ON b.period = a.period - INTERVAL 7 DAY AND a.x = b.x AND a.y = b.y GROUP BY 1), sz AS (SELECT period, count(*) AS k FROM e GROUP BY 1)
SELECT a.period, coalesce(n, 0) AS n_both, round(coalesce(n, 0) / (a.k + b.k - coalesce(n, 0)), 6) AS jaccard FROM sz a JOIN sz b ON b.period = a.period - INTERVAL 7 DAY LEFT JOIN c ON c.period = a.period""")
def knn_jaccard_prev(spark, sf):
    """Edge-set Jaccard of a week with the week before."""
    e = network(spark, sf).select("period", "x", "y")
    before = e.select(F.date_add("period", 7).alias("period"), "x", "y")
    both = e.join(before, ["period", "x", "y"]).groupBy("period").agg(F.count(F.lit(1)).alias("n"))
    size = e.groupBy("period").agg(F.count(F.lit(1)).alias("k"))
    out = size.join(size.select(F.date_add("period", 7).alias("period"), F.col("k").alias("kb")), "period").join(both, "period", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("period", n.alias("n_both"), R(n / (F.col("k") + F.col("kb") - n)).alias("jaccard"))


PAIRS = f"ps AS (SELECT a.id AS x, b.id AS y, {COS} AS score FROM fx_nodes a JOIN fx_nodes b ON a.id < b.id)"
EDGES = PAIRS + ", " + knn_sql("ps")


def n_blocks(n):
    return pairs.blocks_for(n.count())


def cosine_pairs(spark, sf, above=None):
    n = fx.stored_nodes(spark, sf)
    return pairs.block_pairs(n, "cosine", n_blocks(n), above)


def edges(spark, sf):
    """Written once, since most measures read them more than once."""
    n = fx.stored_nodes(spark, sf)
    return materialize(pairs.block_edges(n, 8, n_blocks(n)))


@query(with_views("fx_nodes", more=PAIRS) + "SELECT x, y, round(score, 6) AS score FROM ps WHERE score > 0.2")
def cosine_pairs_threshold(spark, sf):
    return cosine_pairs(spark, sf, 0.2).select("x", "y", R(F.col("score")).alias("score"))


@query(with_views("fx_nodes", more=EDGES) + "SELECT x, y, round(score, 6) AS score, mutual FROM e")
def cosine_knn8(spark, sf):
    return edges(spark, sf).select("x", "y", R(F.col("score")).alias("score"), "mutual")


@query(with_views("fx_nodes", more=PAIRS + ", e_b AS (SELECT x AS src, y AS dst, score FROM ps UNION ALL SELECT y, x, score FROM ps)") + "SELECT src, dst, round(score, 6) AS score FROM e_b QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(score, 9) DESC, dst) <= 5")
def block_knn5(spark, sf):
    """The scalable path: block products with partial and final top-k."""
    n = fx.stored_nodes(spark, sf)
    return pairs.block_knn(n, 5, n_blocks(n)).select("src", "dst", R(F.col("score")).alias("score"))


@query(with_views("fx_nodes", more=PAIRS + ", c(cut) AS (VALUES (0.1), (0.2), (0.3)), t AS (SELECT cut, x, y FROM ps, c WHERE score > cut), d AS (SELECT cut, id, count(*) AS d FROM (SELECT cut, x AS id FROM t UNION ALL SELECT cut, y FROM t) GROUP BY 1, 2)") + "SELECT CAST(cut AS DOUBLE) AS cut, CAST(sum(d) / 2 AS BIGINT) AS n_edges, count(*) AS n_linked, max(d) AS max_degree, any_value(k) - count(*) AS n_isolated, round(CAST(sum(d) AS DOUBLE) / any_value(k * (k - 1)), 6) AS density FROM d, (SELECT count(*) AS k FROM fx_nodes) GROUP BY 1")
def threshold_sweep(spark, sf):
    t = pairs.threshold_sweep(cosine_pairs(spark, sf, 0.1), fx.nodes(spark, sf).count(), [0.1, 0.2, 0.3])
    return t.withColumn("density", R(F.col("density"))).withColumn("n_isolated", F.col("n_isolated").cast("long"))


DISTANCES = f"ds AS (SELECT a.id AS x, b.id AS y, {DIST} AS score FROM fx_nodes a JOIN fx_nodes b ON a.id < b.id)"


def nearest(spark, sf):
    n = fx.stored_nodes(spark, sf)
    return materialize(pairs.block_edges(n, 8, n_blocks(n), metric="euclid"))


@query(with_views("fx_nodes", more=DISTANCES + ", " + knn_sql("ds", nearest=True)) + "SELECT x, y, round(score, 6) AS distance, mutual FROM e")
def knn_by_distance(spark, sf):
    return nearest(spark, sf).select("x", "y", R(F.col("score")).alias("distance"), "mutual")


SERIES = "sr AS (SELECT territory_id AS id, list(value ORDER BY period) AS x FROM (SELECT i.territory_id, q.period, coalesce(sum(value), 0) AS value FROM (SELECT DISTINCT territory_id FROM fx_consumption) i CROSS JOIN (SELECT DISTINCT period FROM fx_consumption) q LEFT JOIN fx_consumption f ON f.territory_id = i.territory_id AND f.period = q.period GROUP BY 1, 2) GROUP BY 1)"


def series(spark, sf):
    """(id, x): quarterly totals of each supplier, quarters without sales as zero."""
    c = fx.consumption(spark, sf)
    full = shape.densify(c.groupBy("territory_id", "period").agg(F.sum("value").alias("value")), c.select("territory_id").distinct(), c.select("period").distinct())
    g = full.groupBy("territory_id").agg(F.sort_array(F.collect_list(F.struct("period", F.coalesce("value", F.lit(0.0)).alias("v")))).alias("s"))
    return g.select(F.col("territory_id").alias("id"), F.transform("s", lambda p: p["v"]).alias("x"))



UN = "un AS (SELECT a.id AS x, b.id AS y, unnest(a.x) AS u, unnest(b.x) AS v, unnest(range(len(a.x))) AS t FROM sr a JOIN sr b ON a.id < b.id)"


@query(with_views("fx_consumption", more=SERIES + ", " + UN + ", cs AS (SELECT x, y, corr(u, v) AS score FROM un GROUP BY 1, 2), " + knn_sql("cs", k=4)) + "SELECT x, y, round(score, 6) AS score, mutual FROM e")
def series_corr_knn(spark, sf):
    """Pearson correlations as cosines of centred series, by blocks."""
    s = materialize(series(spark, sf))
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x")
    centred = s.withColumn("m", mean).select("id", F.transform("x", lambda v: v - F.col("m")).alias("x"))
    return pairs.block_edges(centred, 4, n_blocks(s)).select("x", "y", R(F.col("score")).alias("score"), "mutual")


LAGS = [0, -1, 1, -2, 2]


@query(with_views("fx_consumption", more=SERIES + """, ab AS (SELECT a.id AS x, b.id AS y, a.x AS u, b.x AS v FROM sr a JOIN sr b ON a.id < b.id),
l(i, lag) AS (VALUES (0, 0), (1, -1), (2, 1), (3, -2), (4, 2)), un AS (SELECT x, y, i, lag, u, v, unnest(range(1, len(u) + 1)) AS t FROM ab, l),
c AS (SELECT x, y, i, lag, round(corr(u[t], v[t + lag]), 9) AS score FROM un WHERE t + lag BETWEEN 1 AND len(u) GROUP BY 1, 2, 3, 4)""") + "SELECT x, y, round(score, 6) AS score, CAST(lag AS BIGINT) AS lag FROM c QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY score DESC, i) = 1")
def lag_corr_pairs(spark, sf):
    s = materialize(series(spark, sf))
    return pairs.block_lags(s, LAGS, n_blocks(s)).select("x", "y", R(F.col("score")).alias("score"), "lag")


NODES_EDGES = with_views("fx_nodes", more=EDGES + ", dg AS (SELECT n.id, count(e.x) AS degree FROM fx_nodes n LEFT JOIN e ON n.id IN (e.x, e.y) GROUP BY 1)")


@query(NODES_EDGES + "SELECT count(*) AS n_nodes, min(degree) AS min_degree, median(degree) AS median_degree, round(avg(degree), 6) AS mean_degree, max(degree) AS max_degree, round(stddev_pop(degree), 6) AS std_degree, count(*) FILTER (degree = 0) AS n_isolated, CAST(sum(degree) / 2 AS BIGINT) AS n_edges, round(CAST(sum(degree) AS DOUBLE) / (count(*) * (count(*) - 1)), 6) AS density FROM dg")
def edge_degree_stats(spark, sf):
    d = graph.degree_stats(fx.nodes(spark, sf), edges(spark, sf))
    return d.withColumns({c: R(F.col(c)) for c in ("mean_degree", "std_degree", "density")})


LINKED = "lk AS (SELECT x, y FROM ps WHERE score > 0.35)"


@query(with_views("fx_nodes", more=PAIRS + ", " + LINKED + ", bl AS (SELECT x, y FROM lk UNION ALL SELECT y, x FROM lk), cc(id, root) AS (SELECT id, id FROM fx_nodes UNION SELECT y, root FROM cc JOIN bl ON cc.id = bl.x), m AS (SELECT id, min(root) AS component FROM cc GROUP BY 1)") + "SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM m")
def connected_components(spark, sf):
    link = cosine_pairs(spark, sf, 0.35)
    found = components.connected_components(link, "x", "y")
    out = fx.nodes(spark, sf).select("id").join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))
    size = out.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return out.join(size, "component").select("id", "component", "size")


@query(with_views("fx_nodes", more=PAIRS + ", " + LINKED + ", ow AS (SELECT x, y FROM lk JOIN (SELECT id, label FROM fx_nodes) a ON a.id = x JOIN (SELECT id, label FROM fx_nodes) b ON b.id = y WHERE a.label = b.label), bl AS (SELECT x, y FROM ow UNION ALL SELECT y, x FROM ow), cc(id, root) AS (SELECT id, id FROM fx_nodes UNION SELECT y, root FROM cc JOIN bl ON cc.id = bl.x), m AS (SELECT id, min(root) AS component FROM cc GROUP BY 1)") + "SELECT label, count(DISTINCT component) AS n_components FROM m JOIN fx_nodes USING (id) GROUP BY 1")
def components_by_label(spark, sf):
    """Components of the subgraphs that labels induce."""
    n = fx.nodes(spark, sf).select("id", "label")
    link = cosine_pairs(spark, sf, 0.35).join(n.select(F.col("id").alias("x"), F.col("label").alias("i")), "x").join(n.select(F.col("id").alias("y"), F.col("label").alias("j")), "y").where("i = j")
    found = components.connected_components(link, "x", "y")
    return n.join(found, F.col("id") == F.col("node"), "left").groupBy("label").agg(F.countDistinct(F.coalesce("component", "id")).alias("n_components"))


MATRIX = EDGES + """, mx AS (SELECT least(a.label, b.label) AS k, greatest(a.label, b.label) AS l, sum(score) AS w, count(*) AS n FROM e JOIN (SELECT id, label FROM fx_nodes) a ON a.id = x JOIN (SELECT id, label FROM fx_nodes) b ON b.id = y GROUP BY 1, 2),
cs AS (SELECT c AS k, coalesce(sum(w) FILTER (own), 0) AS inner_w, coalesce(sum(w) FILTER (NOT own), 0) AS outer_w FROM (SELECT k AS c, w, k = l AS own FROM mx UNION ALL SELECT l, w, false FROM mx WHERE k <> l) GROUP BY 1)"""


def matrix(spark, sf):
    return graph.cluster_edges(edges(spark, sf), fx.nodes(spark, sf).select("id", "label"))


@query(with_views("fx_nodes", more=MATRIX) + "SELECT k, l, round(w, 6) AS w, n FROM mx")
def cluster_edge_matrix(spark, sf):
    return matrix(spark, sf).withColumn("w", R(F.col("w")))


@query(with_views("fx_nodes", more=MATRIX) + "SELECT k, round(2 * inner_w / nullif(2 * inner_w + outer_w, 0), 6) AS isolability FROM cs")
def isolability(spark, sf):
    return graph.isolability(matrix(spark, sf)).withColumn("isolability", R(F.col("isolability")))


UNI = "CASE WHEN a.outer_w + b.outer_w - w > 0 THEN w / (a.outer_w + b.outer_w - w) ELSE 0 END"


@query(with_views("fx_nodes", more=MATRIX) + f"SELECT mx.k, mx.l, round({UNI}, 6) AS unifiability FROM mx JOIN cs a ON a.k = mx.k JOIN cs b ON b.k = mx.l WHERE mx.k <> mx.l")
def unifiability(spark, sf):
    return graph.unifiability(matrix(spark, sf)).withColumn("unifiability", R(F.col("unifiability")))


@query(with_views("fx_nodes", more=MATRIX + ", tm AS (SELECT sum(w) AS m FROM mx)") + f"SELECT (SELECT round(sum(inner_w / m - pow((2 * inner_w + outer_w) / (2 * m), 2)), 6) FROM cs, tm) AS modularity, (SELECT round(avg(2 * inner_w / nullif(2 * inner_w + outer_w, 0)), 6) FROM cs) AS avi, (SELECT round(sum(2 * ({UNI})) / (SELECT count(*) FROM cs), 6) FROM mx JOIN cs a ON a.k = mx.k JOIN cs b ON b.k = mx.l WHERE mx.k <> mx.l) AS avu, (SELECT count(*) FROM cs) AS n_clusters")
def modularity_mq(spark, sf):
    return graph.partition_quality(matrix(spark, sf)).withColumns({c: R(F.col(c)) for c in ("modularity", "avi", "avu")})


@query(NODES_EDGES + ", tr AS (SELECT p.x AS a, p.y AS b, q.y AS c FROM e p JOIN e q ON q.x = p.y JOIN e r ON r.x = p.x AND r.y = q.y), tn AS (SELECT id, count(*) AS t FROM (SELECT a AS id FROM tr UNION ALL SELECT b FROM tr UNION ALL SELECT c FROM tr) GROUP BY 1) SELECT round(avg(coalesce(2.0 * t / nullif(degree * (degree - 1), 0), 0)), 6) AS clustering, (SELECT count(*) FROM tr) AS n_triangles FROM dg LEFT JOIN tn USING (id)")
def clustering_coeff(spark, sf):
    return graph.clustering_coefficient(fx.nodes(spark, sf), edges(spark, sf)).withColumn("clustering", R(F.col("clustering")))


@query(with_views("fx_nodes", more=EDGES + ", bm AS (SELECT a.label AS i, b.label AS j FROM (SELECT x, y FROM e UNION ALL SELECT y, x FROM e) JOIN (SELECT id, label FROM fx_nodes) a ON a.id = x JOIN (SELECT id, label FROM fx_nodes) b ON b.id = y), q AS (SELECT count(*) FILTER (i = j) / count(*) AS tr, count(*) AS n FROM bm), s AS (SELECT sum(pow(c / n, 2)) AS sq FROM (SELECT i, count(*) AS c FROM bm GROUP BY 1), q)") + "SELECT round((tr - sq) / (1 - sq), 6) AS assortativity, round(tr, 6) AS within_share FROM q, s")
def assortativity(spark, sf):
    return graph.assortativity(edges(spark, sf), fx.nodes(spark, sf)).select(R(F.col("assortativity")).alias("assortativity"), R(F.col("within_share")).alias("within_share"))


@query(with_views("fx_nodes", more=EDGES) + "SELECT count(*) FILTER (a.label = b.label) AS n_within, count(*) AS n_edges, round(avg(CAST(a.label = b.label AS INT)), 6) AS share_within FROM e JOIN (SELECT id, label FROM fx_nodes) a ON a.id = x JOIN (SELECT id, label FROM fx_nodes) b ON b.id = y")
def edges_within_label(spark, sf):
    return graph.edges_within(edges(spark, sf), fx.nodes(spark, sf)).withColumn("share_within", R(F.col("share_within")))


ROADS = """rd AS (SELECT DISTINCT least(o_custkey, l_suppkey) AS x, greatest(o_custkey, l_suppkey) AS y, CAST((o_custkey + l_suppkey) * 7 % 50 AS DOUBLE) AS distance FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey <> l_suppkey),
ids AS (SELECT DISTINCT x AS id FROM (SELECT x FROM rd UNION SELECT y FROM rd)),
im AS (SELECT x, y, distance, false AS imputed FROM rd UNION ALL SELECT a.id, b.id, 0.0, true FROM ids a JOIN ids b ON a.id < b.id WHERE (a.id, b.id) NOT IN (SELECT (x, y) FROM rd))"""


def roads(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("x"))
    p = table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("x", F.col("l_suppkey").alias("y"))
    return pairs.undirected(p.withColumn("distance", ((F.col("x") + F.col("y")) * 7 % 50).cast("double")))


def road_ids(r):
    return r.select(F.explode(F.array("x", "y")).alias("id")).distinct()


@query("WITH " + ROADS + " SELECT x, y, distance, imputed FROM im")
def missing_pairs_impute(spark, sf):
    r = materialize(roads(spark, sf))
    return pairs.impute_missing(road_ids(r), r)


@query("WITH " + ROADS + ", bo AS (SELECT x AS s, y AS t, distance AS d FROM im UNION ALL SELECT y, x, distance FROM im) SELECT z.x, z.y, round(median(abs(a.d - b.d)), 6) AS median_gap, max(abs(a.d - b.d)) AS max_gap, count(*) AS n_third FROM rd z JOIN bo a ON a.s = z.x JOIN bo b ON b.s = z.y AND b.t = a.t WHERE z.distance = 0 AND a.t NOT IN (z.x, z.y) GROUP BY 1, 2")
def zero_distance_profile(spark, sf):
    r = materialize(roads(spark, sf))
    return pairs.zero_profile(road_ids(r), r, r.where("distance = 0")).withColumn("median_gap", R(F.col("median_gap")))


BOTH = EDGES + f", {DISTANCES}, " + knn_sql("ds", nearest=True, name="f")


def two_networks(spark, sf):
    return edges(spark, sf), nearest(spark, sf)


@query(with_views("fx_nodes", more=BOTH + ", i AS (SELECT count(*) AS n FROM e JOIN f USING (x, y))") + "SELECT (SELECT count(*) FROM e) AS n_a, (SELECT count(*) FROM f) AS n_b, n AS n_both, round(n / ((SELECT count(*) FROM e) + (SELECT count(*) FROM f) - n), 6) AS jaccard, round(CAST((SELECT count(*) FROM e) AS DOUBLE) * (SELECT count(*) FROM f) / (SELECT count(*) * (count(*) - 1) / 2 FROM fx_nodes), 6) AS expected FROM i")
def network_overlap(spark, sf):
    """Edges that two networks share, against the number expected at random."""
    a, b = two_networks(spark, sf)
    j = graph.jaccard(a, b, ["x", "y"]).withColumn("jaccard", R(F.col("jaccard")))
    n = fx.nodes(spark, sf).count()
    return j.withColumn("expected", R(F.col("n_a").cast("double") * F.col("n_b") / (n * (n - 1) / 2)))


@query(with_views("fx_nodes", more=BOTH + ", j AS (SELECT ps.x, ps.y, ps.score, ds.score AS d FROM ps JOIN ds USING (x, y))") + "SELECT CASE WHEN d > 0 AND d <= 1.2 THEN 'near' WHEN d > 1.2 AND d <= 1.4 THEN 'mid' WHEN d > 1.4 AND d <= 9 THEN 'far' END AS band, count(*) AS n, round(avg(score), 6) AS mean, round(corr(score, ln(1 + d)), 6) AS r FROM j GROUP BY 1")
def distance_bands(spark, sf):
    n = fx.stored_nodes(spark, sf)
    found = pairs.block_bands(n, n_blocks(n), [0, 1.2, 1.4, 9], ["near", "mid", "far"])
    return found.select("band", "n", R(F.col("mean")).alias("mean"), R(F.col("r")).alias("r"))


@query(with_views("fx_nodes", more=BOTH + ", q AS (SELECT quantile_cont(score, 0.9) AS cut FROM ps)") + "SELECT x, y, round(score, 6) AS score FROM ps, q WHERE score >= cut AND (x, y) NOT IN (SELECT (x, y) FROM f)")
def similar_not_neighbours(spark, sf):
    """The top tenth of pairs without those that are near in space."""
    n = fx.stored_nodes(spark, sf)
    blocks = n_blocks(n)
    cut = pairs.cosine_quantile(n, blocks, 0.9)
    near = materialize(pairs.both_ways(nearest(spark, sf).select("x", "y")).groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("skip")))
    known = n.select("id", "x").join(near.hint("merge"), "id", "left")
    at_least = -math.inf if cut is None else math.nextafter(cut, -math.inf)
    return pairs.block_pairs(known, "cosine", blocks, at_least).select("x", "y", R(F.col("score")).alias("score"))


@query(with_views("fx_nodes", more=EDGES) + "SELECT id, round(avg(score), 6) AS centrality, count(*) AS degree FROM (SELECT x AS id, score FROM e UNION ALL SELECT y, score FROM e) GROUP BY 1")
def centrality(spark, sf):
    return graph.centrality(edges(spark, sf)).withColumn("centrality", R(F.col("centrality")))


@query(with_views("fx_nodes", more=EDGES) + "SELECT sha256(string_agg(x || ':' || y || ':' || printf('%.6f', score), ';' ORDER BY x || ':' || y)) AS sha256, count(*) AS n FROM e")
def adjacency_digest(spark, sf):
    key = F.concat_ws(":", F.col("x").cast("string"), F.col("y").cast("string"))
    return graph.digest(edges(spark, sf).select(key.alias("k"), F.concat_ws(":", key, F.format_string("%.6f", "score")).alias("line")), ";")


@query(with_views("fx_nodes", more=EDGES) + "SELECT degree - coalesce(d2, 0) AS change, count(*) AS n FROM (SELECT id, count(*) AS degree, count(*) FILTER (mutual) AS d2 FROM (SELECT x AS id, mutual FROM e UNION ALL SELECT y, mutual FROM e) GROUP BY 1) GROUP BY 1")
def degree_change(spark, sf):
    """Histogram of how degrees change when only mutual edges stay."""
    e, n = edges(spark, sf), fx.nodes(spark, sf)
    a, b = graph.degrees(n, e), graph.degrees(n, e.where("mutual")).withColumnRenamed("degree", "d2")
    return a.join(b, "id").where("degree > 0").groupBy((F.col("degree") - F.col("d2")).alias("change")).agg(F.count(F.lit(1)).alias("n"))


def runs(spark, seeds: int, gammas: list[float]):
    return spark.range(seeds).select(F.col("id").alias("seed"), F.explode(F.array(*map(F.lit, gammas))).alias("gamma"))


@query()
def louvain_best(spark, sf):
    """Louvain over seeds; the partition of highest modularity, ties to the smallest seed."""
    e = edges(spark, sf)
    found = materialize(graph.louvain_runs(e, runs(spark, 8, [1.0])))
    lab = lambda c, n: found.select("seed", F.col("id").alias(c), F.col("label").alias(n))
    m = e.join(lab("x", "i"), "x").join(lab("y", "j"), ["seed", "y"])
    ends = m.select("seed", F.explode(F.array(F.struct(F.col("i").alias("c"), (F.col("i") == F.col("j")).alias("own"), "score"), F.struct(F.col("j").alias("c"), F.lit(False).alias("own"), "score"))).alias("e")).select("seed", "e.*")
    total = e.agg(F.sum("score").alias("m"))
    c = ends.groupBy("seed", "c").agg(F.sum("score").alias("d"), F.sum(F.when(F.col("own"), F.col("score")).otherwise(0)).alias("inner")).join(F.broadcast(total))
    q = c.groupBy("seed").agg(F.bround(F.sum(F.col("inner") / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)), 12).alias("q"))
    best = q.agg(F.max(F.struct("q", (-F.col("seed")).alias("s"))).alias("b")).select((-F.col("b.s")).alias("seed"), F.col("b.q").alias("modularity"))
    return found.join(F.broadcast(best), "seed").select("id", "label", "seed", "modularity")


@query()
def louvain_resolution(spark, sf):
    """Number and largest size of communities by resolution."""
    found = graph.louvain_runs(edges(spark, sf), runs(spark, 4, [0.5, 1.0, 2.0]))
    size = found.groupBy("gamma", "seed", "label").agg(F.count(F.lit(1)).alias("n"))
    return size.groupBy("gamma", "seed").agg(F.count(F.lit(1)).alias("n_communities"), F.max("n").alias("largest"))


@query()
def louvain_cooccurrence(spark, sf):
    """Core members of the communities of the first run, by how often pairs stay together over runs."""
    found = materialize(graph.louvain_runs(edges(spark, sf), runs(spark, 8, [1.0])))
    return graph.core_of_runs(found.select("seed", "id", "label"), 8)
