"""Partitions compared: the label panel's quarters as runs over the same territories."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshwork.functions.scalar import rounded as R
from meshwork.operators import runs as O
from meshwork.plans.base import query
from meshwork.plans.inference import avg_rank
from meshwork.plans.panels import LABELS, labels
from meshwork.session import materialize
from meshwork.sources.fixtures import with_views

#: Costs within this of the least are near it, runs are alike from this index on.
GAP, ALIKE = 0.02, 0.15


def runs(spark, sf):
    """Runs are numbered by quarter: 4 x year + quarter."""
    number = (4 * F.year("period") + F.quarter("period")).cast("int")
    return labels(spark, sf).select(number.alias("run"), "id", "label")


def costs(r):
    """The chance that two nodes of a run have the same label."""
    n = r.groupBy("run", "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return n.groupBy("run").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n") / F.sum("n")).alias("cost"))


RUNS = LABELS + """, rn AS (SELECT CAST(4 * EXTRACT(YEAR FROM period) + EXTRACT(QUARTER FROM period) AS INT) AS run, id, label FROM lb),
ct AS (SELECT a.run AS a, b.run AS b, a.label AS i, b.label AS j, count(*) AS n FROM rn a JOIN rn b ON a.id = b.id AND a.run < b.run GROUP BY 1, 2, 3, 4),
ri AS (SELECT a, b, sum(k * (k - 1) / 2.0::DOUBLE) AS s FROM (SELECT a, b, i, sum(n) AS k FROM ct GROUP BY 1, 2, 3) GROUP BY 1, 2),
rj AS (SELECT a, b, sum(k * (k - 1) / 2.0::DOUBLE) AS s FROM (SELECT a, b, j, sum(n) AS k FROM ct GROUP BY 1, 2, 3) GROUP BY 1, 2),
rt AS (SELECT a, b, sum(n * (n - 1) / 2.0::DOUBLE) AS s, CAST(sum(n) AS BIGINT) AS n FROM ct GROUP BY 1, 2),
ar AS (SELECT rt.a, rt.b, rt.n, (rt.s - ri.s * rj.s / (rt.n * (rt.n - 1) / 2.0::DOUBLE)) / nullif((ri.s + rj.s) / 2 - ri.s * rj.s / (rt.n * (rt.n - 1) / 2.0::DOUBLE), 0) AS ari FROM rt JOIN ri USING (a, b) JOIN rj USING (a, b)),
co AS (SELECT run, sum(n * n) / sum(n) / sum(n) AS cost FROM (SELECT run, label, CAST(count(*) AS DOUBLE) AS n FROM rn GROUP BY 1, 2) GROUP BY 1),
ends AS (SELECT a AS run, b AS other, ari FROM ar UNION ALL SELECT b, a, ari FROM ar)"""


def sql(tail: str, more: str = "") -> str:
    return with_views("fx_consumption", more=RUNS + (", " + more if more else "")) + tail


@query(sql("SELECT a, b, n, round(ari, 6) AS ari FROM ar"))
def run_ari_matrix(spark, sf):
    return O.pairwise_ari(runs(spark, sf)).withColumn("ari", R(F.col("ari")))


NEAR = f"""nb AS (SELECT row_number() OVER (ORDER BY round(cost, 6), run) AS pos, run, coalesce((SELECT list(other) FROM ends WHERE ends.run = co.run AND ari >= {ALIKE}), []) AS near FROM co WHERE cost <= (SELECT min(cost) FROM co) + {GAP}),
fold(pos, leaders, run, first) AS (SELECT 0::BIGINT, []::INT[], NULL::INT, NULL::INT UNION ALL
    SELECT nb.pos, CASE WHEN len(hit) > 0 THEN leaders ELSE list_append(leaders, nb.run) END, nb.run, CASE WHEN len(hit) > 0 THEN hit[1] ELSE nb.run END
    FROM (SELECT f.pos, leaders, nb.run, list_filter(leaders, lambda l: list_contains(nb.near, l)) AS hit FROM fold f JOIN nb ON nb.pos = f.pos + 1) q JOIN nb ON nb.run = q.run)"""


@query(sql("SELECT run, first FROM fold WHERE pos > 0", NEAR))
def run_groups(spark, sf):
    """Runs near the least cost, each with the first run before it that is alike."""
    r = materialize(runs(spark, sf))
    return O.alike(O.near_best(costs(r), GAP), O.pairwise_ari(r), ALIKE)


@query(sql(f"SELECT best, count(ari) AS n, round(min(ari), 6) AS least, round(median(ari), 6) AS median, round(avg(CAST(ari >= 0.1 AS INT)), 6) AS share_high, (SELECT round(corr(x, y), 6) FROM (SELECT {avg_rank('score')} AS x, {avg_rank('ari')} AS y FROM one)) AS rho FROM one GROUP BY 1", "bs AS (SELECT run AS best FROM co ORDER BY round(1 - cost, 12) DESC, run LIMIT 1), one AS (SELECT best, ends.run, ari, 1 - cost AS score FROM ends JOIN bs ON other = best JOIN co ON co.run = ends.run)"))
def best_run_against_rest(spark, sf):
    r = materialize(runs(spark, sf))
    scores = costs(r).select("run", (1 - F.col("cost")).alias("score"))
    b = O.best_against_rest(scores, O.pairwise_ari(r), 0.1)
    return b.select(F.col("best").cast("int").alias("best"), "n", *[R(F.col(c)).alias(c) for c in ("least", "median", "share_high", "rho")])


@query(sql("SELECT a, b, round(ari, 6) AS ari FROM (SELECT min(run) AS a, max(run) AS b FROM dr WHERE k < 20 GROUP BY k // 2 HAVING count(*) = 2) JOIN ar USING (a, b)", "dr AS (SELECT run, row_number() OVER (ORDER BY md5(CAST(run AS VARCHAR)), run) - 1 AS k FROM co)"))
def disjoint_run_pairs(spark, sf):
    """Ten random pairs of runs that share none."""
    r = materialize(runs(spark, sf))
    return O.disjoint_pairs(r, O.pairwise_ari(r), 10).withColumn("ari", R(F.col("ari")))


@query(sql("SELECT k, n AS n_runs, n = max(n) OVER () AS is_mode FROM (SELECT k, count(*) AS n FROM (SELECT run, count(DISTINCT label) AS k FROM rn GROUP BY 1) GROUP BY 1)"))
def run_label_counts(spark, sf):
    return O.label_counts(runs(spark, sf))


@query()
def mobile_share(spark, sf):
    """Territories that some run near the least cost puts elsewhere than the least one does, after matching labels."""
    r = materialize(runs(spark, sf))
    near = O.near_best(costs(r), GAP)
    best = near.agg(F.min(F.struct(F.round("cost", 6).alias("c"), "run")).alias("m")).select(F.col("m.run").alias("run"))
    return O.mobile_share(r.join(F.broadcast(near.select("run")), "run"), r.join(F.broadcast(best), "run").select("id", "label"))
