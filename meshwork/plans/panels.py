"""Label panels: the dominant category of each supplier and quarter as its label."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meshwork.functions import scalar as S
from meshwork.operators import panel
from meshwork.plans.base import query
from meshwork.sources import fixtures as fx
from meshwork.sources.fixtures import with_views

R = S.rounded

LABELS = "lb AS (SELECT territory_id AS id, period, arg_min(category, (-value, category)) AS label FROM fx_consumption GROUP BY 1, 2)".replace("arg_min(category, (-value, category))", "first(category ORDER BY value DESC, category)")
STEPS = LABELS + ", st AS (SELECT *, row_number() OVER w AS step, lag(label) OVER w AS previous, lead(label) OVER w AS nxt FROM lb WINDOW w AS (PARTITION BY id ORDER BY period)), sp AS (SELECT *, coalesce(label <> previous, false) AS changed, coalesce(label <> previous AND nxt = previous, false) AS flicker FROM st)"


def sql(tail: str, more: str = STEPS) -> str:
    return with_views("fx_consumption", more=more) + tail


def labels(spark, sf):
    return panel.dominant(fx.consumption(spark, sf), ["territory_id", "period"]).withColumnRenamed("territory_id", "id")


@query(sql("SELECT id, period, label FROM lb"))
def dominant_label(spark, sf):
    return labels(spark, sf)


@query(sql("SELECT id, count(*) FILTER (changed) AS n_changes, count(*) FILTER (flicker) AS n_flickers FROM sp GROUP BY 1"))
def label_changes(spark, sf):
    return panel.steps(labels(spark, sf)).groupBy("id").agg(F.count_if("changed").alias("n_changes"), F.count_if("flicker").alias("n_flickers"))


@query(sql("SELECT id, period, previous, label, CASE WHEN lo <> hi THEN false WHEN n = 3 THEN true END AS stable FROM (SELECT *, count(*) OVER f AS n, min(label) OVER f AS lo, max(label) OVER f AS hi FROM sp WINDOW f AS (PARTITION BY id ORDER BY period ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) WHERE changed"))
def stable_change(spark, sf):
    return panel.stable_changes(labels(spark, sf), 3)


@query(sql("SELECT id, period, previous, label FROM (SELECT *, row_number() OVER (PARTITION BY id, label ORDER BY period) AS nth FROM sp) WHERE changed AND nth = 1"))
def first_visit(spark, sf):
    return panel.first_visits(labels(spark, sf))


@query(sql("SELECT id, f.label AS first, l.label AS last, f.label <> l.label AS migrated FROM f JOIN l USING (id)", STEPS + """, rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY period) AS u, row_number() OVER (PARTITION BY id ORDER BY period DESC) AS d FROM lb),
f AS (SELECT id, label FROM (SELECT id, label, count(*) AS n FROM rk WHERE u <= 6 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1),
l AS (SELECT id, label FROM (SELECT id, label, count(*) AS n FROM rk WHERE d <= 6 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1)"""))
def window_mode(spark, sf):
    return panel.window_modes(labels(spark, sf), 6)


@query(sql("SELECT source, target, n, round(n / sum(n) OVER (PARTITION BY source), 6) AS share FROM (SELECT previous AS source, label AS target, count(*) AS n FROM sp WHERE changed GROUP BY 1, 2)"))
def transitions(spark, sf):
    return panel.transitions(labels(spark, sf)).withColumn("share", R(F.col("share")))


@query(sql("SELECT s.id, n_changes, n_periods, n_labels, trajectory, label AS main, n AS n_main, CASE WHEN n_changes = 0 THEN 'never' WHEN n_changes = 1 THEN '1' WHEN n_changes <= 3 THEN '2-3' WHEN n_changes <= 9 THEN '4-9' ELSE '10+' END AS band, round(n / n_periods, 6) AS main_share FROM s JOIN m USING (id)", STEPS + ", s AS (SELECT id, count(*) FILTER (changed) AS n_changes, count(*) AS n_periods, count(DISTINCT label) AS n_labels, string_agg(label, '>' ORDER BY period) AS trajectory FROM sp GROUP BY 1), m AS (SELECT id, label, n FROM (SELECT id, label, count(*) AS n FROM lb GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1)"))
def trajectory_stability(spark, sf):
    return panel.stability(labels(spark, sf)).withColumn("main_share", R(F.col("main_share")))


@query(sql("SELECT id, t[1].label AS top1, t[2].label AS top2, CASE WHEN len(t) = 1 THEN 'single' WHEN (t[1].n + coalesce(t[2].n, 0)) / alln >= 0.5 THEN 'swinging' ELSE 'scattered' END AS subtype FROM (SELECT id, list({'label': label, 'n': n} ORDER BY n DESC, label) AS t, sum(n) AS alln FROM (SELECT id, label, count(*) AS n FROM lb GROUP BY 1, 2) GROUP BY 1)"))
def trajectory_subtype(spark, sf):
    return panel.subtypes(labels(spark, sf), 0.5)


@query(sql("SELECT k.period, k.label, round(kept / (a.n + b.n - kept), 6) AS jaccard FROM k JOIN c a ON a.period = k.period AND a.label = k.label JOIN c b ON b.period = k.bef AND b.label = k.label", STEPS + ", c AS (SELECT period, label, count(*) AS n FROM lb GROUP BY 1, 2), k AS (SELECT period, label, bef, count(*) AS kept FROM (SELECT period, label, lag(label) OVER w AS previous, lag(period) OVER w AS bef FROM lb WINDOW w AS (PARTITION BY id ORDER BY period)) WHERE label = previous GROUP BY 1, 2, 3)"))
def adjacent_label_jaccard(spark, sf):
    return panel.adjacent_jaccard(labels(spark, sf)).withColumn("jaccard", R(F.col("jaccard")))


@query(with_views("fx_consumption", more="c AS (SELECT territory_id, period FROM fx_consumption GROUP BY 1, 2 HAVING count(DISTINCT category) = 6)") + "SELECT territory_id, max(period) AS period FROM c GROUP BY 1")
def last_complete_month(spark, sf):
    return panel.last_complete(fx.consumption(spark, sf), 6)


@query(sql("SELECT period, n, n > q3 + 0.5 * (q3 - q1) AS outlier FROM c, (SELECT quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.75) AS q3 FROM c)", STEPS + ", c AS (SELECT period, count(*) FILTER (changed) AS n FROM sp GROUP BY 1)"))
def iqr_outlier(spark, sf):
    n = panel.steps(labels(spark, sf)).groupBy("period").agg(F.count_if("changed").alias("n"))
    return panel.iqr_outliers(n, "n", 0.5)


@query(with_views("fx_consumption", more="q AS (SELECT period, sum(value) AS v FROM fx_consumption GROUP BY 1)") + "SELECT a.period, round(a.v / b.v - 1, 6) AS growth, round(sum(a.v) OVER (ORDER BY a.period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 2) AS before FROM q a JOIN q b ON b.period = CAST(a.period - INTERVAL 1 YEAR AS DATE)")
def year_over_year(spark, sf):
    """Growth against the same quarter a year before and the cumulative sum up to the last quarter."""
    q = fx.consumption(spark, sf).groupBy("period").agg(F.sum("value").alias("v"))
    b = q.select(F.add_months("period", 12).alias("period"), F.col("v").alias("b"))
    w = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    return q.join(b, "period").select("period", R(F.col("v") / F.col("b") - 1).alias("growth"), R(F.sum("v").over(w), 2).alias("before"))


@query(with_views("fx_consumption", more="v AS (SELECT territory_id, period, sum(value) FILTER (category = 'PROMO') / sum(value) AS s FROM fx_consumption GROUP BY 1, 2), d AS (SELECT period, median(abs(s - p)) AS m FROM (SELECT *, lag(s) OVER (PARTITION BY territory_id ORDER BY period) AS p FROM v) WHERE s IS NOT NULL AND p IS NOT NULL GROUP BY 1), m AS (SELECT median(m) AS c FROM d), a AS (SELECT median(abs(d.m - c)) AS mad FROM d, m)") + "SELECT period, round(d.m, 6) AS m, round((d.m - c) / (1.4826 * mad), 4) AS z FROM d, m, a")
def mad_z(spark, sf):
    """Robust z-score of the median change of a share."""
    v = fx.consumption(spark, sf).groupBy("territory_id", "period").agg((F.sum(F.when(F.col("category") == "PROMO", F.col("value"))) / F.sum("value")).alias("s"))
    p = F.lag("s").over(Window.partitionBy("territory_id").orderBy("period"))
    d = v.withColumn("p", p).where("s is not null and p is not null").groupBy("period").agg(F.median(F.abs(F.col("s") - F.col("p"))).alias("m"))
    c = d.agg(F.median("m").alias("c"))
    mad = d.join(F.broadcast(c)).agg(F.median(F.abs(F.col("m") - F.col("c"))).alias("mad"))
    return d.join(F.broadcast(c)).join(F.broadcast(mad)).select("period", R(F.col("m")).alias("m"), R((F.col("m") - F.col("c")) / (1.4826 * F.col("mad")), 4).alias("z"))


@query(sql("SELECT id, label, n, n_passed FROM (SELECT id, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY id) AS n_passed FROM lb WHERE month(period) <> 1 GROUP BY 1, 2) WHERE n_passed >= 15 QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1").replace("n, n_passed FROM (", "n, CAST(n_passed AS BIGINT) AS n_passed FROM ("))
def filtered_mode(spark, sf):
    return panel.confident_mode(labels(spark, sf), F.month("period") != 1, 15)


@query(sql("SELECT id, period, CASE WHEN label IN ('PROMO', 'SMALL') THEN 1 WHEN changed THEN 2 WHEN step > 20 THEN 3 ELSE 4 END AS class FROM sp").replace("CASE WHEN label", "CAST(CASE WHEN label").replace("ELSE 4 END AS", "ELSE 4 END AS BIGINT) AS"))
def layer_class(spark, sf):
    """Mutually exclusive classes by a case ladder."""
    k = F.when(F.col("label").isin("PROMO", "SMALL"), 1).when(F.col("changed"), 2).when(F.col("step") > 20, 3).otherwise(4)
    return panel.steps(labels(spark, sf)).select("id", "period", k.cast("long").alias("class"))


@query(sql("SELECT id, " + ", ".join(f"coalesce(max(code) FILTER (period = DATE '{y}-{m}-01'), 255) AS m{y}{m}" for y in (1995, 1996) for m in ("01", "04", "07", "10")) + " FROM (SELECT id, period, CAST(dense_rank() OVER (ORDER BY label) - 1 AS BIGINT) AS code FROM lb) GROUP BY 1"))
def label_matrix(spark, sf):
    """Node by period matrix of label codes, 255 where there is none."""
    names = F.array(*[F.lit(c) for c in fx.TYPES])
    lab = labels(spark, sf).withColumn("code", (F.array_position(names, F.col("label")) - 1).cast("long"))
    cells = {f"m{y}{m}": f"{y}-{m}-01" for y in (1995, 1996) for m in ("01", "04", "07", "10")}
    return lab.groupBy("id").agg(*[F.coalesce(F.max(F.when(F.col("period") == F.lit(d).cast("date"), F.col("code"))), F.lit(255).cast("long")).alias(n) for n, d in cells.items()])
