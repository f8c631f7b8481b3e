"""Summaries of labels, curves and groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshwork.functions import scalar as S
from meshwork.operators import panel, summary
from meshwork.plans.base import query
from meshwork.plans.clusters import sql as node_sql
from meshwork.plans.clusters import table_of
from meshwork.plans.graphs import ROADS, roads
from meshwork.plans.panels import LABELS, STEPS, labels
from meshwork.plans.panels import sql as label_sql
from meshwork.session import table
from meshwork.sources import fixtures as fx
from meshwork.sources.fixtures import with_views

R = S.rounded
SHARES = "sh AS (SELECT territory_id AS id, period, " + ", ".join(f"coalesce(sum(value) FILTER (category = '{c}'), 0) / sum(value) AS {c.lower()}" for c in fx.TYPES) + " FROM fx_consumption GROUP BY 1, 2)"
FEATURES = [c.lower() for c in fx.TYPES]
CURVE = STEPS + ", cv AS (SELECT period, count(*) FILTER (changed) / count(*) AS y FROM sp GROUP BY 1)"
Z = "(m_{f} - (SELECT avg({f}) FROM sh)) / nullif((SELECT stddev_pop({f}) FROM sh), 0)"
PROFILE = LABELS + ", " + SHARES + ", pr AS (SELECT label, count(*) AS n, " + ", ".join(f"avg({f}) AS m_{f}" for f in FEATURES) + " FROM lb JOIN sh USING (id, period) GROUP BY 1), pz AS (SELECT *, " + ", ".join(f"{Z.format(f=f)} AS z_{f}" for f in FEATURES) + " FROM pr)"


def rounded(df, *names, digits=6):
    return df.withColumns({c: R(F.col(c), digits) for c in names})


def shares(spark, sf):
    fact = fx.consumption(spark, sf).withColumnRenamed("territory_id", "id")
    part = [F.coalesce(F.sum(F.when(F.col("category") == c, F.col("value"))), F.lit(0.0)) / F.sum("value") for c in fx.TYPES]
    return fact.groupBy("id", "period").agg(*[p.alias(f) for p, f in zip(part, FEATURES)])


def curve(spark, sf):
    return panel.steps(labels(spark, sf)).groupBy("period").agg((F.count_if("changed") / F.count(F.lit(1))).alias("y"))


@query(with_views("fx_dictionary") + "SELECT territory_id, version_key, year_from, valid_to, district_type FROM (SELECT *, coalesce(lead(year_from) OVER (PARTITION BY territory_id ORDER BY year_from) - 1, 9999) AS valid_to FROM (SELECT * FROM fx_dictionary QUALIFY row_number() OVER (PARTITION BY territory_id, year_from ORDER BY version_key DESC) = 1)) WHERE 1996 BETWEEN year_from AND valid_to")
def versions_in_year(spark, sf):
    v = summary.valid_versions(fx.dictionary(spark, sf), "territory_id", "year_from", "version_key")
    v = v.withColumn("valid_to", F.col("valid_to").cast("long"))
    return summary.valid_in(v, F.lit(1996)).select("territory_id", "version_key", "year_from", "valid_to", "district_type")


@query("WITH " + ROADS + " SELECT x, y, round(distance / nullif(y - x, 0), 6) AS detour, coalesce(distance / nullif(y - x, 0) > 1.5, false) AS long_way FROM rd")
def detour_ratio(spark, sf):
    d = summary.detours(roads(spark, sf), F.col("distance"), F.col("y") - F.col("x"), 1.5)
    return rounded(d, "detour").select("x", "y", "detour", "long_way")


@query(with_views("fx_consumption", more=PROFILE) + "SELECT label, n, round(n / sum(n) OVER (), 6) AS share, " + ", ".join(f"round(m_{f}, 6) AS mean_{f}, round(z_{f}, 6) AS z_{f}" for f in FEATURES) + " FROM pz")
def cluster_profile(spark, sf):
    p = summary.profile(labels(spark, sf).join(shares(spark, sf), ["id", "period"]), FEATURES)
    return rounded(p, *[c for c in p.columns if c not in ("label", "n")])


@query(with_views("fx_consumption", more=PROFILE + ", ft AS (" + " UNION ALL ".join(f"SELECT label, '{f}' AS name, z_{f} AS z FROM pz" for f in FEATURES) + ")") + "SELECT label, coalesce(string_agg(name || CASE WHEN z > 0 THEN '↑' ELSE '↓' END || printf('%.2f', abs(z)) || 'σ', ', ' ORDER BY abs(z) DESC, name) FILTER (abs(z) >= 0.5), '') AS caption FROM ft GROUP BY 1")
def profile_caption(spark, sf):
    p = summary.profile(labels(spark, sf).join(shares(spark, sf), ["id", "period"]), FEATURES)
    return p.select("label", summary.caption(FEATURES).alias("caption"))


@query(label_sql("SELECT period, round(y, 6) AS y, round(step, 6) AS step, coalesce(step * ahead < 0, false) AS kink, coalesce(step > 0 AND ahead < 0, false) AS peak FROM (SELECT period, y, y - lag(y) OVER w AS step, lead(y) OVER w - y AS ahead FROM cv WINDOW w AS (ORDER BY period))", CURVE))
def curve_kinks(spark, sf):
    return rounded(summary.kinks(curve(spark, sf), "period", "y"), "y", "step")


@query(label_sql("SELECT period, round(y, 6) AS y, round((y - (SELECT avg(y) FROM cv)) / (SELECT stddev_samp(y) FROM cv), 6) AS z, rank() OVER (ORDER BY y DESC) AS rank FROM cv", CURVE))
def period_typicality(spark, sf):
    return rounded(summary.typicality(curve(spark, sf), "y"), "y", "z")


@query(with_views("fx_territory", more="g AS (SELECT federal_district AS d, avg(market_access) AS m, stddev_samp(market_access) / sqrt(count(*)) AS se FROM fx_territory GROUP BY 1)") + "SELECT a.d AS a, b.d AS b, round(a.m - b.m, 4) AS difference, round(sqrt(a.se * a.se + b.se * b.se), 4) AS se, round((a.m - b.m) / sqrt(a.se * a.se + b.se * b.se), 4) AS multiple, abs(a.m - b.m) <= 1.96 * (a.se + b.se) AS overlap FROM g a JOIN g b ON a.d < b.d")
def mean_difference(spark, sf):
    return rounded(summary.mean_differences(fx.territory(spark, sf), "federal_district", "market_access"), "difference", "se", "multiple", digits=4)


@query(with_views("fx_consumption", more="m AS (SELECT period, category, median(value) AS m FROM fx_consumption GROUP BY 1, 2)") + "SELECT period, string_agg(category, '>' ORDER BY m DESC, category) AS ordering, first(category ORDER BY m DESC, category) = 'STANDARD' AS top_ok, last(category ORDER BY m DESC, category) = 'PROMO' AS bottom_ok FROM m GROUP BY 1")
def median_order_check(spark, sf):
    return summary.median_order(fx.consumption(spark, sf), "period", "category", "value", "STANDARD", "PROMO")


MONTHS = "mo AS (SELECT category, period, 1.0 / count(*) AS p, avg(value) AS observed, quantile_cont(value, 0.5) AS p95 FROM fx_consumption GROUP BY 1, 2)"


@query(with_views("fx_consumption", more=MONTHS) + "SELECT category, count(*) AS n, count(*) FILTER (p < 0.05 AND observed > p95) AS n_passed, count(*) FILTER (p < 0.05 AND observed > p95) >= 23 AS holds FROM mo GROUP BY 1")
def month_rule(spark, sf):
    """The rule over months of p, an observed value and a bound; here one over the count, mean and median stand for them."""
    m = fx.consumption(spark, sf).groupBy("category", "period").agg((F.lit(1.0) / F.count(F.lit(1))).alias("p"), F.avg("value").alias("observed"), F.median("value").alias("p95"))
    return summary.month_verdict(m, "category", 23)


@query(with_views("fx_territory", more="o AS (SELECT CAST(o_custkey AS BIGINT) AS territory_id, sum(o_totalprice) AS y FROM orders GROUP BY 1), t AS (SELECT district_type AS g, market_access AS x, y FROM fx_territory JOIN o USING (territory_id)), s AS (SELECT regr_slope(y, x) AS slope, median(x) FILTER (g = 'BUILDING') - median(x) FILTER (g = 'MACHINERY') AS dx, median(y) FILTER (g = 'BUILDING') - median(y) FILTER (g = 'MACHINERY') AS actual FROM t)") + "SELECT round(actual, 2) AS actual, round(slope * dx, 2) AS expected, round(actual - slope * dx, 2) AS unexplained FROM s")
def expected_gap(spark, sf):
    y = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("long").alias("territory_id")).agg(F.sum("o_totalprice").alias("y"))
    t = fx.territory(spark, sf).join(y, "territory_id")
    return rounded(summary.median_gap(t, "district_type", "BUILDING", "MACHINERY", "market_access", "y"), "actual", "expected", "unexplained", digits=2)


@query(with_views("fx_territory", more="n AS (SELECT region_name, district_type, count(*) AS n FROM fx_territory GROUP BY 1, 2)") + "SELECT region_name, district_type, n, round(n / sum(n) OVER (PARTITION BY region_name), 6) AS share, CASE WHEN sum(n) OVER (PARTITION BY region_name) >= 6 THEN rank() OVER (PARTITION BY region_name ORDER BY n DESC) END AS place FROM n")
def type_composition(spark, sf):
    return rounded(summary.composition(fx.territory(spark, sf), "region_name", "district_type", 6), "share")


MODES = """, rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY period) AS u, row_number() OVER (PARTITION BY id ORDER BY period DESC) AS d FROM lb),
f AS (SELECT id, label FROM (SELECT id, label, count(*) AS n FROM rk WHERE u <= 6 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1),
l AS (SELECT id, label FROM (SELECT id, label, count(*) AS n FROM rk WHERE d <= 6 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1)"""


@query(label_sql("SELECT first, last, n, round(n / sum(n) OVER (PARTITION BY first), 6) AS share FROM (SELECT f.label AS first, l.label AS last, count(*) AS n FROM f JOIN l USING (id) GROUP BY 1, 2)", STEPS + MODES))
def mode_flows(spark, sf):
    return rounded(summary.flows(panel.window_modes(labels(spark, sf), 6)), "share")


ANCHOR = "1996-04-01"
ALIGNED = LABELS + f", an AS (SELECT id, label AS there FROM lb WHERE period = DATE '{ANCHOR}'), mp AS (SELECT period, label, there FROM (SELECT period, label, there, count(*) AS n FROM lb JOIN an USING (id) GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY period, label ORDER BY n DESC, there) = 1)"


@query(label_sql("SELECT id, period, label, there AS aligned FROM lb LEFT JOIN mp USING (period, label)", ALIGNED))
def aligned_trajectories(spark, sf):
    return summary.aligned(labels(spark, sf), F.lit(ANCHOR).cast("date")).select("id", "period", "label", "aligned")


SENS = STEPS + ", s AS (SELECT id, count(*) FILTER (changed) AS c, count(*) AS n FROM sp GROUP BY 1), m AS (SELECT id, max(k) AS k FROM (SELECT id, label, count(*) AS k FROM lb GROUP BY 1, 2) GROUP BY 1)"


@query(label_sql("SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (k / n >= t) AS n, round(count(*) FILTER (k / n >= t) / count(*), 6) AS kept, round(avg(c) FILTER (k / n >= t), 6) AS mean_changes FROM s JOIN m USING (id), (SELECT unnest([0.2, 0.3, 0.4, 0.5]::DOUBLE[]) AS t) GROUP BY 1", SENS))
def confidence_sensitivity(spark, sf):
    return rounded(summary.threshold_sensitivity(panel.stability(labels(spark, sf)), [0.2, 0.3, 0.4, 0.5]), "kept", "mean_changes")


@query(node_sql("SELECT i, count(*) FILTER (n / ni >= 0.1) AS parts, round(max(n / ni), 6) AS largest FROM ct GROUP BY 1"))
def label_fragments(spark, sf):
    return rounded(summary.fragmentation(table_of(spark, sf), 0.1), "largest")


@query(label_sql("SELECT w.id, w.period, coalesce(lb.label, 'none') AS label FROM (SELECT id, CAST(period + INTERVAL 3 MONTH AS DATE) AS period FROM lb) w LEFT JOIN lb ON lb.id = w.id AND lb.period = w.period", LABELS))
def label_lookup(spark, sf):
    """Each node's label one quarter later, with a mark where there is none."""
    lb = labels(spark, sf)
    return summary.label_at(lb, lb.select("id", F.add_months("period", 3).alias("period")), "none")


PERIODS = [f"{y}-{m}-01" for y in range(1995, 2002) for m in ("01", "04", "07", "10")]


@query(label_sql("SELECT id, '\"' || id || '\"'" + "".join(f" || ';' || coalesce('\"' || max(label) FILTER (period = DATE '{p}') || '\"', '')" for p in PERIODS) + " AS line FROM lb GROUP BY 1", LABELS))
def label_export(spark, sf):
    return summary.export_lines(labels(spark, sf), PERIODS)


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def merge_exactly_one(spark, sf):
    n = table(spark, sf, "nation").withColumnRenamed("n_regionkey", "key")
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("key"), "r_name")
    return summary.merge_one(n, r, ["key"]).select("n_nationkey", "n_name", "r_name")


@query("SELECT CAST(s_suppkey AS BIGINT) AS key, s_name AS name FROM supplier UNION ALL SELECT CAST(c_custkey AS BIGINT), c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def union_keep_first(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("key"), F.col("s_name").alias("name"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("key"), F.col("c_name").alias("name"))
    return summary.union_first(s, c, ["key"])


EFFECT = "e AS (SELECT period, corr(value, CAST(territory_id AS DOUBLE)) AS r FROM fx_consumption GROUP BY 1)"


@query(with_views("fx_consumption", more=EFFECT) + "SELECT period, round(r, 6) AS r, CASE WHEN abs(r) >= 0.14 THEN 'large' WHEN abs(r) >= 0.06 THEN 'medium' WHEN abs(r) >= 0.01 THEN 'small' ELSE 'none' END AS effect FROM e")
def effect_ladder(spark, sf):
    e = fx.consumption(spark, sf).groupBy("period").agg(F.corr("value", F.col("territory_id").cast("double")).alias("r"))
    return e.select("period", R(F.col("r")).alias("r"), S.effect_label(F.abs("r"), [0.01, 0.06, 0.14], ["none", "small", "medium", "large"]).alias("effect"))
