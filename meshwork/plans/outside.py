"""Types of suppliers outside the sample as of their last eligible quarter; a panel partitioned by month."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from meshwork.functions.scalar import rounded as R
from meshwork.operators import outside as O
from meshwork.plans.base import query
from meshwork.plans.panels import LABELS, labels
from meshwork.session import materialize, shared_folder, table
from meshwork.sources import fixtures as fx
from meshwork.sources import writers
from meshwork.sources.fixtures import with_views

LAST, LEAST = "2001-10-01", 0.4


def share_rows(spark, sf):
    """(id, nation, period, shares by category, n): shares of the categories, and how many a supplier has in a quarter."""
    c = fx.consumption(spark, sf)
    w = c.groupBy(F.col("territory_id").alias("id"), "period").pivot("category", fx.TYPES).agg(F.sum("value"))
    total = sum((F.coalesce(F.col(t), F.lit(0.0)) for t in fx.TYPES), F.lit(0.0))
    n = sum((F.col(t).isNotNull().cast("int") for t in fx.TYPES), F.lit(0))
    return w.select("id", F.floor(F.col("id") / 1000).alias("nation"), "period", *[(F.coalesce(F.col(t), F.lit(0.0)) / total).alias(t) for t in fx.TYPES], n.alias("n"))


X = ", ".join(f"coalesce(sum(value) FILTER (category = '{t}'), 0) / sum(value) AS {t}" for t in fx.TYPES)
Z = ", ".join(f"coalesce(({t} - m_{t}) / nullif(s_{t}, 0), 0)" for t in fx.TYPES)
NEAREST = "list_sort(list_transform((SELECT centres FROM ce), lambda r: {'d': round(sqrt(list_sum(list_transform(list_zip(z, r.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 9), 'label': r.label}))"
OUTSIDE = LABELS + f""", sh AS (SELECT territory_id AS id, territory_id // 1000 AS nation, period, count(*) AS k, {X} FROM fx_consumption GROUP BY 1, 2, 3),
sa AS (SELECT sh.*, lb.label FROM sh JOIN lb USING (id, period) WHERE sh.id % 5 <> 0),
sc AS (SELECT period, {", ".join(f"avg({t}) AS m_{t}, stddev_pop({t}) AS s_{t}" for t in fx.TYPES)} FROM sa GROUP BY 1),
zs AS (SELECT id, nation, period, label, [{Z}] AS z FROM sa JOIN sc USING (period)),
ce AS (SELECT list({{'label': label, 'c': c}} ORDER BY label) AS centres FROM (SELECT label, [{", ".join(f"avg(z[{i + 1}])" for i in range(6))}] AS c FROM zs WHERE period = DATE '{LAST}' GROUP BY 1)),
nr AS (SELECT nation, period, label, {NEAREST} AS o FROM zs),
el AS (SELECT nation, period, count(*) AS n, avg(CAST(o[1].label = label AS INT)) AS agreement, max(o[1].d) AS d_max, avg(CAST(o[1].label = label AS INT)) >= {LEAST} AS eligible FROM nr GROUP BY 1, 2),
ca AS (SELECT id, nation, max(period) AS period FROM sh WHERE id % 5 = 0 AND k >= 5 GROUP BY 1, 2),
sn AS (SELECT ca.*, e.period AS seen, e.d_max FROM ca ASOF LEFT JOIN (SELECT * FROM el WHERE eligible) e ON e.nation = ca.nation AND e.period <= ca.period),
zc AS (SELECT sn.id, sn.period, sn.seen, sn.d_max, CASE WHEN sh.id IS NOT NULL AND sc.period IS NOT NULL THEN [{Z}] END AS z FROM sn LEFT JOIN sh ON sh.id = sn.id AND sh.period = sn.seen LEFT JOIN sc ON sc.period = sn.seen),
fa AS (SELECT *, CASE WHEN z IS NOT NULL THEN {NEAREST} END AS o FROM zc)"""


def prepared(spark, sf):
    rows, lab = materialize(share_rows(spark, sf)), labels(spark, sf)
    sample = rows.where("id % 5 <> 0").join(lab, ["id", "period"])
    scalers = materialize(O.month_scalers(sample, fx.TYPES, "period"))
    z = materialize(O.scaled(sample, scalers, fx.TYPES, "period").select("id", "nation", "period", "label", "z"))
    centre = O.centres(z.where(F.col("period") == F.lit(LAST).cast("date")), len(fx.TYPES))
    return rows, scalers, centre, O.eligibility(z, centre, ["nation", "period"], LEAST)


@query(with_views("fx_consumption", more=OUTSIDE) + "SELECT nation, period, n, round(agreement, 6) AS agreement, round(d_max, 6) AS d_max, eligible FROM el")
def period_eligibility(spark, sf):
    """Where the fixed centres of the last quarter agree with a quarter's own labels often enough."""
    e = prepared(spark, sf)[3]
    return e.select("nation", "period", "n", R(F.col("agreement")).alias("agreement"), R(F.col("d_max")).alias("d_max"), "eligible")


@query(with_views("fx_consumption", more=OUTSIDE) + "SELECT id, period, seen AS period_seen, CASE WHEN z IS NULL THEN 'none' WHEN o[1].d > d_max THEN 'far' ELSE 'assigned' END AS status, CASE WHEN z IS NOT NULL AND o[1].d <= d_max THEN o[1].label END AS label, round(o[1].d, 6) AS d1, round(o[2].d, 6) AS d2, round(o[1].d / nullif(o[2].d, 0), 6) AS ratio FROM fa")
def types_outside_sample(spark, sf):
    """Every fifth supplier is outside the sample: its type as of the last eligible quarter at or before its own last full one."""
    rows, scalers, centre, eligible = prepared(spark, sf)
    last = rows.where("id % 5 = 0 and n >= 5").groupBy("id", "nation").agg(F.max("period").alias("period"))
    seen = O.asof_join(last, eligible.where("eligible").select("nation", "period", "d_max"), ["nation"], "period", ["d_max"])
    at = O.scaled(rows.withColumnRenamed("period", "period_seen"), scalers.withColumnRenamed("period", "period_seen"), fx.TYPES, "period_seen").select("id", "period_seen", "z")
    out = O.assign(seen.join(at, ["id", "period_seen"], "left"), centre)
    return out.select("id", "period", "period_seen", "status", "label", *[R(F.col(c)).alias(c) for c in ("d1", "d2", "ratio")])


def by_month(spark, sf):
    """Orders by customer and month, written with a directory per month and read back."""
    o = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_custkey", "o_totalprice")
    path = f"{shared_folder(spark)}/months-{uuid.uuid4().hex}"
    writers.by_month(o.groupBy("month", "o_custkey").agg(F.sum("o_totalprice").alias("value")), path)
    return spark.read.option("basePath", path).schema("o_custkey long, value double, month string").parquet(path)


@query("WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) AS n, sum(o_totalprice) AS value, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY 1) SELECT month, n_customers, round(value, 2) AS value FROM m WHERE urgent * 5 > n")
def pruned_months(spark, sf):
    """Customers and spending of the months in which more than a fifth of the orders are urgent: only their directories are read."""
    o = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderpriority")
    busy = o.groupBy("month").agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count(F.lit(1)).alias("n")).where("urgent * 5 > n")
    return by_month(spark, sf).join(F.broadcast(busy.select("month")), "month").groupBy("month").agg(F.count(F.lit(1)).alias("n_customers"), F.round(F.sum("value"), 2).alias("value"))
