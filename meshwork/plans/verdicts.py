"""Verdicts on the district types, and names of the dominant categories' types."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshwork.operators import resample, summary, verdicts
from meshwork.plans.base import query
from meshwork.plans.inference import sample
from meshwork.plans.panels import LABELS, labels
from meshwork.plans.summaries import FEATURES, SHARES, shares
from meshwork.session import materialize, table
from meshwork.sources import fixtures as fx
from meshwork.sources.fixtures import with_views

N = 5000
LEAST, MARGIN, SMALLEST = 0.25, 0.1, 0.005


def measured(spark, sf):
    """(id, variable, y, g, r, f): access, number and mean value of orders of every territory that has them."""
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("long").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("orders"), F.avg("o_totalprice").alias("value"))
    wide = sample(spark, sf).join(orders, "id", "left")
    each = F.array(*[F.struct(F.lit(name).alias("variable"), F.col(c).alias("y")) for name, c in (("access", "y"), ("orders", "orders"), ("value", "value"))])
    return materialize(wide.select("id", "g", "r", "f", F.explode(each).alias("v")).select("id", "v.variable", "v.y", "g", "r", "f"))


def tests(spark, sf):
    """A permutation test of each variable at both levels, with the federal district's effect as benchmark; access is exploratory."""
    rows = measured(spark, sf)
    benchmark = resample.Ranked(rows, "id", "y", "f", ["variable"]).observed().select("variable", F.col("eta2").alias("benchmark"))
    out = None
    for level, region in (("all", None), ("within", "r")):
        t = resample.permutation_test(rows, "id", "y", "g", N, ["variable"], region).withColumn("level", F.lit(level))
        out = t if out is None else out.unionByName(t)
    family = F.when(F.col("variable") != "access", F.concat(F.lit("main, "), F.col("level")))
    met = out.join(F.broadcast(benchmark), "variable")  # a row for each of three variables
    found = met.select(
        F.concat(F.lit("district type: "), "variable").alias("hypothesis"), "variable", "level", family.alias("family"), "p", (F.col("observed") > F.col("p95")).alias("confirmed"), "observed",
        verdicts.effect_size(F.col("observed")).alias("size"), "benchmark", F.lit(None).cast("boolean").alias("opposite"),
    )
    return materialize(found)  # six rows, which what follows reads again and again


@query()
def verdict_levels(spark, sf):
    """Each test with its adjusted p, result, ratio to the benchmark and note."""
    return verdicts.assemble(tests(spark, sf))


@query()
def verdict_stages(spark, sf):
    """What the results over all rows and within regions mean together."""
    return verdicts.stages(verdicts.assemble(tests(spark, sf)))


LOGS = "lo AS (SELECT id, period, " + ", ".join(f"ln(({f} + {SMALLEST}) / (1 - {f} + {SMALLEST})) AS {f}" for f in FEATURES) + " FROM sh)"
MEANS = "{to} AS (SELECT label, " + ", ".join(f"round((avg({f}) - (SELECT avg({f}) FROM {{of}})) / (SELECT stddev_pop({f}) FROM {{of}}), 9) AS {{z}}_{f}" for f in FEATURES) + " FROM lb JOIN {of} USING (id, period) GROUP BY 1)"
SIZES = "tt AS (SELECT territory_id AS id, period, sum(value) AS total FROM fx_consumption GROUP BY 1, 2), si AS (SELECT label, median(total) / (SELECT median(total) FROM tt) AS size FROM lb JOIN tt USING (id, period) GROUP BY 1)"
HELD = "[" + ", ".join(f"{{'order': -abs(z_{f}), 'name': '{f}', 'z': z_{f}, 'o': other_{f}}}" for f in FEATURES) + "]"
NAMES = f"""ho AS (SELECT label, size, list_sort(list_filter({HELD}, lambda e: abs(e.z) >= {LEAST} AND abs(e.o) >= {LEAST} AND sign(e.z) = sign(e.o))) AS h FROM z1 JOIN z2 USING (label) JOIN si USING (label))
SELECT label, concat_ws(' · ', CASE WHEN len(h) > 0 THEN array_to_string(list_transform(h, lambda e: e.name || CASE WHEN e.z > 0 THEN ' higher' ELSE ' lower' END), ', ') ELSE 'no distinct profile' END,
 CASE WHEN size >= 1.02 THEN 'large' END, CASE WHEN size <= 0.98 THEN 'small' END) AS name,
 coalesce(array_to_string(list_transform(list_filter(h, lambda e: least(abs(e.z), abs(e.o)) < {LEAST + MARGIN}), lambda e: e.name), ', '), '') AS border FROM ho"""


@query(with_views("fx_consumption", more=", ".join([LABELS, SHARES, LOGS, MEANS.format(to="z1", of="sh", z="z"), MEANS.format(to="z2", of="lo", z="other"), SIZES, NAMES])))
def type_names(spark, sf):
    """Names of the dominant categories' types, from features that hold in shares and in log ratios, with words for size and what lies on the border."""
    rows = labels(spark, sf).join(shares(spark, sf), ["id", "period"])
    total = fx.consumption(spark, sf).groupBy(F.col("territory_id").alias("id"), "period").agg(F.sum("value").alias("total"))
    rows = materialize(rows.join(total, ["id", "period"]))
    logs = rows.withColumns({f: F.ln((F.col(f) + SMALLEST) / (1 - F.col(f) + SMALLEST)) for f in FEATURES})
    first = summary.profile(rows, FEATURES).select("label", *[F.round(f"z_{f}", 9).alias(f"z_{f}") for f in FEATURES])
    second = summary.profile(logs, FEATURES).select("label", *[F.round(f"z_{f}", 9).alias(f"other_{f}") for f in FEATURES])
    size = rows.groupBy("label").agg(F.median("total").alias("m")).join(F.broadcast(rows.agg(F.median("total").alias("all"))))
    types = first.join(second, "label").join(size.select("label", (F.col("m") / F.col("all")).alias("size")), "label")
    return verdicts.type_names(types, FEATURES, [("size", ">=", 1.02, "large"), ("size", "<=", 0.98, "small")], LEAST, MARGIN)
