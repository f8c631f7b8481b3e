"""Permutation tests and bootstraps with 5,000 draws over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshwork.functions.scalar import rounded as R
from meshwork.operators import resample, rho
from meshwork.plans.base import query
from meshwork.plans.inference import sample, sql
from meshwork.plans.panels import labels
from meshwork.session import table
from meshwork.sources import fixtures as fx

N = 5000
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query()
def permutation_test(spark, sf):
    """Eta squared of the district type against 5,000 permutations of the types."""
    return resample.permutation_test(sample(spark, sf), "id", "y", "g", N)


@query()
def permutation_test_within(spark, sf):
    """The same on ranks within regions, with permutations within regions."""
    return resample.permutation_test(sample(spark, sf), "id", "y", "g", N, region="r")


def period_tests(spark, sf):
    """A permutation test in every period: spending of territories by their dominant category."""
    spent = fx.consumption(spark, sf).groupBy(F.col("territory_id").alias("id"), "period").agg(F.sum("value").alias("y"))
    rows = spent.join(labels(spark, sf), ["id", "period"]).select("id", "period", "y", F.col("label").alias("g"))
    return resample.permutation_test(rows, "id", "y", "g", N, by=["period"])


@query()
def period_permutation_tests(spark, sf):
    return period_tests(spark, sf)


@query()
def period_verdict(spark, sf):
    """Whether the last period's p is below 0.05 and 23 periods lie above their own null's p95."""
    tests = period_tests(spark, sf)
    return resample.verdict(tests, "period", F.lit("2001-10-01").cast("date"), 0.05, 23)


PAIRS = list(zip(SEGMENTS, SEGMENTS[1:]))
DRAWN = f"""w AS (SELECT id, g, x, draw, {resample.poisson_sql("id", "draw")} FROM (SELECT id, g, x, range AS draw FROM t, range({N}))))),
o AS (SELECT g, draw, x, sum(w) OVER (PARTITION BY g, draw ORDER BY x, id ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY g, draw) AS n FROM w),
m AS (SELECT g, draw, (min(x) FILTER (run >= (n + 1) // 2) + min(x) FILTER (run >= n // 2 + 1)) / 2 AS m FROM o WHERE n > 0 GROUP BY 1, 2),
pr AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in PAIRS)}) AS v(a, b)),
gap AS (SELECT a, b, quantile_cont(q.m - p.m, 0.025) AS low, quantile_cont(q.m - p.m, 0.975) AS high, count(*) AS n FROM pr JOIN m p ON p.g = a JOIN m q ON q.g = b AND q.draw = p.draw GROUP BY 1, 2),
own AS (SELECT g, median(x) AS m FROM t GROUP BY 1)""".replace("ELSE 0 END)) FROM", "ELSE 0 END)) AS w FROM", 1)


@query(sql("SELECT gap.a, gap.b, round(q.m - p.m, 6) AS diff, round(low, 6) AS low, round(high, 6) AS high, n, low > 0 OR high < 0 AS differs FROM gap JOIN own p ON p.g = gap.a JOIN own q ON q.g = gap.b", DRAWN))
def median_gap_bootstrap(spark, sf):
    """Gaps of median access between neighbouring types, with 95 % intervals of 5,000 draws."""
    b = resample.bootstrap_gaps(sample(spark, sf), "id", "x", "g", PAIRS, N)
    return b.select("a", "b", *[R(F.col(c)).alias(c) for c in ("diff", "low", "high")], "n", "differs")


BALANCES = "b AS (SELECT c_custkey AS id, c_acctbal AS x, n AS y, n_name AS r FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey)"


def rho_sql(key: str) -> str:
    """Every draw ranked by windows; ``key`` is what ranks are within, besides the draw."""
    place = lambda v: f"sum(w) OVER (PARTITION BY {key}draw ORDER BY {v}) - (sum(w) OVER (PARTITION BY {key}draw, {v}) - 1) / 2"
    scaled = lambda v: f"({v} - 0.5) / (sum(w) OVER (PARTITION BY {key}draw))" if key else v
    weights = resample.poisson_sql("id", "draw").replace("ELSE 0 END)) FROM", "ELSE 0 END)) AS w FROM", 1)
    drawn = f"SELECT id, x, y, r, draw, {weights} FROM (SELECT b.*, range - 1 AS draw FROM b, range(0, {N} + 1))))"
    own = "CASE WHEN draw < 0 THEN 1 ELSE w END"
    return f"""WITH {BALANCES}, w0 AS ({drawn}), w AS (SELECT * REPLACE ({own} AS w) FROM w0), p AS (SELECT *, {place("x")} AS px, {place("y")} AS py FROM w),
s AS (SELECT *, {scaled("px")} AS u, {scaled("py")} AS v FROM p),
m AS (SELECT draw, sum(w) AS n, sum(w * u) AS su, sum(w * v) AS sv, sum(w * u * u) AS uu, sum(w * v * v) AS vv, sum(w * u * v) AS uv FROM s WHERE w > 0 GROUP BY 1),
c AS (SELECT draw, n, (uv - su * sv / n) / sqrt((uu - su * su / n) * (vv - sv * sv / n)) AS rho FROM m)
SELECT round(max(rho) FILTER (draw < 0), 6) AS rho, round(quantile_cont(rho, 0.025) FILTER (draw >= 0), 6) AS low, round(quantile_cont(rho, 0.975) FILTER (draw >= 0), 6) AS high, CAST(max(n) FILTER (draw < 0) AS BIGINT) AS n_rows, count(*) FILTER (draw >= 0) AS n_draws FROM c"""


def balances(spark, sf):
    """(id, x, y, r): a customer's balance, number of orders and nation."""
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("y"))
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    met = customer.join(orders, customer.c_custkey == orders.o_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    return met.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), "y", F.col("n_name").alias("r"))


def _rho(spark, sf, region=None):
    b = rho.bootstrap_rho(balances(spark, sf), "id", "x", "y", N, region)
    return b.select(*[R(F.col(c)).alias(c) for c in ("rho", "low", "high")], "n_rows", "n_draws")


@query(rho_sql(""))
def rho_bootstrap(spark, sf):
    """Rank correlation of balance and number of orders, with a 95 % interval of 5,000 draws that are each ranked anew."""
    return _rho(spark, sf)


@query(rho_sql("r, "))
def rho_bootstrap_within(spark, sf):
    """The same on ranks within nations."""
    return _rho(spark, sf, "r")
