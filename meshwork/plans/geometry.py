"""Polygons drawn from orders: each order is a part of its customer's polygon; events are points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.functions.scalar import rounded as R
from meshwork.operators import geometry as G
from meshwork.plans.base import query
from meshwork.session import table

#: Parts of a row of the plane.
ACROSS = 50


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """Stars of four to eight corners, two wide at most, one beside another in rows of fifty; every hundredth is six times as large."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("part"), F.floor("o_totalprice").cast("long").alias("p"))
    k = (F.col("part") % 5 + 4).cast("int")
    v = o.withColumn("at", F.explode(F.sequence(F.lit(0), k - 1)))
    size = (0.3 + (F.col("p") % 100) / 100.0 * 0.7) * F.when(F.col("part") % 100 == 0, 6.0).otherwise(1.0) * F.when(F.col("at") % 2 == 0, 1.0).otherwise(0.6)
    angle = 2 * 3.141592653589793 * F.col("at") / k + (F.col("part") % 7) / 7.0
    x, y = F.col("part") % ACROSS + (F.col("p") % 10) / 10.0, F.floor(F.col("part") / ACROSS) + (F.col("id") % 10) / 10.0
    return v.select("id", "part", F.lit(0).alias("ring"), "at", F.round(x + size * F.cos(angle), 4).alias("x"), F.round(y + size * F.sin(angle), 4).alias("y"))


PARTS = f"""o AS (SELECT o_custkey AS id, o_orderkey AS part, CAST(floor(o_totalprice) AS BIGINT) AS p, CAST(o_orderkey % 5 + 4 AS INT) AS k FROM orders),
v AS (SELECT id, part, nr, round(part % {ACROSS} + (p % 10) / 10.0::DOUBLE + size * cos(angle), 4) AS x, round(floor(part / {ACROSS}) + (id % 10) / 10.0::DOUBLE + size * sin(angle), 4) AS y FROM
    (SELECT id, part, p, nr, (0.3::DOUBLE + (p % 100) / 100.0::DOUBLE * 0.7::DOUBLE) * CASE WHEN part % 100 = 0 THEN 6 ELSE 1 END * CASE WHEN nr % 2 = 0 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END AS size,
        2 * 3.141592653589793::DOUBLE * nr / k + (part % 7) / 7.0::DOUBLE AS angle FROM (SELECT *, unnest(range(k)) AS nr FROM o))),
e AS (SELECT id, part, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM v WINDOW w AS (PARTITION BY part ORDER BY nr)),
bx AS (SELECT id, part, min(x) AS lx, min(y) AS ly, max(x) AS hx, max(y) AS hy FROM v GROUP BY 1, 2)"""

STRIPS = PARTS + """, met AS (SELECT a.id AS id_a, a.part AS part_a, b.id AS id_b, b.part AS part_b FROM bx a JOIN bx b ON a.lx <= b.hx AND b.lx <= a.hx AND a.ly <= b.hy AND b.ly <= a.hy AND a.id < b.id),
pq AS (SELECT id_a, id_b, sign(p.x1 - p.x2) * sign(q.x1 - q.x2) AS s, greatest(least(p.x1, p.x2), least(q.x1, q.x2)) AS l, least(greatest(p.x1, p.x2), greatest(q.x1, q.x2)) AS r,
    (p.y2 - p.y1) / (p.x2 - p.x1) AS mp, p.y1 AS yp, p.x1 AS xp, (q.y2 - q.y1) / (q.x2 - q.x1) AS mq, q.y1 AS yq, q.x1 AS xq
    FROM met JOIN e p ON p.part = part_a AND p.x1 <> p.x2 JOIN e q ON q.part = part_b AND q.x1 <> q.x2),
ends AS (SELECT id_a, id_b, s, r - l AS w, yp + mp * (l - xp) AS pl, yp + mp * (r - xp) AS pr, yq + mq * (l - xq) AS ql, yq + mq * (r - xq) AS qr FROM pq WHERE l < r),
strip AS (SELECT id_a, id_b, s * w * CASE WHEN (pl - ql) * (pr - qr) >= 0 THEN (least(pl, ql) + least(pr, qr)) / 2
    ELSE (pl - ql) / (pl - ql - pr + qr) * (least(pl, ql) + pl + (pl - ql) / (pl - ql - pr + qr) * (pr - pl)) / 2
        + (1 - (pl - ql) / (pl - ql - pr + qr)) * (least(pr, qr) + pl + (pl - ql) / (pl - ql - pr + qr) * (pr - pl)) / 2 END AS a FROM ends)"""


@query("WITH " + STRIPS + " SELECT id_a, id_b, round(sum(a), 4) AS area FROM strip GROUP BY 1, 2 HAVING sum(a) > 0.01")
def overlap_pairs(spark, sf):
    """Pairs of customers whose polygons share more than 0.01, with the area of the intersection."""
    return G.overlap_areas(parts(spark, sf), 0.01).withColumn("area", R(F.col("area"), 4))


def points(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    place = F.col("event_id")
    return e.select(F.col("event_id").alias("point"), (place % 499 / 10.0 + 0.0123).alias("x"), (F.floor(place / 7) % 300 / 10.0 + F.col("user_id") / 100.0 + 0.0077).alias("y"))


POINTS = PARTS + """, pt AS (SELECT event_id AS point, event_id % 499 / 10.0::DOUBLE + 0.0123::DOUBLE AS x, floor(event_id / 7) % 300 / 10.0::DOUBLE + user_id / 100.0::DOUBLE + 0.0077::DOUBLE AS y FROM events),
hit AS (SELECT point, bx.id, bx.part FROM pt JOIN bx ON x BETWEEN lx AND hx AND y BETWEEN ly AND hy JOIN e ON e.part = bx.part AND (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1),
size AS (SELECT id, (max(hx) - min(lx)) * (max(hy) - min(ly)) AS box FROM bx GROUP BY 1)"""


@query("WITH " + POINTS + " SELECT pt.point, h.id FROM pt LEFT JOIN (SELECT point, arg_min(id, (box, id)) AS id FROM (SELECT DISTINCT point, id FROM hit) JOIN size USING (id) GROUP BY 1) h ON h.point = pt.point")
def smallest_hit(spark, sf):
    """The polygon under each event's point: of those that hold it, the one with the smallest box."""
    return G.smallest_hit(points(spark, sf), parts(spark, sf))


@query("WITH " + POINTS + " SELECT id, count(DISTINCT point) AS n_points FROM hit GROUP BY 1")
def points_per_polygon(spark, sf):
    return G.containing(points(spark, sf), parts(spark, sf)).groupBy("id").agg(F.count(F.lit(1)).alias("n_points"))


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as tiles of a plane, fifty to a row; neighbours share two corners and the point between them."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    i, j = F.col("id") % ACROSS, F.floor(F.col("id") / ACROSS).cast("long")
    ring = [(0, 0), (1, 0), (2, 0), (2, 1), (2, 2), (1, 2), (0, 2), (0, 1)]
    corners = F.array(*[F.struct(F.lit(n).alias("at"), (2 * i + a).alias("u"), (2 * j + b).alias("v")) for n, (a, b) in enumerate(ring)])
    t = c.withColumn("q", F.explode(corners)).select("id", F.col("id").alias("part"), F.lit(0).alias("ring"), F.col("q.at").alias("at"), F.col("q.u").alias("u"), F.col("q.v").alias("v"))
    return t.withColumn("x", F.col("u") + (F.col("u") * 7 + F.col("v") * 13) % 10 / 25.0).withColumn("y", F.col("v") + (F.col("u") * 11 + F.col("v") * 3) % 10 / 25.0)


def simplified(t: DataFrame) -> DataFrame:
    """Without the point between two corners wherever (id + its place) % 3 is zero, and rounded to one digit."""
    return G.rounded_ring(t.where("at % 2 = 0 or (id + at) % 3 <> 0"), 1)


TILES = f"""ring AS (SELECT * FROM (VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 2, 1), (4, 2, 2), (5, 1, 2), (6, 0, 2), (7, 0, 1)) AS r(nr, a, b)),
uv AS (SELECT c_custkey AS id, nr, 2 * (c_custkey % {ACROSS}) + a AS u, 2 * (c_custkey // {ACROSS}) + b AS v FROM customer, ring),
v AS (SELECT id, nr, u + (u * 7 + v * 13) % 10 / 25.0::DOUBLE AS x, v + (u * 11 + v * 3) % 10 / 25.0::DOUBLE AS y FROM uv),
s AS (SELECT id, nr, round(x, 1) AS x, round(y, 1) AS y FROM v WHERE nr % 2 = 0 OR (id + nr) % 3 <> 0),
e AS (SELECT id, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM s WINDOW w AS (PARTITION BY id ORDER BY nr)),
sv AS (SELECT a.id AS id_a, b.id AS id_b, a.x, a.y, count(*) OVER (PARTITION BY a.id, b.id) AS n FROM v a JOIN v b ON a.x = b.x AND a.y = b.y AND a.id < b.id QUALIFY n >= 2),
own AS (SELECT id_a AS id, x, y FROM sv UNION SELECT id_b, x, y FROM sv),
near AS (SELECT id, x, y, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / nullif(pow(x2 - x1, 2) + pow(y2 - y1, 2), 0))) AS t, x1, y1, x2, y2 FROM own JOIN e USING (id)),
d AS (SELECT id, x, y, min(sqrt(pow(x - x1 - coalesce(t, 0) * (x2 - x1), 2) + pow(y - y1 - coalesce(t, 0) * (y2 - y1), 2))) * CASE WHEN count(*) FILTER ((y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) % 2 = 1 THEN 1 ELSE -1 END AS d FROM near GROUP BY 1, 2, 3)"""


@query("WITH " + TILES + " SELECT id_a, id_b, count(*) AS n_shared, round(max(abs(a.d + b.d)), 6) AS width FROM sv JOIN d a ON a.id = id_a AND a.x = sv.x AND a.y = sv.y JOIN d b ON b.id = id_b AND b.x = sv.x AND b.y = sv.y GROUP BY 1, 2")
def gap_widths(spark, sf):
    """How far neighbours part along their common border when each is simplified for itself."""
    t = tiles(spark, sf)
    return G.gap_widths(t, simplified(t)).withColumn("width", R(F.col("width")))


LOST = PARTS + """, rv AS (SELECT part, nr, round(x) AS x, round(y) AS y FROM v),
rk AS (SELECT * FROM (SELECT *, coalesce(lag({'x': x, 'y': y}) OVER w, last_value({'x': x, 'y': y}) OVER (PARTITION BY part ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS b FROM rv WINDOW w AS (PARTITION BY part ORDER BY nr)) WHERE NOT (x = b.x AND y = b.y)),
ra AS (SELECT part, sum(x * ny - nx * y) AS a FROM (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM rk WINDOW w AS (PARTITION BY part ORDER BY nr)) GROUP BY 1 HAVING round(abs(a), 9) > 0),
pa AS (SELECT id, e.part, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area, any_value(ra.part) IS NULL AS gone FROM e LEFT JOIN ra ON ra.part = e.part GROUP BY 1, 2)"""


@query("WITH " + LOST + " SELECT id, count(*) AS parts_before, count(*) FILTER (NOT gone) AS parts_after, round(sum(area) FILTER (gone) + 1e-10, 6) AS lost_area, count(*) FILTER (gone AND area >= 0.5) AS n_large FROM pa GROUP BY 1 HAVING count(*) FILTER (gone) > 0")
def lost_parts(spark, sf):
    """Customers whose polygons lose parts when coordinates are rounded to whole units."""
    v = parts(spark, sf)
    return G.lost_parts(v, G.rounded_ring(v, 0), 0.5).withColumn("lost_area", R(F.col("lost_area") + 1e-10))
