"""Polygons as rows: boxes, overlaps, points in polygons, boundary distances.

A polygon is rows (id, part, ring, at, x, y): an id has parts, a part an outer ring and holes, a ring its vertices in order (not
closed, either way round). Rings of a part with ``hole`` true count as holes.

Boxes meet by a grid of many levels: a box belongs to the level whose cells are at least its size, and lies in four cells there at most.
It probes the cells of its own and all coarser levels, so a large box doesn't fall into many small cells, and
small boxes don't share one large cell. A pair is met in the one cell that holds the lower corner of its intersection; no distinct is needed.

The area of an intersection is a sum over pairs of edges. With s the side on which an edge bounds its polygon, a polygon is the sum of the signed strips
below its edges, so that the intersection is the sum, over pairs of edges, of the signed integral of the lower edge. It
holds for any simple polygons with holes, and needs no clipping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.session import materialize

#: Level of a box without extent, and edges of a band of a polygon.
POINT_LEVEL = -40
BAND = 8
MAX_BANDS = 4096


def edges(vertices: DataFrame) -> DataFrame:
    """(id, part, x1, y1, x2, y2, s): edges of the closed rings; s is 1 above the polygon's interior, -1 below it, 0 if vertical."""
    ring = Window.partitionBy("id", "part", "ring").orderBy("at")
    whole = Window.partitionBy("id", "part", "ring")
    first = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = vertices.select(
        "id", "part", F.col("x").alias("x1"), F.col("y").alias("y1"), F.coalesce(F.lead("x").over(ring), F.first("x").over(first)).alias("x2"),
        F.coalesce(F.lead("y").over(ring), F.first("y").over(first)).alias("y2"), (F.col("hole") if "hole" in vertices.columns else F.lit(False)).alias("hole"), "ring",
    )
    turn = F.signum(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")).over(whole))
    return e.withColumn("s", (F.signum(F.col("x1") - F.col("x2")) * turn * F.when(F.col("hole"), -1).otherwise(1)).cast("int")).drop("hole", "ring")


def boxes(vertices: DataFrame) -> DataFrame:
    """(id, part, lx, ly, hx, hy, n): bounding boxes of parts and their vertices."""
    return vertices.groupBy("id", "part").agg(F.min("x").alias("lx"), F.min("y").alias("ly"), F.max("x").alias("hx"), F.max("y").alias("hy"), F.count(F.lit(1)).alias("n"))


def _level(box: DataFrame) -> Column:
    extent = F.greatest(F.col("hx") - F.col("lx"), F.col("hy") - F.col("ly"))
    return F.when(extent > 0, F.greatest(F.ceil(F.log2(extent)), F.lit(POINT_LEVEL))).otherwise(F.lit(POINT_LEVEL)).cast("int")


def _cell(v: Column, level: Column) -> Column:
    return F.floor(v / F.pow(F.lit(2.0), level)).cast("long")


def _in_cells(box: DataFrame, level: str = "cell_level") -> DataFrame:
    """The box once for each cell of ``level`` that it meets."""
    at = F.col(level)
    across = box.withColumn("cx", F.explode(F.sequence(_cell(F.col("lx"), at), _cell(F.col("hx"), at))))
    return across.withColumn("cy", F.explode(F.sequence(_cell(F.col("ly"), at), _cell(F.col("hy"), at))))


def _levels(box: DataFrame) -> list[int]:
    """The levels that occur, a hundred or so at most whatever the data."""
    return sorted(r[0] for r in box.select("level").distinct().collect())


def meeting_boxes(box: DataFrame) -> DataFrame:
    """(id_a, part_a, id_b, part_b) of parts of different ids whose boxes meet, id_a < id_b; each pair once."""
    box = box.withColumn("level", _level(box))
    levels = F.array(*[F.lit(x) for x in _levels(box)])
    names = ["id", "part", "level", "lx", "ly", "hx", "hy"]
    host = _in_cells(box.withColumn("cell_level", F.col("level"))).select("cell_level", "cx", "cy", *[F.col(c).alias(f"h_{c}") for c in names])
    guest = _in_cells(box.withColumn("cell_level", F.explode(F.filter(levels, lambda x: x >= F.col("level"))))).select("cell_level", "cx", "cy", *[F.col(c).alias(f"g_{c}") for c in names])
    # sizes of exploded rows are underrated, so joins here are never left to a broadcast
    met = guest.join(host.hint("merge"), ["cell_level", "cx", "cy"])
    left, low = F.greatest("g_lx", "h_lx"), F.greatest("g_ly", "h_ly")
    meets = (left <= F.least("g_hx", "h_hx")) & (low <= F.least("g_hy", "h_hy"))
    once = (F.col("g_id") != F.col("h_id")) & ((F.col("g_level") < F.col("h_level")) | (F.col("g_id") < F.col("h_id")))
    here = (_cell(left, F.col("cell_level")) == F.col("cx")) & (_cell(low, F.col("cell_level")) == F.col("cy"))
    first = F.col("g_id") < F.col("h_id")
    pick = lambda c, a: (F.when(first, F.col(f"g_{c}")).otherwise(F.col(f"h_{c}")) if a else F.when(first, F.col(f"h_{c}")).otherwise(F.col(f"g_{c}")))
    return met.where(meets & once & here).select(pick("id", True).alias("id_a"), pick("part", True).alias("part_a"), pick("id", False).alias("id_b"), pick("part", False).alias("part_b"))


def _at(p: str, x: Column) -> Column:
    """Height of edge ``p`` at x."""
    x1, y1, x2, y2 = (F.col(f"{p}.{c}") for c in ("x1", "y1", "x2", "y2"))
    return y1 + (y2 - y1) * (x - x1) / (x2 - x1)


def lower_strip(base: Column) -> Column:
    """Signed integral, above ``base``, of the lower of edges p and q over the stretch where both are."""
    lo = lambda p: F.least(f"{p}.x1", f"{p}.x2")
    hi = lambda p: F.greatest(f"{p}.x1", f"{p}.x2")
    l, r = F.greatest(lo("p"), lo("q")), F.least(hi("p"), hi("q"))
    pl, pr, ql, qr = _at("p", l) - base, _at("p", r) - base, _at("q", l) - base, _at("q", r) - base
    dl, dr = pl - ql, pr - qr
    ml, mr = F.least(pl, ql), F.least(pr, qr)
    t = dl / (dl - dr)
    cross = pl + t * (pr - pl)
    area = F.when(dl * dr >= 0, (ml + mr) / 2).otherwise(t * (ml + cross) / 2 + (1 - t) * (cross + mr) / 2)
    return F.when(l < r, F.col("p.s") * F.col("q.s") * (r - l) * area).otherwise(0.0)


def overlap_areas(vertices: DataFrame, min_area: float = 0.0) -> DataFrame:
    """(id_a, id_b, area), id_a < id_b: how much two polygons share, where it is more than ``min_area``.

    Parts of one id are taken as disjoint. Rows with nulls in coordinates must be left out before; an empty table has no overlaps.
    """
    box = materialize(boxes(vertices))
    e = edges(vertices).where("s <> 0").groupBy("id", "part").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2", "s")).alias("e"))
    side = lambda c: e.select(F.col("id").alias(f"id_{c}"), F.col("part").alias(f"part_{c}"), F.col("e").alias(f"e_{c}")).hint("merge")
    base = box.select(F.col("id").alias("id_a"), F.col("part").alias("part_a"), F.col("ly").alias("base")).hint("merge")
    both = meeting_boxes(box).join(base, ["id_a", "part_a"]).join(side("a"), ["id_a", "part_a"]).join(side("b"), ["id_b", "part_b"])
    both = both.withColumn("p", F.explode("e_a")).select("id_a", "id_b", "base", "p", F.explode("e_b").alias("q"))
    return both.groupBy("id_a", "id_b").agg(F.sum(lower_strip(F.col("base"))).alias("area")).where(F.col("area") > min_area)


def _bands(box: DataFrame) -> DataFrame:
    return box.withColumn("bands", F.least(F.lit(MAX_BANDS), F.ceil(F.col("n") / BAND)).cast("int"))


def _band(y: Column) -> Column:
    """The band of a height in its part's box; it never falls as y grows."""
    place = F.floor((y - F.col("ly")) / (F.col("hy") - F.col("ly")) * F.col("bands")).cast("int")
    return F.when(F.col("hy") > F.col("ly"), F.greatest(F.lit(0), F.least(place, F.col("bands") - 1))).otherwise(F.lit(0))


def crosses() -> Column:
    """Whether the ray from (x, y) to the right crosses the edge."""
    up = (F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))
    return up & (F.col("x") < (F.col("x2") - F.col("x1")) * F.try_divide(F.col("y") - F.col("y1"), F.col("y2") - F.col("y1")) + F.col("x1"))


def containing(points: DataFrame, vertices: DataFrame) -> DataFrame:
    """(point, x, y, id): all polygons that hold a point (point, x, y), by the parity of a ray.

    Points and parts meet in grid cells. A part's edges are indexed by bands of its height, and a
    point meets the edges of its own band, so a point in a polygon of many edges is compared with few of them.
    """
    box = boxes(vertices)
    box = _bands(box.withColumn("level", _level(box)))
    levels = F.array(*[F.lit(x) for x in _levels(box)])
    at = points.withColumn("cell_level", F.explode(levels)).withColumn("cx", _cell(F.col("x"), F.col("cell_level"))).withColumn("cy", _cell(F.col("y"), F.col("cell_level")))
    host = _in_cells(box.withColumn("cell_level", F.col("level")))
    near = at.join(host, ["cell_level", "cx", "cy"]).where("x between lx and hx and y between ly and hy")
    near = near.select("point", "x", "y", "id", "part", _band(F.col("y")).alias("band"))
    e = edges(vertices).join(box, ["id", "part"])
    banded = e.withColumn("band", F.explode(F.sequence(_band(F.least("y1", "y2")), _band(F.greatest("y1", "y2"))))).select("id", "part", "band", "x1", "y1", "x2", "y2")
    hits = near.join(banded, ["id", "part", "band"]).where(crosses()).groupBy("point", "x", "y", "id", "part").agg(F.count(F.lit(1)).alias("n"))
    return hits.where("n % 2 = 1").groupBy("point", "x", "y", "id").agg(F.count(F.lit(1)).alias("n_parts")).select("point", "x", "y", "id")


def smallest_hit(points: DataFrame, vertices: DataFrame) -> DataFrame:
    """(point, id) of each point: of the polygons that hold it, the one with the smallest box, then the smallest id; null if none."""
    area = vertices.groupBy("id").agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("box"))
    best = containing(points, vertices).join(area, "id").groupBy("point").agg(F.min(F.struct("box", "id")).alias("m")).select("point", F.col("m.id").alias("id"))
    return points.select("point").join(best, "point", "left")


def shared_vertices(vertices: DataFrame, least: int = 2) -> DataFrame:
    """(id_a, id_b, x, y): vertices that two ids have exactly in common, where they share at least ``least``."""
    v = vertices.select("id", "x", "y").distinct()
    a, b = v.withColumnRenamed("id", "id_a"), v.withColumnRenamed("id", "id_b")
    met = a.join(b.hint("merge"), ["x", "y"]).where("id_a < id_b")
    many = met.groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("id_a", "id_b")
    return met.join(many.hint("merge"), ["id_a", "id_b"]).select("id_a", "id_b", "x", "y")


def signed_distance(points: DataFrame, vertices: DataFrame) -> DataFrame:
    """``points`` (id, x, y) with ``d``: distance to the boundary of polygon ``id``, negative outside; a row per distinct point."""
    e = edges(vertices).select("id", "x1", "y1", "x2", "y2")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy) / size))).otherwise(0.0)
    gap = F.hypot(F.col("x") - F.col("x1") - t * dx, F.col("y") - F.col("y1") - t * dy)
    met = points.select("id", "x", "y").distinct().join(e.hint("merge"), "id")
    out = met.groupBy("id", "x", "y").agg(F.min(gap).alias("far"), F.count_if(crosses()).alias("n"))
    return out.select("id", "x", "y", F.when(F.col("n") % 2 == 1, F.col("far")).otherwise(-F.col("far")).alias("d"))


def gap_widths(original: DataFrame, simplified: DataFrame) -> DataFrame:
    """(id_a, id_b, n_shared, width): how far two simplified neighbours part at most along the border that they shared.

    At a shared vertex, the boundary of a lies d_a outwards of it and that of b d_b inwards of a; the width is the greatest |d_a - d_b|. All shared vertices are taken.
    """
    v = materialize(shared_vertices(original))
    own = v.select(F.col("id_a").alias("id"), "x", "y").unionByName(v.select(F.col("id_b").alias("id"), "x", "y"))
    d = materialize(signed_distance(own, simplified)).hint("merge")
    a, b = d.select(F.col("id").alias("id_a"), "x", "y", F.col("d").alias("d_a")), d.select(F.col("id").alias("id_b"), "x", "y", F.col("d").alias("d_b"))
    return v.join(a, ["id_a", "x", "y"]).join(b, ["id_b", "x", "y"]).groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("n_shared"), F.max(F.abs(F.col("d_a") + F.col("d_b"))).alias("width"))


def rounded_ring(vertices: DataFrame, digits: int) -> DataFrame:
    """The vertices after rounding, without repeats of the vertex before and without rings that have no area left."""
    ring = Window.partitionBy("id", "part", "ring")
    r = vertices.withColumn("x", F.round("x", digits)).withColumn("y", F.round("y", digits))
    last = F.last(F.struct("x", "y")).over(ring.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = F.coalesce(F.lag(F.struct("x", "y")).over(ring.orderBy("at")), last)
    kept = r.withColumn("_before", before).where("not (x <=> _before.x and y <=> _before.y)").drop("_before")
    nx, ny = (F.coalesce(F.lead(c).over(ring.orderBy("at")), F.first(c).over(ring.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) for c in ("x", "y"))
    turned = kept.withColumn("_c", F.col("x") * ny - nx * F.col("y"))
    return turned.withColumn("_a", F.abs(F.round(F.sum("_c").over(ring), 9))).where("_a > 0").drop("_a", "_c")


def part_areas(vertices: DataFrame) -> DataFrame:
    """(id, part, area): outer ring less holes, whichever way the rings turn."""
    e = edges(vertices)
    return e.groupBy("id", "part").agg(F.sum(F.col("s") * F.abs(F.col("x2") - F.col("x1")) * (F.col("y1") + F.col("y2")) / 2).alias("area"))


def lost_parts(before: DataFrame, after: DataFrame, large: float) -> DataFrame:
    """(id, parts_before, parts_after, lost_area, n_large) of ids that lost parts in a simplification that keeps the names of parts.

    ``n_large`` counts lost parts of at least the area ``large``.
    """
    left = after.select("id", "part").distinct().withColumn("kept", F.lit(True))
    p = part_areas(before).join(left, ["id", "part"], "left")
    gone = F.col("kept").isNull()
    out = p.groupBy("id").agg(F.count(F.lit(1)).alias("parts_before"), F.count_if(~gone).alias("parts_after"), F.sum(F.when(gone, F.col("area"))).alias("lost_area"), F.count_if(gone & (F.col("area") >= large)).alias("n_large"))
    return out.where("parts_after < parts_before")
