"""Polygon operators against plain Python."""

import math
import random

import pytest

from meshwork.operators import geometry as G

V = "id long, part long, ring int, at int, x double, y double, hole boolean"


def frame(spark, rings):
    """Rings are (id, part, ring, hole, [(x, y), ...])."""
    return spark.createDataFrame([(i, p, r, at, float(x), float(y), h) for i, p, r, h, xy in rings for at, (x, y) in enumerate(xy)], V)


def clip(subject, window):
    """Convex clipping, window counterclockwise."""
    for (ax, ay), (bx, by) in zip(window, window[1:] + window[:1]):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)
        out = []
        for p, q in zip(subject, subject[1:] + subject[:1]):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if sp * sq < 0:
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        subject = out
        if not subject:
            return []
    return subject


def area(xy):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(xy, xy[1:] + xy[:1])) / 2


def blob(rng, scale):
    cx, cy, r, n = rng.uniform(0, 10), rng.uniform(0, 10), scale * rng.uniform(0.2, 1), rng.randint(3, 9)
    turn = rng.uniform(0, 6)
    return [(cx + r * math.cos(turn + 2 * math.pi * i / n), cy + r * math.sin(turn + 2 * math.pi * i / n)) for i in range(n)]


@pytest.fixture(scope="module")
def convex():
    rng = random.Random(4)
    return [blob(rng, 10.0 ** rng.randint(-2, 1)) for _ in range(120)]


def test_areas_against_clipping(spark, convex):
    rng = random.Random(5)
    turned = [xy if rng.random() < 0.5 else xy[::-1] for xy in convex]
    got = {(r.id_a, r.id_b): r.area for r in G.overlap_areas(frame(spark, [(i, 0, 0, False, xy) for i, xy in enumerate(turned)]), 1e-9).collect()}
    want = {(i, j): abs(area(c)) for i in range(120) for j in range(i + 1, 120) if (c := clip(convex[i], convex[j])) and abs(area(c)) > 1e-9}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-7 for k in want)


def test_each_pair_of_boxes_once(spark, convex):
    b = G.boxes(frame(spark, [(i, 0, 0, False, xy) for i, xy in enumerate(convex)] + [(200, 0, 0, False, [(3, 3)]), (201, 0, 0, False, [(3, 3), (3, 3)])]))
    rows = {r.id: r for r in b.collect()}
    meet = lambda p, q: p.lx <= q.hx and q.lx <= p.hx and p.ly <= q.hy and q.ly <= p.hy
    want = sorted((i, j) for i in rows for j in rows if i < j and meet(rows[i], rows[j]))
    assert sorted((r.id_a, r.id_b) for r in G.meeting_boxes(b).collect()) == want


def test_holes_parts_and_non_convex(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    rings = [
        (1, 0, 0, False, square(0, 0, 10)), (1, 0, 1, True, square(4, 4, 2)), (2, 0, 0, False, square(3, 3, 4)), (2, 1, 0, False, square(20, 0, 1)),
        (3, 0, 0, False, [(0, 0), (10, 0), (10, 10), (9, 10), (9, 1), (1, 1), (1, 10), (0, 10)]), (4, 0, 0, False, square(20.5, 0.5, 3)), (5, 0, 0, False, square(10, 0, 5)),
    ]
    got = {(r.id_a, r.id_b): round(r.area, 9) for r in G.overlap_areas(frame(spark, rings)).collect()}
    assert got == {(1, 2): 12.0, (1, 3): 28.0, (2, 4): 0.25}
    areas = {(r.id, r.part): round(r.area, 9) for r in G.part_areas(frame(spark, rings)).collect()}
    assert areas[1, 0] == 96.0 and areas[3, 0] == 28.0


def test_points(spark, convex):
    rng = random.Random(6)
    star = [(5 + (4 if i % 2 else 1.5) * math.cos(i * math.pi / 20), 5 + (4 if i % 2 else 1.5) * math.sin(i * math.pi / 20)) for i in range(40)]
    shapes = [*convex, star]
    pts = [(k, rng.uniform(-1, 11), rng.uniform(-1, 11)) for k in range(400)]

    def inside(x, y, xy):
        return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(xy, xy[1:] + xy[:1])) % 2 == 1

    want = {(k, i) for k, x, y in pts for i, xy in enumerate(shapes) if inside(x, y, xy)}
    points, v = spark.createDataFrame(pts, "point long, x double, y double"), frame(spark, [(i, 0, 0, False, xy) for i, xy in enumerate(shapes)])
    assert {(r.point, r.id) for r in G.containing(points, v).collect()} == want
    size = [(max(x for x, _ in s) - min(x for x, _ in s)) * (max(y for _, y in s) - min(y for _, y in s)) for s in shapes]
    best = {k: min(((size[i], i) for p, i in want if p == k), default=(0, None))[1] for k, _, _ in pts}
    assert {r.point: r.id for r in G.smallest_hit(points, v).collect()} == best
    assert G.smallest_hit(points.limit(0), v).count() == 0
    assert {r.id for r in G.smallest_hit(points, v.limit(0)).collect()} == {None}


def test_widths(spark):
    a, b = [(0, 0), (1, 0), (1, 1), (1, 2), (0, 2)], [(1, 0), (2, 0), (2, 2), (1, 2), (1, 1)]
    v = frame(spark, [(1, 0, 0, False, a), (2, 0, 0, False, b)])
    same = G.gap_widths(v, v).first()
    assert (same.n_shared, same.width) == (3, 0.0)
    pulled = [(1.3, 0), (2, 0), (2, 2), (1.3, 2)]
    assert abs(G.gap_widths(v, frame(spark, [(1, 0, 0, False, a), (2, 0, 0, False, pulled)])).first().width - 0.3) < 1e-9


def test_rounded_rings(spark):
    v = frame(spark, [(1, 0, 0, False, [(0.1, 0), (2, 0.2), (2.2, 0), (2, 2)]), (1, 1, 0, False, [(5, 5), (5.3, 5), (5, 5.3)]), (2, 0, 0, False, [(0, 0), (0, 3), (3, 3)])])
    r = G.rounded_ring(v, 0)
    assert sorted((x.id, x.part, x.x, x.y) for x in r.where("id = 1").collect()) == [(1, 0, 0.0, 0.0), (1, 0, 2.0, 0.0), (1, 0, 2.0, 2.0)]
    lost = G.lost_parts(v, r, 0.01).collect()
    assert [(x.id, x.parts_before, x.parts_after, x.n_large) for x in lost] == [(1, 2, 1, 1)] and abs(lost[0].lost_area - 0.045) < 1e-9


def test_no_cross_join(spark):
    from meshwork.plans import geometry

    for q in (geometry.overlap_pairs, geometry.smallest_hit):
        plan = q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
