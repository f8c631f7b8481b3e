"""Column functions; each is an expression that Catalyst compiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def rounded(x: Column, digits: int = 6) -> Column:
    """Half-up rounding without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def rounded_fast(x: Column, digits: int = 6) -> Column:
    """Half-up rounding of numbers that aren't negative, by scaling; ``round`` goes through a decimal, which costs more than a distance does."""
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    return arc_km(p1, F.radians(lon1), F.cos(p1), p2, F.radians(lon2), F.cos(p2))


def arc_km(p1: Column, l1: Column, c1: Column, p2: Column, l2: Column, c2: Column) -> Column:
    """The haversine distance from latitudes p and longitudes l in radians and the cosines c of the latitudes."""
    a, b = F.sin((p2 - p1) / 2), F.sin((l2 - l1) / 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a * a + c1 * c2 * (b * b), F.lit(1.0))))


def bin_right(x: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the bin (lo, hi] that holds x; null outside."""
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges, edges[1:], labels))):
        out = F.when((x > lo) & (x <= hi), label).otherwise(out)
    return out


def bin_left(x: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the bin [lo, hi) that holds x; the last bin has no upper end."""
    out = F.lit(None).cast("string")
    for lo, label in zip(edges, labels):
        out = F.when(x >= lo, label).otherwise(out)
    return out


def effect_label(x: Column, cuts: list[float], labels: list[str]) -> Column:
    """labels[number of cuts that x has reached]."""
    out = F.lit(labels[0])
    for cut, label in zip(cuts, labels[1:]):
        out = F.when(x >= cut, label).otherwise(out)
    return out


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def positive_log(x: Column) -> Column:
    """ln x; the query fails if an x is not positive."""
    return F.when(F.assert_true(x > 0, F.lit("a logarithm needs positive values")).isNull(), F.ln(x))


def latin_codes(x: Column) -> Column:
    """Cyrillic letters of sector codes that look like Latin ones, as Latin."""
    return F.translate(x, "АВЕН", "ABEH")


def numbers_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[0-9]+(?:[.][0-9]+)?"), F.lit(0))


def search_rank(name: Column, region: Column, term: str) -> Column:
    """0 for the whole name, 1 for the start of a word, 2 for within the name, 3 for the region; null else."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    n, t = norm(name), " ".join("".join(c if c.isalnum() else " " for c in term.lower()).split())
    return F.when(n == t, 0).when(F.concat(F.lit(" "), n).contains(" " + t), 1).when(n.contains(t), 2).when(norm(region).contains(t), 3)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def ring_area(ring: Column) -> Column:
    """Twice-signed shoelace area halved, of a closed ring of structs (x, y)."""
    n = F.size(ring)
    return F.aggregate(F.sequence(F.lit(0), n - 2), F.lit(0.0), lambda s, i: s + (ring[i]["x"] * ring[i + 1]["y"] - ring[i + 1]["x"] * ring[i]["y"])) / 2


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray crossing: whether (x, y) lies within a closed ring of structs (x, y)."""

    def crosses(i: Column) -> Column:
        a, b = ring[i], ring[i + 1]
        up = (a["y"] > y) != (b["y"] > y)
        return F.when(up, (x < (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]) + a["x"]).cast("int")).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.size(ring) - 2), F.lit(0), lambda s, i: s + crosses(i)) % 2 == 1


def shift_lon(lon: Column) -> Column:
    """Western longitudes continue past 180."""
    return F.when(lon < 0, lon + 360).otherwise(lon)
