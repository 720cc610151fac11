"""Polygons as arrays: flat coordinates to points, area, perimeter, bounds, self-intersection. All are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def polygon_points(flat: Column) -> Column:
    """[x0, y0, x1, y1, ...] to [(x, y), ...]."""
    n = F.size(flat) / 2
    return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.struct(F.get(flat, 2 * i).alias("x"), F.get(flat, 2 * i + 1).alias("y")))


def edges(points: Column) -> Column:
    """Each point with the next, the last with the first."""
    after = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    return F.zip_with(points, after, lambda p, q: F.struct(p["x"].alias("x"), p["y"].alias("y"), q["x"].alias("u"), q["y"].alias("v")))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def polygon_area(points: Column) -> Column:
    """Shoelace area; 0 for fewer than three points."""
    twice = _total(F.transform(edges(points), lambda e: e["x"] * e["v"] - e["u"] * e["y"]))
    return F.when(F.size(points) < 3, F.lit(0.0)).otherwise(F.abs(twice) / 2)


def polygon_perimeter(points: Column) -> Column:
    return _total(F.transform(edges(points), lambda e: F.sqrt((e["u"] - e["x"]) * (e["u"] - e["x"]) + (e["v"] - e["y"]) * (e["v"] - e["y"]))))


def bounds(points: Column) -> Column:
    """Bounding box as x, y, w, h."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h")
    )


def _turn(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def edges_cross(e: Column, f: Column, eps: float = 1e-9) -> Column:
    """Proper crossing: both ends of each edge lie clearly on different sides of the other."""
    a, b = _turn(e["x"], e["y"], e["u"], e["v"], f["x"], f["y"]), _turn(e["x"], e["y"], e["u"], e["v"], f["u"], f["v"])
    c, d = _turn(f["x"], f["y"], f["u"], f["v"], e["x"], e["y"]), _turn(f["x"], f["y"], f["u"], f["v"], e["u"], e["v"])
    opposite = lambda p, q: ((p > eps) & (q < -eps)) | ((p < -eps) & (q > eps))
    return opposite(a, b) & opposite(c, d)


def crossings(points: Column) -> Column:
    """Crossing points of edges that aren't neighbours, in the order of the edges."""
    numbered = F.transform(edges(points), lambda e, i: F.struct(i.alias("i"), e["x"].alias("x"), e["y"].alias("y"), e["u"].alias("u"), e["v"].alias("v")))
    n = F.size(points)

    def meet(e: Column, f: Column) -> Column:
        away = (f["i"] > e["i"] + 1) & ~((e["i"] == 0) & (f["i"] == n - 1))
        r, s = (e["u"] - e["x"], e["v"] - e["y"]), (f["u"] - f["x"], f["v"] - f["y"])
        t = ((f["x"] - e["x"]) * s[1] - (f["y"] - e["y"]) * s[0]) / F.nullif(r[0] * s[1] - r[1] * s[0], F.lit(0.0))
        return F.when(away & edges_cross(e, f), F.struct((e["x"] + t * r[0]).alias("x"), (e["y"] + t * r[1]).alias("y")))

    found = F.flatten(F.transform(numbered, lambda e: F.array_compact(F.transform(numbered, lambda f: meet(e, f)))))
    return F.when(n >= 4, found).otherwise(F.slice(found, 1, 0))


def is_self_intersecting(points: Column) -> Column:
    return F.size(crossings(points)) > 0
