"""Planar shapes as nested arrays: parts -> rings -> vertices ``struct<x,y>`` (rings closed, holes after the shell)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

VERTEX_TYPE = "struct<x:double,y:double>"
RING_TYPE = f"array<{VERTEX_TYPE}>"
SHAPE_TYPE = f"array<array<{RING_TYPE}>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, not once per mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle_of_bounds(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    ring = F.array(vertex(xmin, ymin), vertex(xmax, ymin), vertex(xmax, ymax), vertex(xmin, ymax), vertex(xmin, ymin))
    return F.array(F.array(ring))


def rectangle(lon: Column, lat: Column, half: Column) -> Column:
    return rectangle_of_bounds(lon - half, lat - half, lon + half, lat + half)


def vertices(shape: Column) -> Column:
    return F.flatten(F.flatten(shape))


def bounds(shape: Column) -> Column:
    """``struct<xmin,ymin,xmax,ymax>`` of all vertices."""
    xs = F.transform(vertices(shape), lambda v: v["x"])
    ys = F.transform(vertices(shape), lambda v: v["y"])
    return F.struct(
        F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax")
    )


def ring_edges(ring: Column) -> Column:
    """Consecutive vertex pairs ``struct<a,b>``."""
    n = F.size(ring)
    starts = F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0)))
    ends = F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def part_edges(part: Column) -> Column:
    return F.flatten(F.transform(part, ring_edges))


def _side(edge: Column, x: Column, y: Column) -> Column:
    """Cross product of the edge and the vector to the point; 0 on the line of the edge."""
    a, b = edge["a"], edge["b"]
    return (b["x"] - a["x"]) * (y - a["y"]) - (x - a["x"]) * (b["y"] - a["y"])


def _on_edge(edge: Column, x: Column, y: Column) -> Column:
    a, b = edge["a"], edge["b"]
    return (
        (_side(edge, x, y) == 0)
        & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"]))
        & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
    )


def _crosses(edge: Column, x: Column, y: Column) -> Column:
    """True where the ray to the right of the point crosses the edge."""
    a, b = edge["a"], edge["b"]
    up = b["y"] > a["y"]
    return ((a["y"] > y) != (b["y"] > y)) & F.when(up, _side(edge, x, y) > 0).otherwise(_side(edge, x, y) < 0)


def point_in_edges(x: Column, y: Column, edges: Column) -> Column:
    """Strictly inside the rings these edges form; edges that do not reach the height of the point may be left out."""
    odd = F.aggregate(edges, F.lit(False), lambda acc, e: acc != _crosses(e, x, y))
    return odd & ~F.exists(edges, lambda e: _on_edge(e, x, y))


def point_in_shape(x: Column, y: Column, shape: Column) -> Column:
    """Strictly inside: even-odd over the rings of a part, any part; boundary points are outside."""

    def in_part(part: Column) -> Column:
        return _let(part_edges(part), lambda edges: point_in_edges(x, y, edges))

    return F.coalesce(F.exists(shape, in_part), F.lit(False))


def edge_distance(x: Column, y: Column, shape: Column) -> Column:
    """Distance from a point to the nearest edge."""

    def squared(e: Column) -> Column:
        a, b = e["a"], e["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        along = F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, dx * dx + dy * dy)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
        ex, ey = x - a["x"] - t * dx, y - a["y"] - t * dy
        return ex * ex + ey * ey

    edges = F.flatten(F.transform(shape, part_edges))
    return F.sqrt(F.array_min(F.transform(edges, squared)))


def point_in_buffered_shape(x: Column, y: Column, shape: Column, distance: float) -> Column:
    """Inside, or nearer to an edge than ``distance``; no buffer polygon is built."""
    return point_in_shape(x, y, shape) | F.coalesce(edge_distance(x, y, shape) < F.lit(distance), F.lit(False))


# How far from an edge, in degrees, a computed point still counts as on it: the rounding of a division.
_ON = 1e-11


def _covered(x: Column, y: Column, shape: Column) -> Column:
    """In the shape or on its boundary, edges between parts included."""
    return point_in_shape(x, y, shape) | F.coalesce(edge_distance(x, y, shape) <= F.lit(_ON), F.lit(False))


def _piece_middles(edge: Column, others: Column) -> Column:
    """Middles of the pieces into which the other edges cut an edge, with the edge's direction."""
    a, b = edge["a"], edge["b"]
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]

    def along(x: Column, y: Column) -> Column:
        return F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, dx * dx + dy * dy)

    def cuts(f: Column) -> Column:
        c, d = f["a"], f["b"]
        fx, fy = d["x"] - c["x"], d["y"] - c["y"]
        cross = dx * fy - dy * fx
        t = F.try_divide((c["x"] - a["x"]) * fy - (c["y"] - a["y"]) * fx, cross)
        u = F.try_divide((c["x"] - a["x"]) * dy - (c["y"] - a["y"]) * dx, cross)
        ends = [F.when(_on_edge(edge, v["x"], v["y"]), along(v["x"], v["y"])) for v in (c, d)]
        return F.array(F.when(u.between(-_ON, 1 + _ON), t), *ends)

    inside = F.filter(F.flatten(F.transform(others, cuts)), lambda t: (t > 0) & (t < 1))

    def middles(ts: Column) -> Column:
        n = F.size(ts)

        def middle(s: Column, t: Column) -> Column:
            m = (s + t) / 2
            return F.struct((a["x"] + m * dx).alias("x"), (a["y"] + m * dy).alias("y"), dx.alias("dx"), dy.alias("dy"))

        return F.zip_with(F.slice(ts, F.lit(1), n - 1), F.slice(ts, F.lit(2), n - 1), middle)

    return _let(F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), inside))), middles)


def shape_in_shape(inner: Column, outer: Column) -> Column:
    """The inner shape lies in the union of the outer parts, boundary allowed; parts may touch or overlap.

    Inner edges are cut where they meet outer ones, and every piece must be covered. Outer edges that run inside the
    inner shape must be covered on both sides: an edge that two parts share is, the rim of a hole is not.
    """
    inner_edges = F.flatten(F.transform(inner, part_edges))
    outer_edges = F.flatten(F.transform(outer, part_edges))
    corners = F.forall(vertices(inner), lambda v: _covered(v["x"], v["y"], outer))

    def pieces(mine: Column, theirs: Column) -> Column:
        rim = F.flatten(F.transform(mine, lambda e: _piece_middles(e, theirs)))
        return F.forall(rim, lambda m: _covered(m["x"], m["y"], outer))

    def both_sides(m: Column) -> Column:
        length = F.sqrt(m["dx"] * m["dx"] + m["dy"] * m["dy"])
        nx, ny = F.try_divide(-m["dy"], length) * 1e-8, F.try_divide(m["dx"], length) * 1e-8
        return _covered(m["x"] + nx, m["y"] + ny, outer) & _covered(m["x"] - nx, m["y"] - ny, outer)

    def no_hole(mine: Column, theirs: Column) -> Column:
        seams = F.flatten(F.transform(theirs, lambda f: _piece_middles(f, F.concat(mine, theirs))))
        within = F.filter(seams, lambda m: point_in_shape(m["x"], m["y"], inner) & (edge_distance(m["x"], m["y"], inner) > _ON))
        return F.forall(within, lambda m: F.coalesce(both_sides(m), F.lit(True)))

    exact = _let(F.struct(inner_edges.alias("i"), outer_edges.alias("o")), lambda e: pieces(e["i"], e["o"]) & no_hole(e["i"], e["o"]))
    return F.coalesce(F.when(corners, exact), F.lit(False))


def _ring_moments(ring: Column) -> Column:
    """Twice the signed area and six times the first moments, relative to the first vertex."""
    origin = F.get(ring, F.lit(0))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def add(acc: Column, e: Column) -> Column:
        ax, ay = e["a"]["x"] - origin["x"], e["a"]["y"] - origin["y"]
        bx, by = e["b"]["x"] - origin["x"], e["b"]["y"] - origin["y"]
        cross = ax * by - bx * ay
        return F.struct(
            (acc["a"] + cross).alias("a"), (acc["mx"] + (ax + bx) * cross).alias("mx"), (acc["my"] + (ay + by) * cross).alias("my")
        )

    def shifted(m: Column) -> Column:
        sign = F.when(m["a"] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
        return F.struct(
            (sign * m["a"]).alias("a"),
            (sign * (m["mx"] + F.lit(3.0) * origin["x"] * m["a"])).alias("mx"),
            (sign * (m["my"] + F.lit(3.0) * origin["y"] * m["a"])).alias("my"),
        )

    return _let(F.aggregate(ring_edges(ring), zero, add), shifted)


def centroid(shape: Column) -> Column:
    """Area centroid ``struct<x,y>``: shells add, holes subtract; vertex mean for a shape without area."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def weighted(part: Column) -> Column:
        return F.transform(
            part,
            lambda ring, i: F.struct(
                (F.when(i == 0, 1.0).otherwise(-1.0)).alias("w"),
                _ring_moments(ring).alias("m"),
            ),
        )

    total = F.aggregate(
        F.flatten(F.transform(shape, weighted)),
        zero,
        lambda acc, r: F.struct(
            (acc["a"] + r["w"] * r["m"]["a"]).alias("a"),
            (acc["mx"] + r["w"] * r["m"]["mx"]).alias("mx"),
            (acc["my"] + r["w"] * r["m"]["my"]).alias("my"),
        ),
    )
    n = F.size(vertices(shape))
    mean = lambda axis: F.try_divide(F.aggregate(vertices(shape), F.lit(0.0), lambda s, v: s + v[axis]), n)

    def point(t: Column) -> Column:
        return F.struct(
            F.coalesce(F.try_divide(t["mx"], F.lit(3.0) * t["a"]), mean("x")).alias("x"),
            F.coalesce(F.try_divide(t["my"], F.lit(3.0) * t["a"]), mean("y")).alias("y"),
        )

    return F.when(shape.isNotNull() & (n > 0), _let(total, point))


def drop_z(shape_xyz: Column) -> Column:
    """Vertices ``struct<x,y,z>`` -> ``struct<x,y>``."""
    flat = lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))
    return F.transform(shape_xyz, lambda part: F.transform(part, lambda ring: F.transform(ring, flat)))


_NUMBER = r"[-+0-9.eE]+"


def _ring_from_text(text: Column) -> Column:
    pairs = F.regexp_extract_all(text, F.lit(rf"({_NUMBER}\s+{_NUMBER})"), F.lit(1))

    def to_vertex(pair: Column) -> Column:
        xy = F.split(pair, r"\s+")
        return F.struct(F.get(xy, F.lit(0)).try_cast("double").alias("x"), F.get(xy, F.lit(1)).try_cast("double").alias("y"))

    return F.transform(pairs, to_vertex)


def parse_wkt(text: Column) -> Column:
    """POINT, POLYGON and MULTIPOLYGON text to a shape; anything else to null. A point is a one-vertex ring."""
    body = F.upper(F.trim(text))
    rings = lambda part: F.transform(F.regexp_extract_all(part, F.lit(r"(\([^()]+\))"), F.lit(1)), _ring_from_text)
    multi = F.transform(F.regexp_extract_all(body, F.lit(r"(\(\s*\([^()]+\)(?:\s*,\s*\([^()]+\))*\s*\))"), F.lit(1)), rings)
    shape = F.when(body.startswith("MULTIPOLYGON") | body.startswith("POLYGON"), multi).when(
        body.startswith("POINT"), F.array(F.array(_ring_from_text(body)))
    )
    return F.when(F.size(vertices(shape)) > 0, shape)


def format_wkt(shape: Column) -> Column:
    """Shape to POINT / POLYGON / MULTIPOLYGON text."""
    pair = lambda v: F.concat_ws(" ", v["x"].cast("string"), v["y"].cast("string"))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, pair), ", "), F.lit(")"))
    part = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, ring), ", "), F.lit(")"))
    parts = F.transform(shape, part)
    only = F.get(F.flatten(F.flatten(shape)), F.lit(0))
    return (
        F.when(F.size(vertices(shape)) == 1, F.concat(F.lit("POINT ("), pair(only), F.lit(")")))
        .when(F.size(shape) == 1, F.concat(F.lit("POLYGON "), F.get(parts, F.lit(0))))
        .when(F.size(shape) > 1, F.concat(F.lit("MULTIPOLYGON ("), F.array_join(parts, ", "), F.lit(")")))
    )


def _coordinates(shape: Column) -> Column:
    return F.transform(shape, lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.array(v["x"], v["y"]))))


def geometry_json(shape: Column) -> Column:
    """GeoJSON text of a shape, always a MultiPolygon."""
    return F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), _coordinates(shape).alias("coordinates")))
