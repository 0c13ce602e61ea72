"""Hexagonal cells on an equirectangular plane, as plain column arithmetic.

A cell is ``struct<q:bigint,r:bigint>`` (axial coordinates, pointy top); ``edge`` is its edge length in
degrees. Distance, rings and covers follow the usual hexagon rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_EDGE = 0.0018  # about 0.2 km
CELL_TYPE = "struct<q:bigint,r:bigint>"
_SQRT3 = math.sqrt(3.0)


def cell_of_point(lon: Column, lat: Column, edge: float = DEFAULT_EDGE, lon_scale: float = 1.0) -> Column:
    """Cell holding a point; null where a coordinate is missing.

    ``lon_scale`` shrinks a degree of longitude, ``cos(latitude)`` of the area of interest.
    """
    x = lon if lon_scale == 1.0 else lon * F.lit(lon_scale)
    q = (x * F.lit(_SQRT3 / 3.0) - lat * F.lit(1.0 / 3.0)) / F.lit(edge)
    r = (lat * F.lit(2.0 / 3.0)) / F.lit(edge)
    s = -q - r
    half = F.lit(0.5)
    rq, rr, rs = F.floor(q + half), F.floor(r + half), F.floor(s + half)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    q_worst = (dq > dr) & (dq > ds)
    cell = F.struct(
        F.when(q_worst, -rr - rs).otherwise(rq).cast("bigint").alias("q"),
        F.when(~q_worst & (dr > ds), -rq - rs).otherwise(rr).cast("bigint").alias("r"),
    )
    return F.when(lon.isNotNull() & lat.isNotNull(), cell)


def cell_center_x(cell: Column, edge: float = DEFAULT_EDGE) -> Column:
    return (cell["q"] + cell["r"] * F.lit(0.5)) * F.lit(edge * _SQRT3)


def cell_center_y(cell: Column, edge: float = DEFAULT_EDGE) -> Column:
    return cell["r"] * F.lit(edge * 1.5)


def cell_distance(a: Column, b: Column) -> Column:
    """Grid steps between two cells."""
    dq, dr = a["q"] - b["q"], a["r"] - b["r"]
    return ((F.abs(dq) + F.abs(dr) + F.abs(dq + dr)) / F.lit(2)).cast("bigint")


def cell_ring(cell: Column, k: int) -> Column:
    """All cells within ``k`` steps, ``3k(k+1)+1`` of them."""
    steps = [(i, j) for i in range(-k, k + 1) for j in range(-k, k + 1) if abs(i + j) <= k]
    return F.array(*[F.struct((cell["q"] + i).alias("q"), (cell["r"] + j).alias("r")) for i, j in steps])


def cell_boundary(cell: Column, edge: float = DEFAULT_EDGE, lon_scale: float = 1.0) -> Column:
    """Closed ring of the six corners."""
    cx, cy = cell_center_x(cell, edge), cell_center_y(cell, edge)
    corners = [(math.cos(math.radians(60 * i - 30)) * edge, math.sin(math.radians(60 * i - 30)) * edge) for i in (0, 1, 2, 3, 4, 5, 0)]
    return F.array(*[F.struct(((cx + dx) / F.lit(lon_scale)).alias("x"), (cy + dy).alias("y")) for dx, dy in corners])
