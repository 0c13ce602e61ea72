"""Queries of cells and geometry."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fieldweave.catalog.base import num, query, rounded, sql_cells, sql_steps
from fieldweave.functions import cells as C
from fieldweave.functions import shapes as S
from fieldweave.operators import cover as V
from fieldweave.operators.spatial_join import point_shape_join, shape_shape_join
from fieldweave.session import freeze

EDGE = 0.047  # coarse cells for the covers of the one-degree rectangles
_W, _H = num(EDGE * math.sqrt(3.0)), num(EDGE * 1.5)

_COVER = f"""cov_r AS (SELECT *, unnest(generate_series(CAST(floor((lat - half) / {_H}) AS BIGINT) - 1, CAST(ceil((lat + half) / {_H}) AS BIGINT) + 1)) AS r FROM fx_field),
cov_q AS (SELECT *, unnest(generate_series(CAST(floor((lon - half) / {_W} - r * 0.5e0) AS BIGINT) - 1, CAST(ceil((lon + half) / {_W} - r * 0.5e0) AS BIGINT) + 1)) AS q FROM cov_r),
cov AS (SELECT field_id, country, q, r FROM cov_q WHERE (q + r * 0.5e0) * {_W} > lon - half AND (q + r * 0.5e0) * {_W} < lon + half
  AND r * {_H} > lat - half AND r * {_H} < lat + half)"""


@query("GEO1_cell_of_point", f"WITH {sql_cells('c', 'fx_source')} SELECT source_id, field_id, q, r FROM c")
def _(fx):
    return fx.source_cell.select("source_id", "field_id", "cell.q", "cell.r")


@query(
    "GEO2_cell_distance",
    f"""WITH {sql_cells("c", "fx_source")} SELECT x.field_id, y.source_id, {sql_steps("x", "y")} AS steps
    FROM c x JOIN c y ON x.field_id = y.field_id WHERE x.source_id = 'a2024' AND y.source_id <> 'a2024'""",
)
def _(fx):
    a = fx.source_cell.where("source_id = 'a2024'").select("field_id", F.col("cell").alias("c1"))
    other = fx.source_cell.where("source_id <> 'a2024'").select("field_id", "source_id", F.col("cell").alias("c2"))
    return a.join(other, "field_id").select("field_id", "source_id", C.cell_distance(F.col("c1"), F.col("c2")).alias("steps"))


@query(
    "GEO3_ring_smooth",
    f"""WITH {sql_cells("c", "fx_source")}, s AS (SELECT unnest(generate_series(-2, 2)) AS i)
    SELECT DISTINCT c.field_id AS id, c.q + a.i AS q, c.r + b.i AS r FROM c, s a, s b WHERE abs(a.i + b.i) <= 2""",
)
def _(fx):
    cells = fx.source_cell.select(F.col("field_id").alias("id"), "cell")
    return V.ring(cells, "id", "cell", 2).select("id", "cell.q", "cell.r")


@query("GEO4_cell_cover", f"WITH {_COVER} SELECT field_id, q, r FROM cov")
def _(fx):
    return V.cover(fx.field_shape, "field_id", "shape", EDGE).select("field_id", "cell.q", "cell.r")


@query(
    "GEO5_cell_boundary",
    f"""WITH {sql_cells("c", "fx_field", edge=EDGE)} SELECT field_id, 7 AS n_vertices,
      round((q + r * 0.5e0) * {_W} - {num(EDGE * math.cos(math.radians(30)))}, 6) AS x_min, round(r * {_H} + {num(EDGE)}, 6) AS y_max FROM c""",
)
def _(fx):
    cell = C.cell_of_point(F.col("lon"), F.col("lat"), EDGE)
    ring = C.cell_boundary(cell, EDGE)
    box = S.bounds(F.array(F.array(F.col("ring"))))
    return fx.field.select("field_id", ring.alias("ring")).select(
        "field_id", F.size("ring").alias("n_vertices"), rounded(box["xmin"]).alias("x_min"), rounded(box["ymax"]).alias("y_max")
    )


_NEAR = """SELECT f.id, greatest(abs(f.lon - g.lon) - g.half, 0) AS dx, greatest(abs(f.lat - g.lat) - g.half, 0) AS dy,
  abs(f.lon - g.lon) < g.half AND abs(f.lat - g.lat) < g.half AS inside
  FROM (SELECT DISTINCT id, lon, lat FROM fx_flare) f JOIN fx_field g ON abs(f.lon - g.lon) < g.half + 1 AND abs(f.lat - g.lat) < g.half + 1"""


def _shapes_around(fx, out, distance=0.0):
    """How many fields lie around each flare, counted once per position and outline."""
    points = freeze(fx.flare.select("id", "lon", "lat").distinct(), "points")
    outlines = fx.field_shape.groupBy("shape").agg(F.count(F.lit(1)).alias("n"))
    pairs = point_shape_join(points.select("lon", "lat").distinct(), outlines, ["lon", "lat"], distance=distance)
    counts = pairs.groupBy("lon", "lat").agg(F.sum("n").alias("n"))
    return points.join(counts, ["lon", "lat"]).groupBy("id").agg(F.sum("n").alias(out))


@query("GEO6_point_in_shape", f"SELECT id, count(*) AS n_inside FROM ({_NEAR}) WHERE inside GROUP BY id")
def _(fx):
    return _shapes_around(fx, "n_inside")


@query("GEO7_point_in_buffered_shape", f"SELECT id, count(*) AS n_near FROM ({_NEAR}) WHERE sqrt(dx * dx + dy * dy) < 0.05e0 GROUP BY id")
def _(fx):
    return _shapes_around(fx, "n_near", 0.05)


_BANDS = """SELECT r_name || side AS name, -30e0 + r_regionkey * 2e0 AS south, CASE side WHEN '_Mar' THEN -60e0 ELSE -55e0 END AS west
  FROM region, (VALUES ('_Mar'), ('_Terra')) v(side)"""


@query(
    "GEO8_shape_in_shape",
    f"""SELECT f.field_id, b.name AS basin FROM fx_field f JOIN ({_BANDS}) b ON f.lon - f.half >= b.west AND f.lon + f.half <= b.west + 5
      AND f.lat - f.half >= b.south AND f.lat + f.half <= b.south + 2""",
)
def _(fx):
    basins = fx.basin.select(F.col("name").alias("basin"), "outer_shape")
    return shape_shape_join(fx.field_shape, basins, "field_id", "inner").select("field_id", "basin")


@query(
    "GEO9_dissolve",
    f"""WITH {_COVER}, {sql_cells("own", "fx_field", edge=EDGE)},
    cells AS (SELECT country, q, r FROM cov UNION SELECT country, q, r FROM own),
    means AS (SELECT country, avg((q + r * 0.5e0) * {_W}) AS x, avg(r * {_H}) AS y FROM cells GROUP BY country),
    parts AS (SELECT country, count(DISTINCT (lon, lat, half)) AS n_parts FROM fx_field GROUP BY country)
    SELECT country, n_parts, round(x, 6) AS centroid_x, round(y, 6) AS centroid_y FROM means JOIN parts USING (country)""",
)
def _(fx):
    shapes = V.dissolve(fx.field_shape, "country", "shape").select("country", F.size("shape").cast("bigint").alias("n_parts"))
    centers = V.dissolved_centroids(fx.field_shape, "country", "shape", EDGE)
    return shapes.join(centers, "country").select("country", "n_parts", rounded("centroid_x").alias("centroid_x"), rounded("centroid_y").alias("centroid_y"))


@query("GEO10_centroid", "SELECT field_id, round(lon, 6) AS x, round(lat, 6) AS y FROM fx_field")
def _(fx):
    rows = fx.field_shape.select("field_id", S.centroid(F.col("shape")).alias("c"))
    return rows.select("field_id", rounded("c.x").alias("x"), rounded("c.y").alias("y"))


@query("GEO11_convex_hull", "SELECT field_id, 5 AS n_vertices, round(lon - half, 6) AS x0, round(lat + half, 6) AS y1 FROM fx_field")
def _(fx):
    rows = fx.field_shape.select("field_id", V.convex_hull(F.col("shape")).alias("hull"))
    box = S.bounds(F.col("hull"))
    return rows.select("field_id", F.size(S.vertices(F.col("hull"))).alias("n_vertices"), rounded(box["xmin"]).alias("x0"), rounded(box["ymax"]).alias("y1"))


_KM = (
    "2 * 6371.0088e0 * asin(least(1e0, sqrt(sin(radians(b.lat - a.lat) / 2) ** 2"
    " + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2)))"
)


@query(
    "GEO12_largest_cluster_of_parts",
    f"""WITH RECURSIVE p AS (SELECT country, lon, lat, row_number() OVER () AS k FROM (SELECT DISTINCT country, lon, lat, half FROM fx_field)),
    e AS (SELECT a.country, a.k AS x, b.k AS y FROM p a JOIN p b ON a.country = b.country WHERE {_KM} <= 250),
    reach AS (SELECT country, x, y FROM e UNION SELECT r.country, r.x, e.y FROM reach r JOIN e ON e.x = r.y),
    size AS (SELECT country, x, count(*) AS n FROM reach GROUP BY country, x)
    SELECT country, max(n) AS n_parts FROM size GROUP BY country""",
)
def _(fx):
    shapes = V.dissolve(fx.field_shape, "country", "shape")
    return V.largest_part_cluster(shapes, "country", "shape", eps_km=250.0).select("country", "n_parts")


@query(
    "GEO13_wkt",
    "SELECT field_id, 5 AS n_vertices, lon - half AS x0, lat + half AS y1, true AS same_text FROM fx_field",
)
def _(fx):
    rows = fx.field_shape.select("field_id", S.format_wkt(F.col("shape")).alias("wkt"))
    back = rows.select("field_id", "wkt", S.parse_wkt(F.col("wkt")).alias("shape"))
    box = S.bounds(F.col("shape"))
    return back.select(
        "field_id", F.size(S.vertices(F.col("shape"))).alias("n_vertices"), box["xmin"].alias("x0"), box["ymax"].alias("y1"),
        (S.format_wkt(F.col("shape")) == F.col("wkt")).alias("same_text"),
    )


@query(
    "GEO14_points_to_cells_table",
    f"WITH {sql_cells('c', 'fx_flare')} SELECT id, month, year, q, r, CASE WHEN id % 3 = 0 THEN -1 ELSE id % 100 END AS field_id FROM c",
)
def _(fx):
    points = fx.flare.withColumn("field_id", F.when(F.col("id") % 3 != 0, F.col("id") % 100))
    keyed = points.withColumn("key", F.struct("id", F.col("month").cast("bigint").alias("month"), F.col("year").cast("bigint").alias("year")))
    out = V.points_to_cells(keyed, "key", "field_id", F.col("lon"), F.col("lat"))
    return out.select("key.id", "key.month", "key.year", "cell.q", "cell.r", "field_id")


