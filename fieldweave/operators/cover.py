"""Cells of shapes and points, rings, and work on the parts of shapes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldweave.functions import cells as C
from fieldweave.functions import shapes as S
from fieldweave.operators.skew import salted_join, shuffle_partitions
from fieldweave.session import freeze

_ROWS_PER_BAND = 32  # cell rows of one shape handled together
# How far from an edge, in degrees, a cell centre is tested exactly: far above rounding, far below the size of a cell.
_UNSURE = 1e-9


def ring(df: DataFrame, id_col: str, cell_col: str, k: int) -> DataFrame:
    """Every cell becomes all cells within ``k`` steps, each once per id."""
    return df.select(id_col, F.explode(C.cell_ring(F.col(cell_col), k)).alias(cell_col)).distinct()


def _runs(xs: Column, left: Column) -> Column:
    """Stretches between every two crossings; what lies left of an odd one (an open ring) counts from ``left`` on."""
    even = F.when(F.size(xs) % 2 == 1, F.concat(F.array(left), xs)).otherwise(xs)
    pairs = F.filter(F.transform(even, lambda x, i: F.struct(x.alias("lo"), F.get(even, i + 1).alias("hi"), i.alias("i"))), lambda p: p["i"] % 2 == 0)
    return F.transform(pairs, lambda p: F.struct(p["lo"].alias("lo"), p["hi"].alias("hi")))


def _apart(ranges: Column) -> Column:
    """Ranges ``struct<lo,hi>`` of whole numbers cut so that none overlaps another."""

    def add(acc: Column, r: Column) -> Column:
        start = F.greatest(r["lo"], F.coalesce(F.get(acc, F.size(acc) - 1)["hi"] + 1, r["lo"]))
        return F.when(start > r["hi"], acc).otherwise(F.concat(acc, F.array(F.struct(start.alias("lo"), r["hi"].alias("hi")))))

    return F.aggregate(F.array_sort(ranges), F.array().cast("array<struct<lo:bigint,hi:bigint>>"), add)


def cover(df: DataFrame, id_col: str, shape_col: str, edge_deg: float = C.DEFAULT_EDGE) -> DataFrame:
    """Cells whose centre lies inside the shape: a scan-line fill.

    A shape is cut into bands of cell rows, each with the edges that reach it, and the bands are spread over tasks. In a
    row the sorted crossings of the edges give runs of cells, so nothing outside is made. Only centres as near to an edge
    as rounding could decide are tested one by one.
    """
    row_height, col_width, near = edge_deg * 1.5, edge_deg * math.sqrt(3.0), F.lit(_UNSURE)
    box = F.col("_box")
    y_of = lambda r: r * F.lit(row_height)

    def reaching(edges: Column, low: Column, high: Column) -> Column:
        a, b = (lambda e: e["a"]["y"]), (lambda e: e["b"]["y"])
        return F.filter(edges, lambda e: (F.greatest(a(e), b(e)) >= low - near) & (F.least(a(e), b(e)) <= high + near))

    shapes = (
        df.select(id_col, F.col(shape_col).alias("_shape"))
        .where(F.col("_shape").isNotNull())
        .select(id_col, S.bounds(F.col("_shape")).alias("_box"), F.transform("_shape", S.part_edges).alias("_edges"))
        .withColumn("_r0", F.ceil(box["ymin"] / F.lit(row_height)).cast("bigint"))
        .withColumn("_r1", F.floor(box["ymax"] / F.lit(row_height)).cast("bigint"))
        .where("_r1 >= _r0")
    )
    bands = shapes.withColumn("_from", F.explode(F.sequence(F.col("_r0"), F.col("_r1"), F.lit(_ROWS_PER_BAND))))
    to = F.least(F.col("_r1"), F.col("_from") + _ROWS_PER_BAND - 1)
    within = F.transform("_edges", lambda edges: reaching(edges, y_of(F.col("_from")), y_of(to)))
    bands = bands.select(id_col, "_from", to.alias("_to"), box["xmin"].alias("_left"), F.filter(within, lambda edges: F.size(edges) > 0).alias("_edges"))
    bands = bands.repartition(shuffle_partitions(df), id_col, "_from")

    rows = bands.withColumn("_r", F.explode(F.sequence("_from", "_to")))
    y, shift = y_of(F.col("_r")), F.col("_r") * F.lit(0.5)
    rows = rows.select(id_col, "_r", "_left", F.transform("_edges", lambda edges: reaching(edges, y, y)).alias("_edges"))

    def columns(lo: Column, hi: Column) -> Column:
        first = F.ceil(lo / F.lit(col_width) - shift).cast("bigint")
        return F.struct(first.alias("lo"), F.floor(hi / F.lit(col_width) - shift).cast("bigint").alias("hi"))

    def at(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return a["x"] + (y - a["y"]) * F.try_divide(b["x"] - a["x"], b["y"] - a["y"])

    def crossings(edges: Column) -> Column:
        return F.array_sort(F.transform(F.filter(edges, lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y)), at))

    def doubtful(e: Column) -> Column:
        """Stretch around a crossing or an end; the whole of an edge that lies in the row."""
        a, b = e["a"], e["b"]
        low, high = F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])
        wide = near * (F.lit(1.0) + F.abs(F.try_divide(b["x"] - a["x"], b["y"] - a["y"])))
        x = F.greatest(low, F.least(high, at(e)))
        flat = F.abs(a["y"] - b["y"]) <= near
        return columns(F.when(flat, low - near).otherwise(x - wide), F.when(flat, high + near).otherwise(x + wide))

    some = lambda ranges: F.filter(ranges, lambda r: r["lo"] <= r["hi"])
    runs = F.flatten(F.transform("_edges", lambda edges: F.transform(_runs(crossings(edges), F.col("_left")), lambda s: columns(s["lo"], s["hi"]))))
    unsure = F.flatten(F.transform("_edges", lambda edges: F.transform(edges, doubtful)))
    filled = rows.select(id_col, "_r", "_edges", some(runs).alias("_runs"), some(unsure).alias("_unsure"))
    ranges = filled.select(id_col, "_r", "_edges", "_unsure", F.explode(_apart(F.concat("_runs", "_unsure"))).alias("_s"))
    ranges = ranges.withColumn("_edges", F.when(F.size("_unsure") > 0, F.col("_edges")))
    cells = ranges.withColumn("_q", F.explode(F.sequence("_s.lo", "_s.hi")))
    cell = F.struct(F.col("_q").alias("q"), F.col("_r").alias("r"))
    x = C.cell_center_x(cell, edge_deg)
    sure = ~F.exists("_unsure", lambda r: F.col("_q").between(r["lo"], r["hi"]))
    exact = F.exists("_edges", lambda edges: S.point_in_edges(x, C.cell_center_y(cell, edge_deg), edges))
    return cells.where((F.size("_unsure") == 0) | sure | F.coalesce(exact, F.lit(False))).select(id_col, cell.alias("cell"))


def points_to_cells(
    df: DataFrame, id_col: str, assoc_col: str, x: Column, y: Column, edge_deg: float = C.DEFAULT_EDGE
) -> DataFrame:
    """Point layer to ``(id, cell, associated id)``, -1 where nothing is associated."""
    return df.select(id_col, C.cell_of_point(x, y, edge_deg).alias("cell"), F.coalesce(assoc_col, F.lit(-1)).alias(assoc_col))


def dissolve_parts(df: DataFrame, key: str, shape_col: str) -> DataFrame:
    """All parts of all member shapes per key, one row per distinct part; missing shapes are skipped."""
    return df.where(F.col(shape_col).isNotNull()).select(key, F.explode(shape_col).alias("part")).distinct()


def dissolve(df: DataFrame, key: str, shape_col: str) -> DataFrame:
    """One shape per key holding all distinct parts; the row is as large as the geometry itself.

    Use :func:`dissolve_parts` where a key may own very many parts: the joins accept parts as well.
    """
    return dissolve_parts(df, key, shape_col).groupBy(key).agg(F.array_sort(F.collect_list("part")).alias(shape_col))


def dissolved_centroids(df: DataFrame, key: str, shape_col: str, edge_deg: float = C.DEFAULT_EDGE) -> DataFrame:
    """Mean of the distinct cell centres in the union of the members' covers, and its cell.

    Overlap between members counts once; the result is exact to about one cell. Members too small to hold
    a cell centre contribute the centre of the cell of their centroid.
    """
    members = df.where(F.col(shape_col).isNotNull()).select(key, F.col(shape_col).alias("_member"))
    covered = cover(members, key, "_member", edge_deg)
    centers = members.select(key, S.centroid(F.col("_member")).alias("_c"))
    own = centers.select(key, C.cell_of_point(F.col("_c.x"), F.col("_c.y"), edge_deg).alias("cell"))
    cells = covered.unionByName(own).distinct()
    means = cells.groupBy(key).agg(
        F.avg(C.cell_center_x(F.col("cell"), edge_deg)).alias("centroid_x"),
        F.avg(C.cell_center_y(F.col("cell"), edge_deg)).alias("centroid_y"),
    )
    return means.withColumn("cell", C.cell_of_point(F.col("centroid_x"), F.col("centroid_y"), edge_deg))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
def _hull(vertex_lists: pd.Series) -> pd.Series:
    def half(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
        chain: list[tuple[float, float]] = []
        for p in points:
            while len(chain) > 1:
                (ax, ay), (bx, by) = chain[-2], chain[-1]
                if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                    break
                chain.pop()
            chain.append(p)
        return chain

    def hull(vertices: np.ndarray | None):
        if vertices is None or len(vertices) == 0:
            return None
        points = sorted({(v["x"], v["y"]) for v in vertices})
        if len(points) < 3:
            ring = points + points[:1]
        else:
            lower, upper = half(points), half(points[::-1])
            ring = lower[:-1] + upper[:-1]
            ring = ring + ring[:1]
        return [{"x": x, "y": y} for x, y in ring]

    return vertex_lists.map(hull)


def convex_hull(shape: Column) -> Column:
    """Convex hull of one shape; its vertices are already in the row, so no shuffle is needed."""
    return F.when(shape.isNotNull(), F.array(F.array(_hull(S.vertices(shape)))))


EARTH_RADIUS_KM = 6371.0088
_KM_PER_DEG = EARTH_RADIUS_KM * math.pi / 180.0


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def connected_components(nodes: DataFrame, edges: DataFrame, keys: list[str], node: str) -> DataFrame:
    """Smallest node of each component: neighbours' minimum, then a jump along the labels, until nothing moves.

    ``edges`` holds ``keys, src, dst`` in both directions. Jumping makes the number of rounds logarithmic in
    the length of the longest chain; each round is written to the shared folder.
    """
    labels = freeze(nodes.select(*keys, node, F.col(node).alias("label")), "labels")
    while True:
        seen = labels.select(*keys, F.col(node).alias("src"), F.col("label").alias("_near"))
        offered = edges.join(seen, [*keys, "src"]).groupBy(*keys, F.col("dst").alias(node)).agg(F.min("_near").alias("_offer"))
        lowered = labels.join(offered, [*keys, node], "left").select(
            *keys, node, F.col("label").alias("_old"), F.least("label", F.coalesce("_offer", "label")).alias("_mid")
        )
        target = lowered.select(*keys, F.col(node).alias("_mid"), F.col("_mid").alias("_far"))
        jumped = lowered.join(target, [*keys, "_mid"], "left").select(
            *keys, node, "_old", F.least("_mid", F.coalesce("_far", "_mid")).alias("label")
        )
        step = freeze(jumped, "labels")
        labels = step.drop("_old")
        if step.where(F.col("label") != F.col("_old")).isEmpty():
            return labels


def largest_part_cluster(df: DataFrame, id_col: str, shape_col: str, eps_km: float = 10.0, min_samples: int = 1) -> DataFrame:
    """Keep, per shape, the largest group of parts whose centroids chain within ``eps_km``.

    With ``min_samples=1`` density clustering equals connected components. Parts in one small square are
    connected by construction, so the graph has a node per occupied square instead of per part, and only
    distinct neighbouring squares become edges.
    """
    if min_samples != 1:
        raise ValueError("only min_samples=1 is defined")
    side = eps_km / math.sqrt(2.0) / _KM_PER_DEG
    one_part = S.centroid(F.array(F.col("part")))
    parts = (
        df.where(F.col(shape_col).isNotNull())
        .select(id_col, F.posexplode(shape_col).alias("part_no", "part"))
        .withColumn("_c", one_part)
        .withColumn("_u", F.floor(F.col("_c")["x"] / F.lit(side)).cast("bigint"))
        .withColumn("_v", F.floor(F.col("_c")["y"] / F.lit(side)).cast("bigint"))
    )
    square = F.struct(F.col("_v").alias("v"), F.col("_u").alias("u"))
    parts = freeze(parts.withColumn("square", square), "parts")
    # a degree of longitude is shorter away from the equator: more squares lie within reach
    reach = F.ceil(F.lit(math.sqrt(2.0)) / F.greatest(F.cos(F.radians(F.least(F.lit(89.0), F.abs(F.col("_c")["y"]) + side * 2))), F.lit(0.01)))
    probe = parts.select(
        id_col, F.col("part_no").alias("_p1"), F.col("square").alias("src"), F.col("_c").alias("_c1"), "_u", "_v", reach.cast("bigint").alias("_reach")
    )
    probe = probe.withColumn("_dv", F.explode(F.sequence(F.lit(-2), F.lit(2)))).withColumn(
        "_du", F.explode(F.sequence(-F.col("_reach"), F.col("_reach")))
    )
    probe = probe.select(id_col, "_p1", "src", "_c1", (F.col("_u") + F.col("_du")).alias("_tu"), (F.col("_v") + F.col("_dv")).alias("_tv"))
    other = parts.select(
        id_col, F.col("part_no").alias("_p2"), F.col("square").alias("dst"), F.col("_c").alias("_c2"), F.col("_u").alias("_tu"), F.col("_v").alias("_tv")
    )
    close = haversine_km(F.col("_c1")["x"], F.col("_c1")["y"], F.col("_c2")["x"], F.col("_c2")["y"]) <= eps_km
    pairs = salted_join(probe, other, [id_col, "_tu", "_tv"], ["_p1"], ["_p2"], "inner", close & (F.col("src") != F.col("dst")))
    edges = pairs.select(id_col, "src", "dst").distinct()
    edges = freeze(edges.unionByName(edges.select(id_col, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    labels = connected_components(parts.select(id_col, "square").distinct(), edges, [id_col], "square")
    labelled = parts.join(labels, [id_col, "square"])
    sizes = labelled.groupBy(id_col, "label").agg(F.count(F.lit(1)).alias("_n"), F.min("part_no").alias("_first"))
    best = sizes.groupBy(id_col).agg(F.max_by("label", F.struct(F.col("_n"), -F.col("_first"))).alias("label"))
    kept = labelled.join(best, [id_col, "label"], "left_semi")
    return kept.groupBy(id_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("part_no", "part"))), lambda p: p["part"]).alias(shape_col),
        F.count(F.lit(1)).alias("n_parts"),
    )
